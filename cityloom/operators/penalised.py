"""Ridge, lasso and elastic net from sums of products.

One pass takes the moments of all monomials, a second one, per fold, the sums of products of the standardized monomials,
1 and the target. All that follows works on these matrices, whose size depends on the columns alone: the
sums of a training set are those of all folds less its own, standardizing by the training set's own moments is a linear
change of them, coefficients come out of an exact active-set search, and errors on a fold are a quadratic form in the
fold's sums. So every penalty, mixing ratio and fold is served by the same two passes.

A model's features are the columns scaled by the training set's mean and deviation and, with ``raw``, all monomials of
the columns as they are; its target is scaled likewise (with ``scale_target``). The penalties are on the coefficients
of these features: ``alpha`` times the l1 norm and half the squared l2 norm, mixed by ``l1_ratio``, beside half the mean
squared error; for ridge ``alpha`` times the squared l2 norm beside the squared error."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEST = -2


def monomials(columns: list[str], degree: int) -> list[Column]:
    out = []
    for d in range(1, degree + 1):
        for names in combinations_with_replacement(columns, d):
            x = F.col(names[0]).cast("double")
            for n in names[1:]:
                x = x * F.col(n)
            out.append(x)
    return out


class Sums:
    """Sums of products by fold over (1, standardized monomials, standardized target)."""

    def __init__(self, columns: list[str], degree: int, mean: np.ndarray, dev: np.ndarray, folds: dict[int, np.ndarray]):
        self.columns, self.degree, self.mean, self.dev, self.folds = columns, degree, mean, dev, folds

    def train(self, without: int | None) -> np.ndarray:
        return sum(s for f, s in self.folds.items() if f >= 0 and f != without)


def fold_sums(df: DataFrame, fold: Column, columns: list[str], target: str, degree: int = 1) -> Sums:
    """``fold`` is 0, 1, ... on training rows and TEST on rows held out; moments are those of the training rows."""
    terms = [*monomials(columns, degree), F.col(target).cast("double")]
    k = len(terms)
    rows = df.select(fold.cast("long").alias("fold"), F.array(*terms).alias("x"))
    at = rows.where("fold >= 0").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).toPandas().sort_values("i")
    mean, dev = at["m"].to_numpy(float), at["s"].to_numpy(float)
    if len(mean) < k:
        raise ValueError("no training rows")
    dev = np.where(dev > 0, dev, 1.0)

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            f = np.asarray(batch.column(0))
            x = (np.asarray(batch.column(1).flatten()).reshape(-1, k) - mean) / dev
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            for g in np.unique(f):
                own = x[f == g]
                found[int(g)] = found.get(int(g), 0) + own.T @ own
        for g, s in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, g)), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["fold", "cell", "v"])

    cells = rows.mapInArrow(run, "fold long, cell long, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toPandas()
    folds = {}
    for f, part in cells.groupby("fold"):
        s = np.zeros((k + 1) ** 2)
        s[part["cell"]] = part["v"]
        folds[int(f)] = s.reshape(k + 1, k + 1)
    return Sums(columns, degree, mean, dev, folds)


def minimise(q: np.ndarray, c: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """b that minimises b'qb/2 - c'b + sum(l1 |b|), to rounding.

    Variables come in one at a time, worst violation first; the active ones go to their joint optimum for the present
    signs, or to the best point on the way where one of them becomes zero."""
    if not l1.any():
        return np.linalg.lstsq(q, c, rcond=1e-13)[0]
    b, sign = np.zeros(len(c)), np.zeros(len(c))
    eps = 1e-12 * max(1.0, float(np.abs(c).max()))

    def cost(v):
        return v @ q @ v / 2 - c @ v + l1 @ np.abs(v)

    for _ in range(50 * len(c)):
        slope = q @ b - c
        over = np.where(b == 0, np.abs(slope) - l1, -np.inf)
        j = int(np.argmax(over))
        if over[j] <= eps:
            break
        before = cost(b)
        sign[j] = -np.sign(slope[j])
        for _ in range(50 * len(c)):
            a = np.flatnonzero(sign)
            goal = np.linalg.lstsq(q[np.ix_(a, a)], c[a] - l1[a] * sign[a], rcond=1e-13)[0]
            step = goal - b[a]
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = np.where(step != 0, -b[a] / step, np.inf)
            tries = [1.0, *[t for t in cross if 0 < t < 1]]
            points = []
            for t in tries:
                v = b.copy()
                v[a] = b[a] + t * step
                if t < 1:
                    v[a[np.abs(cross - t) < 1e-15]] = 0.0
                points.append((cost(v), t, v))
            _, t, b = min(points, key=lambda p: p[0])
            sign = np.sign(b)
            if t == 1.0 and (np.sign(goal) == sign[a]).all():
                slope = q @ b - c
                if np.abs(slope[sign != 0] + (l1 * sign)[sign != 0]).max(initial=0) <= 1e3 * eps or cost(b) >= before - abs(before) * 1e-15:
                    break
                before = cost(b)
        else:
            break
    return b


class Linear:
    """Coefficients on the monomials; ``predict`` adds ``prediction`` to any rows."""

    def __init__(self, sums: Sums, weights: np.ndarray, intercept: float):
        self.sums, self.weights, self.intercept = sums, weights, intercept

    def predict(self, df: DataFrame) -> DataFrame:
        out = F.lit(float(self.sums.mean[-1] + self.sums.dev[-1] * self.intercept))
        for x, w, m, s in zip(monomials(self.sums.columns, self.sums.degree), self.weights, self.sums.mean, self.sums.dev):
            if w:
                out = out + F.lit(float(self.sums.dev[-1] * w / s)) * (x - F.lit(float(m)))
        return df.withColumn("prediction", out)

    def errors(self, fold: int) -> tuple[float, float, float, float]:
        """(rows, sum and squares of the target, squared errors) of a fold, in standardized units."""
        s = self.sums.folds.get(fold)
        if s is None:
            return 0.0, 0.0, 0.0, 0.0
        v = np.concatenate([[-self.intercept], -self.weights, [1.0]])
        return float(s[0, 0]), float(s[0, -1]), float(s[-1, -1]), float(max(0.0, v @ s @ v))

    def r2(self, fold: int) -> float:
        n, y, yy, ee = self.errors(fold)
        spread = yy - y * y / n if n else 0.0
        return 1 - ee / spread if spread > 0 else float("nan")


def solve(sums: Sums, kind: str, alpha: float, l1_ratio: float | None = None, without: int | None = None, raw: bool = True, scale_target: bool = True) -> Linear:
    """The model of the training rows outside fold ``without``."""
    s = sums.train(without)
    n = s[0, 0]
    mean = s[0] / n
    g = s / n - np.outer(mean, mean)  # covariances in units of all training rows
    p, k = len(sums.columns), len(sums.mean) - 1
    dev = np.sqrt(np.maximum(np.diag(g), 0))
    y_dev = (dev[-1] if scale_target else 1 / sums.dev[-1]) or 1.0
    scaled = [j for j in range(p) if dev[j + 1] > 1e-12]
    use = np.array([*scaled, *(j for j in range(k) if raw and dev[j + 1] > 1e-12)], int)
    # weight of a coefficient's penalty when features are measured in units of ``sums``
    weight = np.array([*(dev[j + 1] for j in scaled), *(1 / sums.dev[j] for j in use[len(scaled):])])
    q, c = g[np.ix_(use + 1, use + 1)], g[use + 1, -1] / y_dev
    if kind == "ridge":
        l1, l2 = 0.0, alpha / n
    else:
        ratio = 1.0 if kind == "lasso" else l1_ratio
        l1, l2 = alpha * ratio, alpha * (1 - ratio)
    b = minimise(q + np.diag(l2 * weight ** 2), c, l1 * weight) * y_dev
    total = np.zeros(k)
    np.add.at(total, use, b)
    return Linear(sums, total, float(mean[-1] - total @ mean[1:k + 1]))


def fit(train: DataFrame, columns: list[str], target: str, kind: str, degree: int = 1, scale_target: bool = True, raw: bool = True, **params) -> Linear:
    sums = fold_sums(train, F.lit(0), columns, target, degree)
    return solve(sums, kind, params.get("alpha", 1.0), params.get("l1_ratio"), None, raw, scale_target)
