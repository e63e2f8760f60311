"""Least squares from Gram sums, its diagnostics, and the random-effects panel model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import dense_index, materialise


def gram(df: DataFrame, y: str, xs: list[str], constant: bool = True) -> DataFrame:
    """(a, b, value): sums of all pairwise products of the regressors and the target, one pass."""
    cols = {"const": F.lit(1.0), **{x: F.col(x).cast("double") for x in xs}} if constant else {x: F.col(x).cast("double") for x in xs}
    cols[y] = F.col(y).cast("double")
    names = list(cols)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sum(cols[a] * cols[b]).alias("value")) for a, b in pairs]).alias("g"))
    return row.select(F.inline("g"))


def _arrays(g: DataFrame, y: str):
    """Gram rows (one per pair of columns) to X'X, X'y, y'y and names."""
    cells = {(r["a"], r["b"]): r["value"] for r in g.collect()}
    names = list(dict.fromkeys(a for a, _ in cells))
    m = np.array([[cells.get((a, b), cells.get((b, a))) for b in names] for a in names], dtype=float)
    i = names.index(y)
    keep = [j for j in range(len(names)) if j != i]
    return m[np.ix_(keep, keep)], m[keep, i], m[i, i], [names[j] for j in keep]


def _solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and (X'X)^-1, with columns scaled to unit length first."""
    d = np.sqrt(np.diag(xx))
    inv = np.linalg.pinv(xx / np.outer(d, d))
    return (inv @ (xy / d)) / d, inv / np.outer(d, d)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > t) by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def tail(a, b, x):
        tiny, c = 1e-300, 1.0
        d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + num * d or tiny)
                c = 1.0 + num / c or tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1.0) / (a + b + 2.0):
        return front * tail(a, b, x) / a
    return 1.0 - front * tail(b, a, 1.0 - x) / b


class OLS:
    """Ordinary least squares: the Gram sums are Spark's, the k x k solve is local."""

    def __init__(self, df: DataFrame, y: str, xs: list[str], constant: bool = True):
        self.y, self.xs, self.constant, self.rows = y, xs, constant, df.na.drop(subset=[y, *xs])
        stats = self.rows.agg(F.count(F.lit(1)), F.sum(y)).first()
        xx, xy, yy, self.names = _arrays(gram(self.rows, y, xs, constant), y)
        self.n, k = stats[0], len(self.names)
        self.coef, inv = _solve(xx, xy)
        self.sse = max(yy - self.coef @ xy, 0.0)
        self.df = self.n - k
        total = yy - stats[1] ** 2 / self.n if constant else yy
        self.r2 = 1 - self.sse / total
        self.adj_r2 = 1 - (1 - self.r2) * (self.n - (1 if constant else 0)) / self.df
        self.se = np.sqrt(np.diag(inv) * self.sse / self.df)
        self.t = self.coef / self.se
        self.p = np.array([t_two_sided(abs(t), self.df) for t in self.t])

    def coefficients(self) -> DataFrame:
        data = [(n, *map(float, v)) for n, *v in zip(self.names, self.coef, self.se, self.t, self.p)]
        return self.rows.sparkSession.createDataFrame(data, "term string, coef double, se double, t double, p double")

    def predict(self, df: DataFrame | None = None) -> DataFrame:
        out = F.lit(0.0)
        for n, c in zip(self.names, self.coef):
            out = out + (F.lit(float(c)) if n == "const" else float(c) * F.col(n))
        return (self.rows if df is None else df).withColumn("prediction", out)

    def residuals(self) -> DataFrame:
        return self.predict().withColumn("residual", F.col(self.y) - F.col("prediction"))

    def summary(self, order: list[Column]) -> DataFrame:
        """One row: fit and residual diagnostics, residuals taken in a unique order."""
        d = residual_diagnostics(self.residuals(), "residual", order)
        lit = {"n": self.n, "r2": self.r2, "adj_r2": self.adj_r2}
        return d.select(*[F.lit(v).alias(k) for k, v in lit.items()], *d.columns)


def durbin_watson(df: DataFrame, residual: str, order: list[Column]) -> DataFrame:
    """Sum of squared first differences over sum of squares, in an explicit row order."""
    rows = dense_index(df, order).select("idx", F.col(residual).alias("e"))
    prev = rows.select((F.col("idx") + 1).alias("idx"), F.col("e").alias("p"))
    j = rows.join(prev, "idx", "left")
    return j.agg((F.sum((F.col("e") - F.col("p")) ** 2) / F.sum(F.col("e") ** 2)).alias("durbin_watson"))


def residual_diagnostics(df: DataFrame, residual: str, order: list[Column]) -> DataFrame:
    """Durbin-Watson, skew, kurtosis (normal = 3), Jarque-Bera and omnibus with their p-values."""
    e = F.col(residual)
    m = df.agg(F.count(e).cast("double").alias("n"), F.skewness(e).alias("skew"), (F.kurtosis(e) + 3).alias("kurtosis"))
    n, s, k = F.col("n"), F.col("skew"), F.col("kurtosis")
    jb = n / 6 * (s * s + (k - 3) * (k - 3) / 4)
    # D'Agostino skewness and Anscombe-Glynn kurtosis scores; omnibus is the sum of their squares.
    y = s * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    a = F.sqrt(2 / (w2 - 1))
    zs = 1 / F.sqrt(0.5 * F.log(w2)) * F.log(y / a + F.sqrt((y / a) * (y / a) + 1))
    ek = 3 * (n - 1) / (n + 1)
    vk = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (k - ek) / F.sqrt(vk)
    rb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    aa = 6 + 8 / rb * (2 / rb + F.sqrt(1 + 4 / (rb * rb)))
    root = (1 - 2 / aa) / (1 + x * F.sqrt(2 / (aa - 4)))
    zk = (1 - 2 / (9 * aa) - F.signum(root) * F.pow(F.abs(root), 1 / 3)) / F.sqrt(2 / (9 * aa))
    out = m.withColumn("jarque_bera", jb).withColumn("omnibus", zs * zs + zk * zk)
    out = out.withColumn("jb_p", F.exp(-F.col("jarque_bera") / 2)).withColumn("omnibus_p", F.exp(-F.col("omnibus") / 2))
    return out.withColumn("durbin_watson", durbin_watson(df, residual, order).scalar()).drop("n")


def entity_moments(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """(entity, t, m, w): rows, means and sums of centred products (upper triangle, row by row) of each entity, in one scan."""
    rows = df.select(entity, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    t = F.count(F.lit(1)).cast("double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return rows.groupBy(entity).agg(t.alias("t"), F.array(*[F.avg(c) for c in cols]).alias("m"), F.array(*[F.covar_pop(a, b) * t for a, b in pairs]).alias("w"))


def _summed(moments: DataFrame, weight: Column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over entities of ``weight`` times products of (1, means), as a matrix, and of the centred products."""
    one = F.concat(F.array(F.lit(1.0)), F.col("m"))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    inner = [(i, j) for i in range(k) for j in range(i, k)]
    row = moments.agg(F.array(*[F.sum(weight * F.get(one, F.lit(i)) * F.get(one, F.lit(j))) for i, j in pairs]).alias("a"),
                      F.array(*[F.sum(F.get("w", F.lit(i))) for i in range(len(inner))]).alias("b")).first()
    means, within = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
    for (i, j), v in zip(pairs, row["a"]):
        means[i, j] = means[j, i] = v
    for (i, j), v in zip(inner, row["b"]):
        within[i + 1, j + 1] = within[j + 1, i + 1] = v
    return means, within


def random_effects(df: DataFrame, entity: str, y: str, xs: list[str]) -> dict:
    """Swamy-Arora random effects for (unbalanced) panels: coefficients, variance parts, R².

    All fits come from the entities' moments, written once: a row less ``theta`` times its entity's mean is its
    distance from the mean plus (1 - theta) times the mean, and the products of the two parts add up to nothing."""
    moments = materialise(entity_moments(df, entity, [y, *xs]), "moments")
    k = len(xs)
    between, within = _summed(moments, F.lit(1.0), k + 1)
    total = _summed(moments, F.col("t"), k + 1)[0] + within
    n_ent, n = between[0, 0], total[0, 0]
    x, c = slice(2, None), [0, *range(2, k + 2)]
    beta_w, _ = _solve(within[x, x], within[x, 1])
    s2e = (within[1, 1] - beta_w @ within[x, 1]) / (n - n_ent - k)
    beta_b, _ = _solve(between[np.ix_(c, c)], between[c, 1])
    t_bar = n_ent / moments.agg(F.sum(1 / F.col("t"))).first()[0]
    s2u = max(0.0, max(between[1, 1] - beta_b @ between[c, 1], 0.0) / (n_ent - k - 1) - s2e / t_bar)
    # t (1 - theta)^2 with theta = 1 - sqrt(s2e / (t s2u + s2e))
    quasi = _summed(moments, F.col("t") * F.lit(float(s2e)) / (F.col("t") * F.lit(float(s2u)) + F.lit(float(s2e))), k + 1)[0] + within
    beta, inv = _solve(quasi[np.ix_(c, c)], quasi[c, 1])
    sse = max(quasi[1, 1] - beta @ quasi[c, 1], 0.0)
    left = np.array([-beta[0], 1.0, *-beta[1:]])

    def r2(products: np.ndarray, centre: bool) -> float:
        spread = products[1, 1] - (products[0, 1] ** 2 / products[0, 0] if centre else 0.0)
        return float(1 - left @ products @ left / spread)

    return {"terms": ["const", *xs], "coef": beta, "se": np.sqrt(np.diag(inv) * sse / (n - k - 1)), "sigma2_e": float(s2e),
            "sigma2_u": float(s2u), "r2_overall": r2(total, True), "r2_between": r2(between, True), "r2_within": r2(within, False)}
