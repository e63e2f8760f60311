"""Regression trees, forests and boosted trees, many models at a time.

Features are binned once. All models of a call (the draws and folds of a search, say) grow together, level by level:
one pass adds up rows, weights and gradients by (model, node, feature, bin), the best cut of every node is taken from
these sums, and the next pass sends rows on through the cuts. Squared loss has gradient y - prediction and a constant
second derivative, so a leaf's value is sum of gradients / (sum of weights + ``penalty``) and a cut's gain
follows from the sums of its two sides; cuts of boosted trees whose gain stays under ``gamma`` are taken back from the
bottom up. Equal gains go to the first feature, then the lowest cut, so a model does not depend on how rows lie.

Where the table has at most ``LOCAL_ROWS`` rows, its bins (a few MB) are broadcast and each model is grown in the task
that holds it, by the same rules; beyond, passes over the table do it. Both give the same trees."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .scale import materialise

LOCAL_ROWS = 1 << 16
BINS = 64
#: Cells of one pass, and models that one table of predictions holds.
CELLS = 1 << 22
WAVE = 64
LEAST_GAIN = 1e-9
TIE = 1e-10
ALL, TEST = -1, -2


@dataclass(frozen=True)
class Growth:
    """How a model grows; ``fold`` names the rows it must not see (ALL: it sees every training row)."""

    trees: int = 1
    depth: int = 5
    leaf: int = 1
    split: int = 2
    rate: float = 1.0
    penalty: float = 0.0
    gamma: float = 0.0
    bagged: bool = False
    boosted: bool = False
    fold: int = ALL
    seed: int = 42
    bootstrap: bool = True

    def sample(self, key: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is in the sample of a tree."""
        return bag(key, self.seed, tree) if self.bagged and self.bootstrap else np.ones(len(key))


def growth(kind: str, **p) -> Growth:
    rows = {"leaf": p.get("leaf", 1), "split": p.get("split", 2)}
    if kind == "decision_tree":
        return Growth(1, p.get("depth", 5), **rows)
    if kind == "random_forest":
        return Growth(p.get("trees", 38), p.get("depth", 5), **rows, bagged=True, bootstrap=p.get("bootstrap", True))
    if kind == "gradient_boosting":
        return Growth(p.get("trees", 58), p.get("depth", 5), **rows, rate=0.1, boosted=True)
    if kind == "boosted_trees":
        return Growth(p.get("trees", 41), p.get("depth", 5), **rows, rate=0.3, penalty=p.get("penalty", 1.0), gamma=p.get("gamma", 0.0), boosted=True)
    raise ValueError(f"unknown trees {kind}")


def edges_of(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of each column's bins, the last one open; all values if there are few."""
    grid = [j / bins for j in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, grid, 100 * bins).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in columns]


def binned(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, v, side="left").astype(np.uint8) for v, e in zip(values, edges)], 1)


def bag(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a row is in the tree's sample: Poisson with mean 1, from its key."""
    x = key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) * 0xD1342543DE82EF95 % (1 << 64))
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    u = (x >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676], u, side="right").astype(float)


class Tree:
    """Nodes in order of their levels: feature (-1: leaf), cut (bins up to it go left), left child (the right one follows), value, gain."""

    def __init__(self):
        self.feature, self.cut, self.left = np.array([-1]), np.array([0]), np.array([0])
        self.value, self.gain = np.zeros(1), np.zeros(1)

    def cut_nodes(self, nodes, feature, cut, gain) -> None:
        """Give each of ``nodes`` two leaves."""
        n, k = len(self.feature), len(nodes)
        self.feature[nodes], self.cut[nodes], self.gain[nodes], self.left[nodes] = feature, cut, gain, n + 2 * np.arange(k)
        for name, fill in (("feature", -1), ("cut", 0), ("left", 0), ("value", 0.0), ("gain", 0.0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(2 * k, fill, old.dtype)]))

    def prune(self, gamma: float) -> None:
        while True:
            inner = np.flatnonzero((self.feature >= 0) & (self.gain / 2 < gamma))
            a = self.left[inner]
            last = inner[(self.feature[a] < 0) & (self.feature[a + 1] < 0)]
            if not len(last):
                return
            self.feature[last] = -1

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            at = node[rows]
            inner = self.feature[at] >= 0
            rows, at = rows[inner], at[inner]
            node[rows] = self.left[at] + (bins[rows, self.feature[at]] > self.cut[at])
        return node


def _score(g, w, penalty):
    return np.divide(g * g, w + penalty, out=np.zeros_like(g), where=w > 0)


# -- one model in one task ---------------------------------------------------------------------------


def grow(bins: np.ndarray, g: np.ndarray, w: np.ndarray, how: Growth) -> Tree:
    """One tree on rows with weights. Rows are kept in order of (node, bin) for every feature."""
    tree = Tree()
    n, k = bins.shape
    rows = np.flatnonzero(w > 0)
    order = rows[np.argsort(bins[rows].T, axis=1, kind="stable")]
    node = np.zeros(n, np.int64)
    frontier = np.zeros(1, np.int64)
    column = np.arange(k)[:, None]
    for level in range(how.depth + 1):
        if not order.size:
            break
        here = node[order]
        order = np.take_along_axis(order, np.argsort(here, axis=1, kind="stable"), 1)
        here = node[order[0]]
        starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        size = np.diff(np.append(starts, order.shape[1]))
        own = np.repeat(np.arange(len(starts)), size)
        cg, cw = np.cumsum(g[order], 1), np.cumsum(w[order], 1)
        before = np.maximum(starts - 1, 0)
        head = starts > 0
        bg, bw = np.where(head, cg[:, before], 0), np.where(head, cw[:, before], 0)
        stop = starts + size - 1
        total_g, total_w = cg[0, stop] - bg[0], cw[0, stop] - bw[0]
        tree.value[frontier] = total_g / (total_w + how.penalty)
        if level == how.depth:
            break
        left_g, left_w = cg - bg[:, own], cw - bw[:, own]
        score = _score(left_g, left_w, how.penalty) + _score(total_g[own] - left_g, total_w[own] - left_w, how.penalty)
        place = np.arange(order.shape[1]) - starts[own] + 1
        b = bins[order, column]
        ok = np.zeros(score.shape, bool)
        ok[:, :-1] = (own[1:] == own[:-1]) & (b[:, 1:] > b[:, :-1])
        ok &= (place >= how.leaf) & (size[own] - place >= how.leaf) & (size[own] >= how.split)
        score[~ok] = -np.inf
        best = np.maximum.reduceat(score, starts, axis=1).max(0)
        gain = best - _score(total_g, total_w, how.penalty)
        taken = gain > LEAST_GAIN
        if how.gamma:  # no cut below gains more than the squares there, so none would be kept
            squares = np.add.reduceat(g[order[0]] ** 2 / w[order[0]], starts)
            taken &= squares * (1 + 1e-9) >= 2 * how.gamma
        if not taken.any():
            break
        bar = best - TIE * np.maximum(1, np.abs(np.where(taken, best, 0)))
        spot = np.minimum.reduceat(np.where(score >= bar[own], np.arange(order.shape[1]), order.shape[1]), starts, axis=1)
        feature = np.argmax(spot < order.shape[1], 0)
        at = spot[feature, np.arange(len(starts))]
        feature, at = feature[taken], at[taken]
        cut = bins[order[feature, at], feature]
        first = len(tree.feature)
        tree.cut_nodes(frontier[taken], feature, cut, gain[taken])
        child = np.full(len(starts), -1)
        child[taken] = 2 * np.arange(taken.sum())
        f_of, c_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        f_of[taken], c_of[taken] = feature, cut
        active = order[0]
        node[active] = np.where(child[own] >= 0, child[own] + (bins[active, f_of[own]] > c_of[own]), -1)
        order = order[node[order] >= 0].reshape(k, -1)
        frontier = first + np.arange(2 * int(taken.sum()))
    if how.gamma:
        tree.prune(how.gamma)
    return tree


@dataclass
class Block:
    """A whole small table: bins, target, fold and key of each row."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray

    def train(self, how: Growth) -> np.ndarray:
        return (self.fold >= 0) & (self.fold != how.fold)


def grow_model(block: Block, how: Growth, scale: tuple[float, float] | None = None) -> tuple[list[Tree], np.ndarray, tuple[float, float]]:
    """(trees, predictions of all rows, (mean, deviation) of the target the trees learn)."""
    seen = block.train(how).astype(float)
    mean, dev = scale or target_scale(block.y[seen > 0])
    y = (block.y - mean) / dev
    total = np.zeros(len(y))
    trees = []
    for t in range(how.trees):
        w = seen * how.sample(block.key, t)
        tree = grow(block.bins, (y - total if how.boosted else y) * w, w, how)
        trees.append(tree)
        total += how.rate * tree.value[tree.route(block.bins)]
        if how.boosted and len(tree.feature) == 1 and abs(tree.value[0]) < 1e-12:
            break
    return trees, (total / how.trees if how.bagged else total) * dev + mean, (mean, dev)


def target_scale(y: np.ndarray) -> tuple[float, float]:
    return (float(y.mean()), float(y.std()) or 1.0) if len(y) else (0.0, 1.0)


# -- passes over a table -----------------------------------------------------------------------------


class Pass:
    """What one pass needs of the models: their growth, target scales, place among the predictions and the tree being grown."""

    def __init__(self, models: list[Growth], scales: list[tuple[float, float]], trees: list[Tree], t: int, k: int):
        self.models, self.scales, self.trees, self.t, self.k = models, scales, trees, t, k

    def gradient(self, i: int, batch: dict) -> tuple[np.ndarray, np.ndarray]:
        how, (mean, dev) = self.models[i], self.scales[i]
        w = ((batch["fold"] >= 0) & (batch["fold"] != how.fold)).astype(float)
        w = w * how.sample(batch["key"], self.t)
        y = (batch["y"] - mean) / dev
        return (y - batch["pred"][:, i] if how.boosted else y) * w, w


def _batch(batch: pa.RecordBatch, k: int) -> dict:
    n = batch.num_rows
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    out = {name: np.asarray(col[name]) for name in ("y", "fold", "key")}
    out["bins"] = np.frombuffer(b"".join(col["bins"].to_pylist()), np.uint8).reshape(n, k)
    out["pred"] = np.asarray(col["pred"].flatten()).reshape(n, -1)
    return out


def _sums(rows: DataFrame, state: Pass, wanted: list[tuple[int, int]]) -> DataFrame:
    """(model, node, feature, bin, rows, weight, gradient) of the wanted (model, node) pairs."""
    shipped = rows.sparkSession.sparkContext.broadcast((state, wanted))

    def run(batches):
        state, wanted = shipped.value
        slot = {}
        for j, (i, node) in enumerate(wanted):
            slot.setdefault(i, {})[node] = j
        cells = np.zeros((len(wanted) * state.k * 256, 3))
        for batch in batches:
            b = _batch(batch, state.k)
            for i, nodes in slot.items():
                g, w = state.gradient(i, b)
                place = np.full(len(state.trees[i].feature), -1)
                place[list(nodes)] = list(nodes.values())
                at = place[state.trees[i].route(b["bins"])]
                on = np.flatnonzero((at >= 0) & (w > 0))
                for f in range(state.k):
                    cell = (at[on] * state.k + f) * 256 + b["bins"][on, f]
                    low, cell = cell.min(initial=0), cell - cell.min(initial=0)
                    for c, v in enumerate((None, w[on], g[on])):
                        add = np.bincount(cell, v)
                        cells[low:low + len(add), c] += add
        on = np.flatnonzero(cells[:, 0])
        if len(on):
            j, f, b = on // 256 // state.k, on // 256 % state.k, on % 256
            pair = np.array(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (pair[j, 0], pair[j, 1], f, b, *cells[on].T)], ["model", "node", "feature", "bin", "rows", "weight", "gradient"])

    out = rows.mapInArrow(run, "model long, node long, feature long, bin long, rows double, weight double, gradient double")
    return out.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("rows", "weight", "gradient")])


def _cuts(sums: DataFrame, models: list[Growth], k: int) -> pd.DataFrame:
    """(model, node, value, gain, feature, cut) of every node; no gain: a leaf. A group is the bins of one node."""
    shipped = sums.sparkSession.sparkContext.broadcast(models)

    def best(key, rows: pd.DataFrame) -> pd.DataFrame:
        how = shipped.value[key[0]]
        cells = np.zeros((k, 256, 3))
        cells[rows["feature"], rows["bin"]] = rows[["rows", "weight", "gradient"]]
        n, w, g = cells[0].sum(0)
        left = cells.cumsum(1)[:, :-1]
        score = _score(left[..., 2], left[..., 1], how.penalty) + _score(g - left[..., 2], w - left[..., 1], how.penalty)
        score[(left[..., 0] < max(1, how.leaf)) | (n - left[..., 0] < max(1, how.leaf)) | (n < how.split)] = -np.inf
        top = score.max()
        gain = top - float(_score(np.array([g]), np.array([w]), how.penalty)[0])
        at = int(np.argmax(score >= top - TIE * max(1, abs(top)))) if np.isfinite(top) else 0
        return pd.DataFrame({"model": [key[0]], "node": [key[1]], "value": [g / (w + how.penalty)], "gain": [gain], "feature": [at // 255], "cut": [at % 255]})

    return sums.groupBy("model", "node").applyInPandas(best, "model long, node long, value double, gain double, feature long, cut long").toPandas()


def _grow_wave(rows: DataFrame, models: list[Growth], k: int) -> tuple[list[list[Tree]], list[tuple[float, float]], DataFrame]:
    spark = rows.sparkSession
    folds = rows.where("fold >= 0").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).toPandas()
    scales = []
    for how in models:
        held = folds[folds["fold"] != how.fold]
        n = held["n"].sum()
        mean = (held["n"] * held["m"]).sum() / max(n, 1)
        scales.append((float(mean), float(np.sqrt((held["n"] * (held["v"] + (held["m"] - mean) ** 2)).sum() / max(n, 1))) or 1.0))
    rows = materialise(rows.withColumn("pred", F.array_repeat(F.lit(0.0), len(models))), "boost")
    grown: list[list[Tree]] = [[] for _ in models]
    for t in range(max(how.trees for how in models)):
        trees = [Tree() for _ in models]
        frontier = [(i, 0) for i, how in enumerate(models) if t < how.trees]
        state = Pass(models, scales, trees, t, k)
        level = 0
        while frontier:
            per_pass = max(1, CELLS // (k * 256))
            found = pd.concat([_cuts(_sums(rows, state, frontier[a:a + per_pass]), models, k) for a in range(0, len(frontier), per_pass)])
            frontier = []
            for i, part in found.sort_values("node").groupby("model"):
                tree = trees[i]
                tree.value[part["node"]] = part["value"]
                part = part[part["gain"] > LEAST_GAIN]
                if level < models[i].depth and len(part):
                    first = len(tree.feature)
                    tree.cut_nodes(part["node"].to_numpy(), part["feature"].to_numpy(), part["cut"].to_numpy(), part["gain"].to_numpy())
                    frontier += [(i, j) for j in range(first, len(tree.feature))]
            level += 1
        for i, how in enumerate(models):
            if t < how.trees:
                if how.gamma:
                    trees[i].prune(how.gamma)
                grown[i].append(trees[i])
        rows = materialise(_add_trees(rows, models, [x if t < how.trees else None for x, how in zip(trees, models)], k), "boost")
    return grown, scales, rows


def _add_trees(rows: DataFrame, models: list[Growth], trees: list[Tree | None], k: int) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(([how.rate for how in models], trees))

    def run(batches):
        rates, trees = shipped.value
        for batch in batches:
            b = _batch(batch, k)
            pred = b["pred"].copy()
            for i, tree in enumerate(trees):
                if tree is not None:
                    pred[:, i] += rates[i] * tree.value[tree.route(b["bins"])]
            offs = pa.array(np.arange(batch.num_rows + 1) * len(trees), pa.int32())
            at = batch.schema.get_field_index("pred")
            yield batch.set_column(at, "pred", pa.ListArray.from_arrays(offs, pa.array(pred.ravel())))

    return rows.mapInArrow(run, rows.schema)


# -- both -------------------------------------------------------------------------------------------


def _rows(df: DataFrame, key: Column, fold: Column, columns: list[str], target: str, edges: list[np.ndarray]) -> DataFrame:
    """(key, fold, y, bins) with the bins of a row as bytes."""
    @pandas_udf("binary")
    def pack(*values: pd.Series) -> pd.Series:
        packed = binned([v.to_numpy(float) for v in values], edges)
        return pd.Series([r.tobytes() for r in packed], dtype=object)

    return df.select(key.cast("long").alias("key"), fold.cast("int").alias("fold"), F.col(target).cast("double").alias("y"), pack(*[F.col(c).cast("double") for c in columns]).alias("bins"))


def _block(rows: DataFrame, k: int) -> Block:
    t = rows.toArrow()
    bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, k)
    return Block(bins, t["y"].to_numpy(), t["fold"].to_numpy(), t["key"].to_numpy())


def _errors(y: np.ndarray, pred: np.ndarray, on: np.ndarray) -> list[float]:
    y, e = y[on], y[on] - pred[on]
    return [float(v) for v in (len(y), y.sum(), (y * y).sum(), (e * e).sum())]


def _r2(n: float, s: float, ss: float, ee: float) -> float:
    spread = ss - s * s / n if n else 0.0
    return 1 - ee / spread if spread > 0 else float("nan")


def scores(df: DataFrame, key: Column, fold: Column, columns: list[str], target: str, models: list[Growth]) -> list[float]:
    """r2 of every model on the rows of its own fold; models of fold ALL are scored on the rows of fold TEST."""
    edges = edges_of(df.where(fold >= 0), columns)
    rows = materialise(_rows(df, key, fold, columns, target, edges), "binned")
    k = len(columns)
    spark = df.sparkSession
    if rows.count() <= LOCAL_ROWS:
        shipped = spark.sparkContext.broadcast((_block(rows, k), models))

        def run(batches):
            block, models = shipped.value
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    _, pred, _ = grow_model(block, models[i])
                    on = block.fold == (TEST if models[i].fold == ALL else models[i].fold)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (i, *_errors(block.y, pred, on))], ["model", "n", "s", "ss", "ee"])

        # the largest models first, one after the other in many small tasks
        work = sorted(range(len(models)), key=lambda i: -models[i].trees * models[i].depth)
        ids = spark.createDataFrame([(i, p) for p, i in enumerate(work)], "model long, place long")
        parts = min(len(models), 4 * spark.sparkContext.defaultParallelism)
        found = ids.repartitionByRange(parts, F.col("place") % parts).select("model").mapInArrow(run, "model long, n double, s double, ss double, ee double").toPandas()
    else:
        found = []
        for a in range(0, len(models), WAVE):
            wave = models[a:a + WAVE]
            _, scales, done = _grow_wave(rows, wave, k)
            for i, how in enumerate(wave):
                mean, dev = scales[i]
                pred = F.get("pred", F.lit(i)) / (how.trees if how.bagged else 1) * dev + mean
                part = done.where(F.col("fold") == (TEST if how.fold == ALL else how.fold))
                found.append(part.agg(F.lit(a + i).alias("model"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("ss"), F.sum((F.col("y") - pred) ** 2).alias("ee")))
        found = reduce(DataFrame.unionByName, found).toPandas()
    out = [float("nan")] * len(models)
    for r in found.itertuples():
        out[int(r.model)] = _r2(r.n, r.s or 0.0, r.ss or 0.0, r.ee or 0.0)
    return out


class Forest:
    """A fitted model; ``predict`` adds ``prediction`` to any rows."""

    def __init__(self, columns: list[str], edges: list[np.ndarray], how: Growth, trees: list[Tree], scale: tuple[float, float]):
        self.columns, self.edges, self.how, self.trees, self.scale = columns, edges, how, trees, scale

    def predict(self, df: DataFrame) -> DataFrame:
        shipped = df.sparkSession.sparkContext.broadcast((self.edges, self.how, self.trees, self.scale))

        @pandas_udf("double")
        def value(*values: pd.Series) -> pd.Series:
            edges, how, trees, (mean, dev) = shipped.value
            bins = binned([v.to_numpy(float) for v in values], edges)
            total = np.zeros(len(bins))
            for tree in trees:
                total += how.rate * tree.value[tree.route(bins)]
            return pd.Series((total / how.trees if how.bagged else total) * dev + mean)

        return df.withColumn("prediction", value(*[F.col(c).cast("double") for c in self.columns]))


def fit(train: DataFrame, columns: list[str], target: str, how: Growth, key: Column | None = None, scale_target: bool = True) -> Forest:
    """One model. Rows of a bagged one need a ``key`` for their weights; without scaling, ``gamma`` is in the target's own units."""
    spark = train.sparkSession
    edges = edges_of(train, columns)
    rows = materialise(_rows(train, key if key is not None else F.xxhash64(*columns, target), F.lit(0), columns, target, edges), "binned")
    k = len(columns)
    if how.gamma and not scale_target:
        how = replace(how, gamma=how.gamma / (rows.agg(F.var_pop("y")).first()[0] or 1.0))
    if rows.count() > LOCAL_ROWS:
        grown, scales, _ = _grow_wave(rows, [how], k)
        return Forest(columns, edges, how, grown[0], scales[0])
    shipped = spark.sparkContext.broadcast((_block(rows, k), how))

    def run(batches):
        block, how = shipped.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                # trees of a forest are grown apart, those of a boosted model in one go
                part = replace(how, trees=1, boosted=True, bagged=False) if how.bagged else how
                if how.bagged:
                    mean, dev = target_scale(block.y)
                    w = how.sample(block.key, t)
                    grown, scale = [grow(block.bins, (block.y - mean) / dev * w, w, part)], (mean, dev)
                else:
                    grown, _, scale = grow_model(block, how)
                for j, tree in enumerate(grown):
                    n = len(tree.feature)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t + j)), pa.array(np.arange(n)), pa.array(tree.feature), pa.array(tree.cut.astype(np.int64)), pa.array(tree.left), pa.array(tree.value),
                         pa.array(np.full(n, scale[0])), pa.array(np.full(n, scale[1]))], ["tree", "node", "feature", "cut", "left", "value", "mean", "dev"])

    tasks = how.trees if how.bagged else 1
    nodes = spark.range(0, tasks, 1, tasks).mapInArrow(run, "tree long, node long, feature long, cut long, left long, value double, mean double, dev double").toPandas()
    trees = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        tree = Tree()
        for name in ("feature", "cut", "left", "value"):
            setattr(tree, name, part[name].to_numpy())
        trees.append(tree)
    scale = (float(nodes["mean"].iloc[0]), float(nodes["dev"].iloc[0]))
    return Forest(columns, edges, how, trees, scale)
