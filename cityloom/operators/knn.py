"""Exact nearest-neighbour regression and imputation.

Rows are packed into blocks, two blocks meet through an equi-join, and a block pair gives only
the best k per query row. Bounds decide which blocks have to meet, so results stay exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .scale import BLOCK_ROWS, blocks, materialise, salted_join

#: Pivots per square root of the donors: a cell holds about as many donors as there are cells.
PIVOT_SHARE = 1.0


def _matrix(rows) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=float) for r in rows])


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distances, added up column by column to keep memory at one block pair."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = np.abs(a[:, j, None] - b[None, :, j])
        out += d * d if metric == "euclidean" else d
    return np.sqrt(out) if metric == "euclidean" else out


def _cells_udf(pivots: np.ndarray, metric: str):
    @pandas_udf(T.StructType().add("cell", "integer").add("r", "double"))
    def nearest(f: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(f), pivots, metric)
        c = d.argmin(axis=1)
        return pd.DataFrame({"cell": c.astype("int32"), "r": d[np.arange(len(d)), c]})

    return nearest


def _near_enough(limit: np.ndarray) -> np.ndarray:
    """A limit with room for rounding."""
    return limit * (1 + 1e-9) + 1e-12


def _bounds(d: np.ndarray, counts: np.ndarray, radii: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From the distances to the cells' pivots: a bound of each row's k-th distance, and the cells that may hold one of its k
    nearest donors by the triangle inequality."""
    reach = d + radii
    order = np.argsort(reach, axis=1, kind="stable")
    enough = np.cumsum(counts[order], axis=1) >= min(k, counts.sum())
    bound = np.take_along_axis(reach, order, axis=1)[np.arange(len(d)), enough.argmax(axis=1)]
    return bound, d - radii <= _near_enough(bound)[:, None]


#: Stands for a null key inside a block of vectors, where keys are 64-bit integers.
_NO_KEY = (1 << 63) - 1
#: Blocks that a partition holds while blocks meet: about 32 MB of 64 columns.
BLOCKS_HELD = 128


def _vector_blocks(rows: DataFrame, key: str, apart: bool, columns: str, make) -> DataFrame:
    """Rows ``(cell, key, f, ...)`` in order of their cell, at most ``BLOCK_ROWS`` to a block and, if ``apart``, of one cell;
    ``make`` turns a block's rows into the values of ``columns``."""
    rows = rows.withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)))
    names = [c.split()[0] for c in columns.split(", ")]

    def pack(batches):
        left = None
        for pdf in batches:
            left = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            at, cell = np.arange(len(left)), left["cell"].to_numpy()
            new = np.concatenate([[True], (cell[1:] != cell[:-1]) & apart])
            begins = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK_ROWS == 0)
            if len(begins) > 1:
                yield pd.DataFrame([make(left.iloc[a:b]) for a, b in zip(begins[:-1], begins[1:])], columns=names)
            left = left.iloc[begins[-1]:].reset_index(drop=True)
        if left is not None:
            yield pd.DataFrame([make(left)], columns=names)

    return rows.repartitionByRange("cell", key).sortWithinPartitions("cell", key).mapInPandas(pack, columns)


def _top_k(batches, pivots: np.ndarray, radii: dict, metric: str, k: int):
    """The k nearest donors of each query row among the pairs of blocks of a task; what was found in one pair bounds the next."""
    found = {}
    for pdf in batches:
        for block, q, qf, bound, cell, d, df, y in zip(*[pdf[c] for c in ("block", "q", "qf", "bound", "cell", "d", "df", "y")]):
            f, g = (np.frombuffer(v).reshape(-1, pivots.shape[1]) for v in (qf, df))
            if block not in found:
                found[block] = [np.frombuffer(q, np.int64), np.frombuffer(bound).copy(), [np.zeros(0, t) for t in (np.int64, float, np.int64, float)]]
            _, limit, near = found[block]
            rows = np.flatnonzero(_distances(f, pivots[cell:cell + 1], metric)[:, 0] - radii[cell] <= _near_enough(limit))
            dist = _distances(f[rows], g, metric)
            i, j = np.nonzero(~(dist > _near_enough(limit)[rows, None]))
            both = zip(near, (rows[i], dist[i, j], np.frombuffer(d, np.int64)[j], np.frombuffer(y)[j]))
            row, dist, d, y = (np.concatenate(v) for v in both)
            order = np.lexsort((d, dist, row))
            rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            near = found[block][2] = [v[order[rank < k]] for v in (row, dist, d, y)]
            last = order[rank == k - 1]
            limit[row[last]] = np.fmin(limit[row[last]], dist[last])
    for q, _, (row, dist, d, y) in found.values():
        yield pd.DataFrame({"q": q[row], "d": d, "dist": dist, "y": y})


def nearest_rows(queries: DataFrame, donors: DataFrame, k: int, metric: str = "manhattan") -> DataFrame:
    """``(q, d, dist, y, rank)``: the k nearest donors ``(d, f, y)`` of each query ``(q, f)``; without donors no rows.

    Donors fall into cells around pivots, as many as the square root of the donors; a query visits the cells the triangle
    inequality cannot rule out. Of identical donors only the k lowest keys can ever be used. Rows are written a fixed number of
    times: blocks of queries meet blocks of donors partition by partition, as they are read, and only the k best of a query leave a task."""
    spark = donors.sparkSession
    same = W.partitionBy("f").orderBy("d")
    donors = donors.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    donors = materialise(donors, "donors")
    n_pivots = max(1, round(PIVOT_SHARE * donors.count() ** 0.5))
    picked = donors.select("f").orderBy(F.md5(F.col("d").cast("string"))).limit(n_pivots).collect()
    if not picked:
        kinds = dict(queries.dtypes)["q"], dict(donors.dtypes)["d"]
        return spark.createDataFrame([], f"q {kinds[0]}, d {kinds[1]}, dist double, y double, rank int")
    pivots = _matrix([r[0] for r in picked])
    place = _cells_udf(pivots, metric)(F.col("f"))
    placed = materialise(donors.withColumn("_c", place).select("d", "f", "y", "_c.*"), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect()
    cells = np.array([s["cell"] for s in stats])
    counts, radii = np.array([s["n"] for s in stats]), np.array([s["r"] for s in stats])
    reach = {s["cell"]: s["r"] for s in stats}

    def donor_block(rows: pd.DataFrame):
        return int(rows["cell"].iloc[0]), *[np.ascontiguousarray(v).tobytes() for v in (rows["d"].to_numpy(np.int64), _matrix(rows["f"]), rows["y"].to_numpy(float))]

    def query_block(rows: pd.DataFrame):
        f = _matrix(rows["f"])
        bound, keep = _bounds(_distances(f, pivots[cells], metric), counts, radii, k)
        return *[np.ascontiguousarray(v).tobytes() for v in (rows["q"].to_numpy(np.int64), f, bound)], cells[keep.any(axis=0)].tolist()

    held = materialise(_vector_blocks(placed.drop("r"), "d", True, "cell int, d binary, df binary, y binary", donor_block), "held")
    asked = materialise(queries.select("q", "f", place["cell"].alias("cell")), "asked")
    asked = _vector_blocks(asked, "q", False, "q binary, qf binary, bound binary, visits array<int>", query_block)
    asked = materialise(asked.withColumn("block", F.monotonically_increasing_id()), "queries")
    n_held, n_asked, tasks = held.count(), asked.count(), 4 * spark.sparkContext.defaultParallelism
    left = max(1, min(n_asked, max(tasks, -(-n_asked // BLOCKS_HELD))))
    right = min(n_held, max(-(-tasks // left), -(-n_held // BLOCKS_HELD)))
    met = asked.repartition(left).join(held.repartition(right).hint("shuffle_replicate_nl"), F.array_contains("visits", F.col("cell")))
    best = met.drop("visits").mapInPandas(lambda batches: _top_k(batches, pivots, reach, metric, k), "q long, d long, dist double, y double")
    key = lambda c: F.nullif(c, F.lit(_NO_KEY)).alias(c)
    best = best.select(key("q"), key("d"), _nan(F.col("dist")).alias("dist"), "y")
    rank = F.row_number().over(W.partitionBy("q").orderBy("dist", "d"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_regress(queries: DataFrame, donors: DataFrame, k: int = 3, weights: str = "distance", metric: str = "manhattan") -> DataFrame:
    """(q, prediction): mean of the k nearest, plain or weighted by 1/distance; exact matches win."""
    near = nearest_rows(queries, donors, k, metric)
    if weights == "uniform":
        return near.groupBy("q").agg(F.avg("y").alias("prediction"))
    zero = F.col("dist") == 0
    w = 1.0 / F.nullif(F.col("dist"), F.lit(0.0))
    agg = near.groupBy("q").agg(F.avg(F.when(zero, F.col("y"))).alias("exact"), F.sum(w * F.col("y")).alias("a"), F.sum(w).alias("b"))
    return agg.select("q", F.coalesce("exact", F.try_divide("a", "b")).alias("prediction"))


def neighbour_scores(df: DataFrame, key: Column, fold: Column, columns: list[str], target: str, k: int, folds: int, test: int = -2) -> dict[tuple, float]:
    """r2 by (metric, weights, number of neighbours up to ``k``, fold), of every fold by the rows of the others and of the ``test`` rows
    by all folds. Features are the columns scaled by the donors' moments beside the columns as they are. The nearest ``k`` of a row are
    searched once for a metric; running sums over them give the predictions of all smaller numbers."""
    rows = materialise(df.select(key.cast("long").alias("q"), fold.cast("int").alias("fold"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double") for c in columns]), "search")
    out = {}
    for f in (test, *range(folds)):
        donors, asked = rows.where((F.col("fold") >= 0) & (F.col("fold") != f)), rows.where(F.col("fold") == f)
        at = donors.agg(*[g(c).alias(f"{n}_{c}") for c in columns for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
        feature = F.array(*[(F.col(c) - (at[f"m_{c}"] or 0.0)) / (at[f"s_{c}"] or 1.0) for c in columns], *columns)
        for metric in ("euclidean", "manhattan"):
            near = nearest_rows(asked.select("q", feature.alias("f")), donors.select(F.col("q").alias("d"), feature.alias("f"), "y"), k, metric)
            upto = W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
            zero, w = F.col("dist") == 0, 1.0 / F.nullif(F.col("dist"), F.lit(0.0))
            near = near.select("q", "rank", F.avg("y").over(upto).alias("uniform"), F.coalesce(
                F.avg(F.when(zero, F.col("y"))).over(upto), F.try_divide(F.sum(w * F.col("y")).over(upto), F.sum(w).over(upto))).alias("distance"))
            near = near.join(asked.select("q", "y"), "q")
            found = near.groupBy("rank").agg(F.var_pop("y").alias("v"), *[F.avg((F.col("y") - F.col(c)) ** 2).alias(c) for c in ("uniform", "distance")]).collect()
            for r in found:
                for weights in ("uniform", "distance"):
                    out[metric, weights, r["rank"], f] = 1 - r[weights] / r["v"] if r["v"] else float("nan")
    return out


# -- imputation -------------------------------------------------------------------------------

def _impute_udf(k: int, n_cats: int, total: int, n_imputed: int):
    """Best k donors per (query, missing column) of one block pair.

    Squared distance: T / P x (2 per differing category + squared z-score gaps over columns
    present on both sides); T encoded columns in all, P of them present on both sides."""
    out_type = T.ArrayType(T.StructType().add("q", "long").add("c", "integer").add("d", "long").add("dist", "double").add("v", "double"))

    @pandas_udf(out_type)
    def best(qk: pd.Series, qc: pd.Series, qz: pd.Series, qm: pd.Series, dk: pd.Series, dc: pd.Series,
             dz: pd.Series, dv: pd.Series) -> pd.Series:
        out = []
        for keys, cats, z, miss, dkeys, dcats, dzz, vals in zip(qk, qc, qz, qm, dk, dc, dz, dv):
            a, b, m, v = _matrix(z), _matrix(dzz), _matrix(miss), _matrix(vals)
            gap, absent = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
            for j in range(n_cats):
                gap += 2.0 * (np.array([r[j] for r in cats], dtype=object)[:, None] != np.array([r[j] for r in dcats], dtype=object)[None, :])
            for j in range(a.shape[1]):
                d = a[:, j, None] - b[None, :, j]
                gone = np.isnan(d)
                gap += np.where(gone, 0.0, d * d)
                absent += gone
            dist = gap * total / np.maximum(total - absent, 1)
            dkeys, rows = np.asarray(dkeys), []
            for c in range(n_imputed):
                ok = np.flatnonzero(~np.isnan(v[:, c]))
                for i in np.flatnonzero(m[:, c] > 0):
                    near = ok[np.lexsort((dkeys[ok], dist[i, ok]))[:k]]
                    rows += [{"q": int(keys[i]), "c": c, "d": int(dkeys[j]), "dist": float(dist[i, j]), "v": float(v[j, c])} for j in near]
            out.append(rows)
        return pd.Series(out)

    return best


def _nan(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def knn_impute(df: DataFrame, key: str, cell: str, categories: list[str], numeric: list[str], impute: list[str], k: int = 5) -> DataFrame:
    """Fill nulls of ``impute`` by the mean of the k nearest rows that have the column.

    Rows meet their own ``cell`` (one of the categories, a city) first. Any other cell differs in
    that category, which costs at least 2, and by its box of z-scores; only cells whose bound is
    below the k-th distance found so far are visited. No usable donor gives the column mean."""
    moments = df.agg(F.struct(*[f(c).alias(f"{n}{i}") for i, c in enumerate(numeric) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).alias("s"))
    sizes = df.agg(*[F.count_distinct(c) for c in categories]).first()
    total = int(sum(sizes)) + len(numeric)
    s = F.col("_s")
    z = [(F.col(c) - s[f"m{i}"]) / F.coalesce(F.nullif(s[f"s{i}"], F.lit(0.0)), F.lit(1.0)) for i, c in enumerate(numeric)]
    rows = df.withColumn("_s", moments.scalar()).select(
        F.col(key).cast("long").alias("k"), F.col(cell).cast("string").alias("cell"),
        F.array(*[F.col(c).cast("string") for c in categories]).alias("cats"), F.array(*[_nan(x) for x in z]).alias("z"),
        F.array(*[F.col(c).isNull().cast("double") for c in impute]).alias("miss"), F.array(*[_nan(F.col(c)) for c in impute]).alias("vals"))
    rows = materialise(rows, "rows")
    asked = rows.where(F.exists("miss", lambda x: x > 0)).select("k", "cell", "cats", "z", "miss")
    best = _impute_udf(k, len(categories), total, len(impute))
    donors = materialise(blocks(rows, ["cell"], ["k"], ["k", "cats", "z", "vals"], "ds").drop("n_blocks").withColumnRenamed("block", "_db"), "donors")

    def meet(queries: DataFrame) -> DataFrame:
        packed = blocks(queries, ["cell"], ["k"], ["k", "cats", "z", "miss"], "qs").drop("n_blocks")
        met = salted_join(donors, packed, ["cell"], ["_db"])
        return met.select(F.inline(best(*[F.col(c) for c in ("qs.k", "qs.cats", "qs.z", "qs.miss", "ds.k", "ds.cats", "ds.z", "ds.vals")])))

    def keep(found: DataFrame) -> DataFrame:
        w = W.partitionBy("q", "c").orderBy("dist", "d")
        return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)

    own = materialise(keep(meet(asked)), "own")
    kth = own.groupBy("q", "c").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("kth"))
    open_ = (asked.select("k", F.posexplode("miss").alias("c", "m")).where("m > 0")
             .join(kth.withColumnRenamed("q", "k"), ["k", "c"], "left")
             .groupBy("k").agg(F.max(F.coalesce("kth", F.lit(float("inf")))).alias("kth")).where("kth > 2"))
    n_z = len(numeric)
    num = lambda i: F.nanvl(F.get("z", F.lit(i)), F.lit(None).cast("double"))
    boxes = rows.groupBy("cell").agg(
        F.array(*[F.min(num(i)) for i in range(n_z)]).alias("lo"), F.array(*[F.max(num(i)) for i in range(n_z)]).alias("hi"),
        F.array(*[F.count_if(F.isnan(F.get("z", F.lit(i)))) for i in range(n_z)]).alias("gone"))
    # boxes stand in blocks too: a query meets each block once and leaves with the cells it has to visit
    n_blocks = boxes.agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")).scalar()
    packed_boxes = blocks(boxes, [], ["cell"], ["cell", "lo", "hi", "gone"], "boxes").drop("n_blocks")

    @pandas_udf(T.ArrayType(T.StringType()))
    def others(own_cell: pd.Series, z: pd.Series, kth: pd.Series, names: pd.Series, lows: pd.Series, highs: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for mine, q, limit, n, lo, hi, g in zip(own_cell, z, kth, names, lows, highs, gone):
            q = np.asarray(q, dtype=float)
            away = np.maximum(np.maximum(_matrix(lo) - q, q - _matrix(hi)), 0.0)
            bound = 2.0 + np.where((_matrix(g) == 0) & ~np.isnan(away), away, 0.0).__pow__(2).sum(axis=1)
            bound *= total / max(total - np.isnan(q).sum(), 1)  # columns that the query lacks weigh the others up
            n = np.asarray(n, dtype=object)
            out.append(n[(n != mine) & (bound <= limit * (1 + 1e-9))].tolist())
        return pd.Series(out)

    todo = asked.join(open_, "k")
    met = todo.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).join(packed_boxes, "block")
    visits = met.withColumn("cell", F.explode(others("cell", "z", "kth", F.col("boxes.cell"), F.col("boxes.lo"), F.col("boxes.hi"), F.col("boxes.gone"))))
    visits = materialise(visits.select("k", "cell", "cats", "z", "miss"), "visits")
    found = keep(own.drop("_r").unionByName(meet(visits)))
    filled = found.groupBy("q").agg(*[F.avg(F.when(F.col("c") == i, F.col("v"))).alias(f"_f{i}") for i in range(len(impute))])
    out = df.join(filled, F.col(key).cast("long") == F.col("q"), "left")
    means = df.agg(F.struct(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(impute)]).alias("a")).scalar()
    out = out.withColumn("_a", means)
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_f{i}"), F.col(f"_a.a{i}")) for i, c in enumerate(impute)}).drop(
        "q", "_a", *[f"_f{i}" for i in range(len(impute))])
