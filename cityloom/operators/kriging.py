"""Ordinary kriging: binned variogram, spherical fit, and point and grid estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .scale import blocks, discard, materialise, salted_join


#: Rows of a block of places that are compared at a time: arrays of 1 MB.
PAIR_ROWS = 256
_PLACE = ("x", "y", "n", "m", "q")


def _places(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., x, y, n, m, q): the rows at one place by their number, mean and sum of squares about the mean."""
    v = F.col("v")
    rows = df.select(*group, "x", "y", F.col(value).cast("double").alias("v")).where("v is not null")
    flat = F.min(v) == F.max(v)
    return rows.groupBy(*group, "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.when(flat, F.min(v)).otherwise(F.avg(v)).alias("m"),
        F.when(flat, F.min(v) - F.max(v)).otherwise(F.var_pop(v) * F.count(F.lit(1))).alias("q"))


def _pair_blocks(packed: DataFrame, group: list[str]) -> DataFrame:
    """Each unordered pair of blocks of a group once, as arrays; places stay packed."""
    arrays = lambda s: [F.col(f"items.{f}").alias(f"{f}{s}") for f in _PLACE]
    a = packed.select(*group, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("n_blocks") - 1)).alias("j"), *arrays("a"))
    return a.join(packed.select(*group, F.col("block").alias("j"), *arrays("b")), [*group, "j"])


def _pairs(i, j, a, b):
    """(distances, pairs of rows, sums of half squared differences) of two blocks of places ``(x, y, n, m, q)``, flat and some rows
    at a time. In a block against itself each pair counts once; rows that share a place are a pair at distance 0."""
    a, b = [np.asarray(c, float) for c in a], [np.asarray(c, float) for c in b]
    for at in range(0, len(a[0]), PAIR_ROWS):
        x, y, n, m, q = (c[at:at + PAIR_ROWS, None] for c in a)
        d = np.sqrt((x - b[0]) ** 2 + (y - b[1]) ** 2)
        pairs = n * b[2]
        g = 0.5 * (pairs * (m - b[3]) ** 2 + n * b[4] + q * b[2])
        if i == j:
            rows = np.arange(len(d))
            pairs[rows, at + rows] = (n * (n - 1) / 2)[:, 0]
            g[rows, at + rows] = (n * q / 2)[:, 0]
            pairs[np.arange(len(b[0])) < at + rows[:, None]] = 0.0
        keep = pairs > 0
        yield d[keep], pairs[keep], g[keep]


@pandas_udf(T.StructType().add("lo", "double").add("hi", "double"))
def _pair_range(i: pd.Series, j: pd.Series, xa: pd.Series, ya: pd.Series, na: pd.Series, ma: pd.Series, qa: pd.Series,
                xb: pd.Series, yb: pd.Series, nb: pd.Series, mb: pd.Series, qb: pd.Series) -> pd.DataFrame:
    out = []
    for ii, jj, *c in zip(i, j, xa, ya, na, ma, qa, xb, yb, nb, mb, qb):
        ends = [(d.min(), d.max()) for d, _, _ in _pairs(ii, jj, c[:5], c[5:]) if len(d)]
        out.append((np.min([e[0] for e in ends]), np.max([e[1] for e in ends])) if ends else (None, None))
    return pd.DataFrame(out, columns=["lo", "hi"]).astype("float64")


def _bin_udf(n_lags: int):
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def binned(i: pd.Series, j: pd.Series, xa: pd.Series, ya: pd.Series, na: pd.Series, ma: pd.Series, qa: pd.Series, xb: pd.Series,
               yb: pd.Series, nb: pd.Series, mb: pd.Series, qb: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for ii, jj, *c, l, h in zip(i, j, xa, ya, na, ma, qa, xb, yb, nb, mb, qb, lo, hi):
            sums, step = np.zeros(3 * n_lags), (h - l) / n_lags
            for d, n, g in _pairs(ii, jj, c[:5], c[5:]):
                lag = np.minimum(np.floor((d - l) / step) if step > 0 else np.zeros_like(d), n_lags - 1).astype(int)
                sums += np.concatenate([np.bincount(lag, n, n_lags), np.bincount(lag, n * d, n_lags), np.bincount(lag, g, n_lags)])
            out.append(sums)
        return pd.Series(out)

    return binned


def empirical_variogram(df: DataFrame, group: list[str], key: str, value: str, n_lags: int = 6) -> DataFrame:
    """(group..., lag, n_pairs, distance, semivariance) over equal-width distance bins, from all pairs of rows.

    Rows at one place are at the same distance from any other, so places meet, with the number, mean and spread of their rows: the
    work grows with the square of a group's places, not of its rows."""
    packed = blocks(_places(df, group, value), group, ["x", "y"], list(_PLACE))
    pairs = _pair_blocks(materialise(packed, "points"), group)
    cols = [F.col(c) for c in ("i", "j", *[f"{f}{s}" for s in "ab" for f in _PLACE])]
    rng = pairs.select(*group, _pair_range(*cols).alias("r")).groupBy(*group).agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"))
    sums = pairs.join(rng.where("lo is not null"), group).select(*group, _bin_udf(n_lags)(*cols, F.col("lo"), F.col("hi")).alias("s"))
    total = sums.groupBy(*group).agg(F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(3 * n_lags)]).alias("s"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1)))
    out = total.withColumn("lag", lags).withColumn("n_pairs", F.get("s", F.col("lag")).cast("long")).where("n_pairs > 0")
    return out.select(*group, "lag", "n_pairs", (F.get("s", F.col("lag") + n_lags) / F.col("n_pairs")).alias("distance"),
                      (F.get("s", F.col("lag") + 2 * n_lags) / F.col("n_pairs")).alias("semivariance"))


def spherical(h, r):
    u = h / r
    return F.when(h <= r, 1.5 * u - 0.5 * u * u * u).otherwise(F.lit(1.0))


def spherical_fit(variogram: DataFrame, group: list[str], steps: int = 20) -> DataFrame:
    """(group..., psill, range, nugget): for each candidate range the best non-negative sill and
    nugget in closed form, then the range with the smallest squared error."""
    reach = variogram.groupBy(*group).agg(F.max("distance").alias("_far"))
    v = variogram.join(reach, group).withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    v = v.withColumn("range", F.col("_far") * F.col("_j") / steps).withColumn("s", spherical(F.col("distance"), F.col("range")))
    g, s = F.col("semivariance"), F.col("s")
    m = v.groupBy(*group, "range").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(s).alias("a"), F.sum(s * s).alias("b"), F.sum(g).alias("c"),
        F.sum(s * g).alias("d"), F.sum(g * g).alias("e"))
    det = F.col("n") * F.col("b") - F.col("a") * F.col("a")
    slope = F.when(det > 1e-12, (F.col("n") * F.col("d") - F.col("a") * F.col("c")) / F.nullif(det, F.lit(0.0)))
    m = m.withColumn("_c1", slope).withColumn("_c0", (F.col("c") - F.col("_c1") * F.col("a")) / F.col("n"))
    m = m.withColumn("psill", F.when(F.col("_c1").isNull() | (F.col("_c1") < 0), F.lit(0.0))
                     .when(F.col("_c0") < 0, F.try_divide("d", "b")).otherwise(F.col("_c1")))
    m = m.withColumn("nugget", F.when(F.col("_c1").isNull() | (F.col("_c1") < 0), F.col("c") / F.col("n"))
                     .when(F.col("_c0") < 0, F.lit(0.0)).otherwise(F.col("_c0")))
    p, q = F.col("psill"), F.col("nugget")
    sse = (F.col("e") - 2 * q * F.col("c") - 2 * p * F.col("d") + F.col("n") * q * q + 2 * p * q * F.col("a") + p * p * F.col("b"))
    return m.groupBy(*group).agg(F.min_by(F.struct("psill", "range", "nugget"), F.struct(F.round(sse, 6), "range")).alias("m")
                                 ).select(*group, "m.psill", "m.range", "m.nugget")


def _covariance(d, psill, rng, nugget):
    """Sill minus semivariance; the nugget counts at distance 0 only."""
    u = np.fmin(d / rng, 1.0) if rng > 0 else np.where(d <= rng, d, 1.0)
    c = u * u
    c -= 3.0
    c *= u
    c *= 0.5 * psill
    c += psill
    if nugget:
        c[d == 0] += nugget
    return c


def _between(xa, ya, xb, yb):
    return np.sqrt((xa[:, None] - xb[None, :]) ** 2 + (ya[:, None] - yb[None, :]) ** 2)


def _products(xa, ya, xb, yb, psill, rng, nugget, right, left=None):
    """(C right, transposed C left) for the covariances C of two blocks, ``PAIR_ROWS`` rows of C at a time."""
    out, back = [], 0.0
    for at in range(0, len(xa), PAIR_ROWS):
        c = _covariance(_between(xa[at:at + PAIR_ROWS], ya[at:at + PAIR_ROWS], xb, yb), psill, rng, nugget)
        out.append(c @ right)
        if left is not None:
            back = back + c.T @ left[at:at + PAIR_ROWS]
    return np.concatenate(out), back


#: Points of a block of the covariance matrix. Each step solves with every block's own covariance (8 MB), which costs the cube of this number.
BLOCK_POINTS = 1024
#: Targets of a block: 8 MB for a pair with a block of points.
BLOCK_TARGETS = 512
#: Points of a group whose weights are found in one task, and the bytes of covariances that it keeps between its steps.
LOCAL_POINTS = 1 << 14
KEPT_BYTES = 192 << 20
_VECTOR = "array<double>"
_STATE = ["a0", "a1", "r0", "r1", "s0", "s1", "p0", "p1"]


def _apart(group: list[str], df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in group)


def _precondition(row: dict, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    """Solve with the block's own covariance alone."""
    x, y = np.asarray(row["x"], float), np.asarray(row["y"], float)
    c = _covariance(_between(x, y, x, y), row["psill"], row["range"], row["nugget"])
    if row["psill"] + row["nugget"] <= 0:
        return np.zeros((len(x), 2))
    return np.linalg.solve(c, np.column_stack([r0, r1]))


def _moved(i: str):
    return F.zip_with(f"s{i}", f"p{i}", lambda s, p: s + F.col(f"_b{i}") * p)


def _added(c: str):
    """Sum of a list of equally long arrays (one for each block of the group)."""
    return F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda s, a: F.zip_with(s, a, lambda x, y: x + y))


def _tiles(rows: DataFrame, group: list[str], fields: list[str], size: int) -> DataFrame:
    """(group..., block, items): rows packed by tile of a square grid over the group's box, whose mesh follows the group's
    size; a tile with more than ``size`` rows is split by hash, so blocks are bounded wherever the rows lie."""
    box = rows.groupBy(*group).agg(F.min("x").alias("_lx"), F.min("y").alias("_ly"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_w"),
                                   F.expr(f"CAST(power(2, ceil(greatest(0, log(4, count(1) / {size}.0)))) AS BIGINT)").alias("_m"))
    cell = lambda c: F.least(F.col("_m") - 1, F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"_l{c}"), "_w"), F.lit(0.0)) * F.col("_m")))
    put = salted_join(rows, box, group, fields).withColumn("_t", cell("x") * F.col("_m") + cell("y")).drop("_lx", "_ly", "_w", "_m")
    counts = put.groupBy(*group, "_t").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("_s"))
    put = salted_join(put, counts, [*group, "_t"], fields)
    block = F.shiftleft(F.col("_t"), 24) + F.pmod(F.xxhash64(*fields), F.col("_s"))
    return put.groupBy(*group, block.alias("block")).agg(F.collect_list(F.struct(*fields)).alias("items"))


def _near(asked: DataFrame, held: DataFrame, group: list[str], reach: DataFrame) -> DataFrame:
    """(group..., block, _j): blocks of ``asked`` (x, y arrays) and blocks of ``held`` whose boxes lie within the group's range.
    Beyond it the covariance is zero, so the other pairs are left out without loss; only boxes meet here."""
    def box(df, p):
        return df.select(*group, "block", *[f(c).alias(f"{p}{n}{c}") for c in "xy" for n, f in (("l", F.array_min), ("h", F.array_max))])

    a, b = box(asked, "a"), box(held, "b").withColumnRenamed("block", "_j")
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"al{c}") - F.col(f"bh{c}"), F.col(f"bl{c}") - F.col(f"ah{c}"))
    met = a.join(reach, group).join(b, group)
    return met.where(apart("x") ** 2 + apart("y") ** 2 <= (F.col("range") * (1 + 1e-9)) ** 2).select(*group, "block", "_j")


def _solver(row: dict):
    """``_precondition`` of a block as a function that can be called again and again; its factor is worked out once."""
    x, y = np.asarray(row["x"], float), np.asarray(row["y"], float)
    try:
        half = np.linalg.inv(np.linalg.cholesky(_covariance(_between(x, y, x, y), row["psill"], row["range"], row["nugget"])))
    except np.linalg.LinAlgError:
        return lambda r: _precondition(row, *r.T)
    return lambda r: half.T @ (half @ r)


def _settled(rows: list[dict], pairs: list[tuple[int, int]], tolerance: float, most: int) -> np.ndarray:
    """C a = v and C b = 1 for the blocks ``rows`` of one group, flat one after the other, by the steps of ``dual_weights``."""
    model = [rows[0][c] for c in ("psill", "range", "nugget")]
    at = np.cumsum([0, *[len(r["x"]) for r in rows]])
    own = [slice(a, b) for a, b in zip(at, at[1:])]
    x, y, v = (np.concatenate([np.asarray(r[c], float) for r in rows]) for c in ("x", "y", "v"))
    a = np.zeros((len(v), 2))
    if model[0] + model[2] <= 0:
        return a
    solvers, kept, room = [_solver(r) for r in rows], {}, KEPT_BYTES

    def tiles():
        nonlocal room
        for i, j in pairs:
            if (i, j) in kept:
                yield i, j, own[i], kept[i, j]
                continue
            whole = _covariance(_between(x[own[i]], y[own[i]], x[own[j]], y[own[j]]), *model)
            if room >= whole.nbytes:
                kept[i, j], room = whole, room - whole.nbytes
            yield i, j, own[i], whole

    def precondition(r):
        return np.concatenate([solve(r[o]) for solve, o in zip(solvers, own)])

    r = np.column_stack([v, np.ones(len(v))])
    start, past, p = (r * r).sum(0), np.zeros(2), np.zeros_like(r)
    for step in range(most + 1):
        if not ((r * r).sum(0) > tolerance * tolerance * start).any():
            return a
        if step == most:
            break
        s = precondition(r)
        rho = (r * s).sum(0)
        p = s + np.divide(rho, past, out=np.zeros(2), where=past > 0) * p
        q = np.zeros_like(p)
        for i, j, rows_of_tile, c in tiles():
            q[rows_of_tile] += c @ p[own[j]]
            if i != j:
                q[own[j]] += c.T @ p[rows_of_tile]
        pq = (p * q).sum(0)
        move = np.divide(rho, pq, out=np.zeros(2), where=pq > 0)
        a, r, past = a + move * p, r - move * q, rho
    raise RuntimeError(f"kriging weights did not settle in {most} steps")


def _local_weights(packed: DataFrame, pairs: DataFrame, group: list[str], tolerance: float, most: int, tasks: int) -> DataFrame:
    """The result of ``dual_weights`` for groups of at most ``LOCAL_POINTS`` points, each in one task."""
    def solve(blocks, met):
        rows = blocks.to_dict("records")
        place = {r["block"]: i for i, r in enumerate(rows)}
        a = _settled(rows, [(place[i], place[j]) for i, j in zip(met["block"], met["_j"])], tolerance, most)
        v, out, at = np.concatenate([np.asarray(r["v"], float) for r in rows]), [], 0
        mu = a[:, 0].sum() / a[:, 1].sum() if a[:, 1].sum() else v.mean()
        for r in rows:
            w = a[at:at + len(r["x"]), 0] - mu * a[at:at + len(r["x"]), 1]
            at += len(w)
            out.append([*[r[k] for k in group], r["block"], r["x"], r["y"], w, mu, r["psill"], r["range"], r["nugget"]])
        return pd.DataFrame(out, columns=[*group, "block", "x", "y", "w", "mu", "psill", "range", "nugget"])

    shape = f"{_apart([*group, 'block'], packed)}, x {_VECTOR}, y {_VECTOR}, w {_VECTOR}, mu double, psill double, range double, nugget double"
    dealt = [df.repartition(tasks, *group).groupBy(*group) for df in (packed, pairs)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(solve, shape)


def dual_weights(points: DataFrame, model: DataFrame, group: list[str], tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """(group..., block, x, y, w, mu, psill, range, nugget): the weights of ordinary kriging in dual form, from all
    points ``(group..., x, y, v)`` of a group, no two at one place.

    With C the covariances of the points, C a = v and C b = 1 give mu = sum(a) / sum(b) and w = a - mu b. Both
    systems are solved by conjugate gradients over blocks of neighbouring points: a product with C is a join of the block
    pairs within the range, listed once and each used for both of its blocks, and a sum, and every block's own covariance preconditions it, so a group of one block takes one step. A group stops when both
    residuals are below ``tolerance`` of their start; ``most`` steps without that are an error. Groups without a
    model or with a model of zero have w = 0 and mu = the mean of v.

    A group of at most ``LOCAL_POINTS`` points, counted first, takes all its steps in one task; the steps of larger ones are jobs."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("psill", "range", "nugget")}
    packed = _tiles(points, group, ["x", "y", "v"], BLOCK_POINTS).join(model.select(*group, *zero), group, "left")
    packed = materialise(packed.select(*group, "block", *[F.col(f"items.{c}").alias(c) for c in ("x", "y", "v")], *zero.values()), "points")
    fixed = packed.drop("v")
    near = _near(fixed, fixed, group, fixed.select(*group, "range").distinct())
    pairs = materialise(near.where("block <= _j"), "pairs")
    sizes = materialise(packed.groupBy(*group).agg(F.sum(F.size("x")).alias("_n")), "sizes")
    small, large = sizes.where(F.col("_n") <= LOCAL_POINTS).count(), sizes.where(F.col("_n") > LOCAL_POINTS).select(*group)
    tasks = min(max(3 * small, 1), 1024)
    if not large.limit(1).count():
        return _local_weights(packed, pairs, group, tolerance, most, tasks)
    local = _local_weights(packed.join(large, group, "left_anti"), pairs.join(large, group, "left_anti"), group, tolerance, most, tasks)
    return local.unionByName(_stepped_weights(*[df.join(large, group, "left_semi") for df in (packed, fixed, pairs)], group, tolerance, most))


def _stepped_weights(packed: DataFrame, fixed: DataFrame, pairs: DataFrame, group: list[str], tolerance: float, most: int) -> DataFrame:
    """The result of ``dual_weights`` for groups of any size, each step a few jobs."""
    keys = [*group, "block"]
    kinds = _apart(keys, packed)

    def start(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                v = np.asarray(row["v"], float)
                s = _precondition(row, v, np.ones(len(v)))
                none = np.zeros(len(v))
                out.append([row[k] for k in keys] + [none, none, v, np.ones(len(v)), s[:, 0], s[:, 1], none, none])
            yield pd.DataFrame(out, columns=[*keys, *_STATE])

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)

    def product(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                p, pb = (np.column_stack([np.asarray(row[f"p{i}{side}"], float) for i in "01"]) for side in ("", "b"))
                own = row["block"] == row["_j"]
                at = [np.asarray(row[c], float) for c in ("x", "y", "xb", "yb")]
                q, back = _products(*at, row["psill"], row["range"], row["nugget"], pb, None if own else p)
                for block, v in [(row["block"], q)] + ([] if own else [(row["_j"], back)]):
                    out.append([row[k] for k in group] + [block, v[:, 0].copy(), v[:, 1].copy()])
            yield pd.DataFrame(out, columns=[*keys, "q0", "q1"])

    def advance(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                new, r = {}, []
                for i in "01":
                    step = row[f"rho{i}"] / row[f"pq{i}"] if row[f"pq{i}"] > 0 else 0.0
                    new[f"a{i}"] = np.asarray(row[f"a{i}"], float) + step * np.asarray(row[f"p{i}"], float)
                    r.append(np.asarray(row[f"r{i}"], float) - step * np.asarray(row[f"q{i}"], float))
                s = _precondition(row, *r)
                new |= {"r0": r[0], "r1": r[1], "s0": s[:, 0], "s1": s[:, 1], "p0": row["p0"], "p1": row["p1"]}
                out.append([row[k] for k in keys] + [new[c] for c in _STATE])
            yield pd.DataFrame(out, columns=[*keys, *_STATE])

    def scalars(state):
        return state.groupBy(*group).agg(*[F.sum(dot(f"r{i}", f"s{i}")).alias(f"rho{i}") for i in "01"], *[F.sum(dot(f"r{i}", f"r{i}")).alias(f"rr{i}") for i in "01"])

    shape = f"{kinds}, " + ", ".join(f"{c} {_VECTOR}" for c in _STATE)
    state = materialise(packed.select(*keys, "x", "y", "v", "psill", "range", "nugget").mapInPandas(start, shape), "state")
    first = before = materialise(scalars(state), "scalars")
    limits = first.select(*group, *[F.col(f"rr{i}").alias(f"z{i}") for i in "01"])
    past = before.select(*group, *[F.lit(0.0).alias(f"old{i}") for i in "01"])
    models = fixed.select(*group, "psill", "nugget").distinct().where("psill + nugget > 0").select(*group)
    for step in range(most + 1):
        now = before.join(limits, group).join(models, group, "left_semi")
        if not now.where(" OR ".join(f"rr{i} > {tolerance * tolerance} * z{i}" for i in "01")).limit(1).count():
            break
        if step == most:
            raise RuntimeError(f"kriging weights did not settle in {most} steps")
        turn = state.join(before.join(past, group), group)
        for i in "01":
            beta = F.when(F.col(f"old{i}") > 0, F.col(f"rho{i}") / F.col(f"old{i}")).otherwise(F.lit(0.0))
            turn = turn.withColumn(f"_b{i}", beta).withColumn(f"p{i}", _moved(i))
        turn = materialise(turn.select(*keys, *_STATE, "rho0", "rho1"), "turn")
        side = fixed.join(turn.select(*keys, "p0", "p1"), keys)
        right = side.select(*group, F.col("block").alias("_j"), *[F.col(c).alias(f"{c}b") for c in ("x", "y", "p0", "p1")])
        met = side.join(pairs, keys).join(right, [*group, "_j"])
        parts = met.mapInPandas(product, f"{kinds}, q0 {_VECTOR}, q1 {_VECTOR}")
        summed = parts.groupBy(*keys).agg(*[F.collect_list(f"q{i}").alias(f"q{i}") for i in "01"])
        summed = materialise(summed.select(*keys, *[_added(f"q{i}").alias(f"q{i}") for i in "01"]), "products")
        spent = [state.written_to, turn.written_to, summed.written_to]
        turn = turn.join(summed, keys)
        pq = turn.groupBy(*group).agg(*[F.sum(dot(f"p{i}", f"q{i}")).alias(f"pq{i}") for i in "01"])
        whole = turn.join(pq, group).join(fixed.select(*keys, "x", "y", "psill", "range", "nugget"), keys)
        state = materialise(whole.mapInPandas(advance, shape), "state")
        discard(packed.sparkSession, spent)
        past = before.select(*group, *[F.col(f"rho{i}").alias(f"old{i}") for i in "01"])
        before = materialise(scalars(state), "scalars")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    sums = state.groupBy(*group).agg(F.sum(total("a0")).alias("sa"), F.sum(total("a1")).alias("sb"))
    mean = packed.groupBy(*group).agg((F.sum(total("v")) / F.sum(F.size("v"))).alias("mean"))
    mu = sums.join(mean, group).select(*group, F.coalesce(F.try_divide("sa", "sb"), "mean").alias("mu"))
    out = state.select(*keys, "a0", "a1").join(mu, group).join(fixed, keys)
    return out.select(*keys, "x", "y", F.zip_with("a0", "a1", lambda a, b: a - F.col("mu") * b).alias("w"), "mu", "psill", "range", "nugget")


def krige(observed: DataFrame, targets: DataFrame, model: DataFrame, group: list[str], target_key: str, value: str) -> DataFrame:
    """(group..., target, estimate) from all observations of the group; those at one place count by their mean.
    A target whose group has no observation gets no row; targets at one place are worked out once."""
    points = observed.where(F.col(value).isNotNull()).groupBy(*group, "x", "y").agg(F.avg(F.col(value).cast("double")).alias("v"))
    weights = materialise(dual_weights(points, model, group), "weights")
    asked = targets.select(*group, F.col(target_key).alias("_key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    asked = materialise(asked.join(weights.select(*group).distinct(), group, "left_semi"), "asked")
    places = _tiles(asked.where("x IS NOT NULL AND y IS NOT NULL").select(*group, "x", "y").distinct(), group, ["x", "y"], BLOCK_TARGETS)
    places = materialise(places.select(*group, "block", *[F.col(f"items.{c}").alias(c) for c in ("x", "y")]), "targets")
    reach = weights.groupBy(*group).agg(F.first("range").alias("range"), F.first("mu").alias("mu"))
    pairs = _near(places, weights, group, reach.drop("mu"))

    @pandas_udf(_VECTOR)
    def effect(tx: pd.Series, ty: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, psill: pd.Series, rng: pd.Series, nugget: pd.Series) -> pd.Series:
        out = []
        for a, b, xs, ys, ws, p, r, n in zip(tx, ty, x, y, w, psill, rng, nugget):
            a, b, xs, ys, ws = (np.asarray(v, float) for v in (a, b, xs, ys, ws))
            out.append(_products(a, b, xs, ys, p, r, n, ws)[0])
        return pd.Series(out)

    held = weights.select(*group, F.col("block").alias("_j"), F.col("x").alias("xs"), F.col("y").alias("ys"), "w", "psill", "range", "nugget")
    met = places.join(pairs, [*group, "block"]).join(held, [*group, "_j"])
    parts = met.select(*group, "block", effect("x", "y", "xs", "ys", "w", "psill", "range", "nugget").alias("e"))
    parts = parts.groupBy(*group, "block").agg(F.collect_list("e").alias("e")).select(*group, "block", _added("e").alias("e"))
    each = places.join(parts, [*group, "block"]).select(*group, F.explode(F.arrays_zip("x", "y", "e")).alias("_z")).select(*group, "_z.*")
    out = asked.join(each, [*group, "x", "y"], "left").join(reach.drop("range"), group)
    return out.select(*group, F.col("_key").alias(target_key), (F.col("mu") + F.coalesce("e", F.lit(0.0))).alias("estimate"))


def fill_by_kriging(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """Fill null values per group; observed rows, and groups without any observation, stay as they are."""
    df = materialise(df, "gaps")  # read for the variogram, the weights, the targets and the result
    seen = df.where(F.col(value).isNotNull())
    model = spherical_fit(empirical_variogram(seen, group, key, value), group)
    est = krige(seen, df.where(F.col(value).isNull()), model, group, key, value)
    return df.join(est.select(*group, key, "estimate"), [*group, key], "left").withColumn(
        value, F.coalesce(F.col(value), F.col("estimate"))).drop("estimate")


def surface_targets(df: DataFrame, group: list[str], grid: int = 100) -> DataFrame:
    """grid x grid points over the bounding box of each group, numbered row by row."""
    box = df.groupBy(*group).agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    cells = box.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))))
    step = lambda lo, hi, i: F.col(lo) + (F.col(hi) - F.col(lo)) * i / (grid - 1)
    return cells.select(*group, "cell", step("lx", "hx", F.col("cell") % grid).alias("x"),
                        step("ly", "hy", F.floor(F.col("cell") / grid)).alias("y"))
