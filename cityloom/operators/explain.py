"""Permutation importance, local surrogates, partial dependence, predicted against actual."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .modelling import regression_metrics
from .scale import dense_index, exact_quantiles, hash_bucket

Predict = Callable[[DataFrame], DataFrame]


def _number(text: str, seed: int) -> int:
    return int(hashlib.md5(f"{text}:{seed}".encode()).hexdigest()[:15], 16)


def affine_shuffles(n: int, count: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) pairs for which idx -> (a*idx + b) mod n is a permutation of 0..n-1: ``a`` is the
    first hashed candidate without a common factor with n."""
    out = []
    for i in range(count):
        tries = (_number(f"{i}:{j}", seed) % max(n - 1, 1) + 1 for j in itertools.count())
        out.append((next(a for a in tries if math.gcd(a, n) == 1), _number(f"{i}:b", seed) % max(n, 1)))
    return out


def permutation_importance(df: DataFrame, key: str, columns: list[str], target: str, predict: Predict, repeats: int = 100,
                           seed: int = 42, buckets: int = 1024) -> DataFrame:
    """(feature, repeat, loss): drop in R² when one column is shuffled.

    Rows get dense numbers in hash order; a shuffle is an affine map of the numbers. Each donor sends
    its one value to the number that takes it, by the inverse map, so only (number, feature, repeat,
    value) is multiplied and shuffled, the rows themselves once."""
    rows = dense_index(df.select(key, target, *columns), [hash_bucket(F.col(key), seed, buckets), F.col(key)])
    n = rows.count()
    base = regression_metrics(predict(rows), target, "prediction").first()["r2"]
    maps = [(pow(a, -1, max(n, 1)), -pow(a, -1, max(n, 1)) * b % max(n, 1)) for a, b in affine_shuffles(n, len(columns) * repeats, seed)]
    plan = [F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat"), F.lit(a).cast("decimal(38,0)").alias("a"), F.lit(b).alias("b"))
            for (c, r), (a, b) in zip(((c, r) for c in columns for r in range(repeats)), maps)]
    donors = rows.select("idx", *columns).withColumn("_p", F.explode(F.array(*plan)))
    value = F.coalesce(*[F.when(F.col("_p.feature") == c, F.col(c).cast("double")) for c in columns])
    donors = donors.select(((F.col("_p.a") * F.col("idx") + F.col("_p.b")) % max(n, 1)).cast("long").alias("idx"), F.col("_p.feature").alias("feature"),
                           F.col("_p.repeat").alias("repeat"), value.alias("_v"))
    mixed = rows.join(donors, "idx").select(target, "feature", "repeat", *[F.when(F.col("feature") == c, F.col("_v")).otherwise(F.col(c)).alias(c) for c in columns])
    scores = regression_metrics(predict(mixed), target, "prediction", ["feature", "repeat"])
    return scores.select("feature", "repeat", (F.lit(float(base)) - F.col("r2")).alias("loss"))


def importance_boxes(losses: DataFrame) -> DataFrame:
    """Quartiles and extremes of the loss per feature."""
    return losses.groupBy("feature").agg(F.min("loss").alias("lowest"), *[
        F.percentile("loss", p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.max("loss").alias("highest"))


def partial_dependence(df: DataFrame, columns: list[str], grids: dict[str, tuple[float, float, int]], predict: Predict) -> DataFrame:
    """(feature, value, mean_prediction) over evenly spaced grids ``(first, last, count)``; all
    features in one pass over the data."""
    points = [F.struct(F.lit(c).alias("feature"), F.lit(float(v)).alias("value")) for c, (lo, hi, n) in grids.items() for v in np.linspace(lo, hi, n)]
    copies = df.select(*columns, F.explode(F.array(*points)).alias("_g"))
    moved = copies.select("_g", *[F.when(F.col("_g.feature") == c, F.col("_g.value")).otherwise(F.col(c)).alias(c) if c in grids else F.col(c) for c in columns])
    return predict(moved).groupBy(F.col("_g.feature").alias("feature"), F.col("_g.value").alias("value")).agg(F.avg("prediction").alias("mean_prediction"))


def quartile_bins(train: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Cut points, and per bin the share, mean, deviation and range of each column."""
    out = {}
    long = train.select(*columns).unpivot([], columns, "c", "v")
    cuts = {r["c"]: (r["q1"], r["q2"], r["q3"]) for r in exact_quantiles(long, ["c"], "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"]).collect()}
    cut_map = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(float(q)) for q in cuts[c]]))])
    binned = long.withColumn("b", F.size(F.filter(F.element_at(cut_map, F.col("c")), lambda q: F.col("v") > q)))
    rows = binned.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
                                        F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    for c in columns:
        out[c] = {"cuts": cuts[c], "bins": sorted((r["b"], r["n"], r["m"], r["s"], r["lo"], r["hi"]) for r in rows if r["c"] == c)}
    return out


def _unit(*parts) -> Column:
    """A number in (0, 1) from a hash of the parts: the same draw whatever the partitioning."""
    text = F.concat_ws(":", *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def lime(instances: DataFrame, key: str, columns: list[str], bins: dict[str, dict], predict: Predict, samples: int = 5000,
         seed: int = 42, alpha: float = 1.0) -> DataFrame:
    """(instance, feature, weight): a weighted ridge surrogate around each instance.

    Samples draw a quartile bin per feature by its share, then a clipped normal inside it; the
    surrogate sees 'same bin as the instance' indicators, weighted by an exponential kernel of
    width 0.75 * sqrt(number of features)."""
    drawn = instances.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_i_{c}") for c in columns]).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    first = F.col("_s") == 0
    for c in columns:
        info = bins[c]
        total, run, at = sum(b[1] for b in info["bins"]), 0.0, []
        for b, n, m, s, lo, hi in info["bins"]:
            run += n / total
            at.append((run, b, m, s or 0.0, lo, hi))
        drawn = drawn.withColumns({f"_{t}": _unit(F.col("_id"), F.col("_s"), f"{c}{t}{seed}") for t in "uvw"})
        u, normal = F.col("_u"), F.sqrt(-2 * F.log("_v")) * F.cos(2 * math.pi * F.col("_w"))

        def choose(j):
            out = F.lit(float(at[-1][j]))
            for row in reversed(at[:-1]):
                out = F.when(u < row[0], F.lit(float(row[j]))).otherwise(out)
            return out

        own = F.size(F.filter(F.array(*[F.lit(float(q)) for q in info["cuts"]]), lambda q: F.col(f"_i_{c}") > q))
        value = F.least(choose(5), F.greatest(choose(4), choose(2) + choose(3) * normal))
        drawn = drawn.withColumn(c, F.when(first, F.col(f"_i_{c}")).otherwise(value)).withColumn(
            f"_b_{c}", F.when(first | (choose(1) == own), 1.0).otherwise(0.0)).drop("_u", "_v", "_w")
    scored = predict(drawn)
    width = 0.75 * math.sqrt(len(columns))
    differ = sum((1.0 - F.col(f"_b_{c}") for c in columns), F.lit(0.0))
    scored = scored.withColumn("_w", F.sqrt(F.exp(-differ / (width * width))))
    names = ["_one", *[f"_b_{c}" for c in columns]]
    cols = {"_one": F.lit(1.0), **{n: F.col(n) for n in names[1:]}}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = scored.groupBy("_id").agg(
        F.array(*[F.sum(F.col("_w") * cols[a] * cols[b]) for a, b in pairs]).alias("xx"),
        F.array(*[F.sum(F.col("_w") * cols[a] * F.col("prediction")) for a in names]).alias("xy"))

    def solve(batches):
        import pandas as pd

        k = len(names)
        for pdf in batches:
            rows = []
            for i, xx, xy in zip(pdf["_id"], pdf["xx"], pdf["xy"]):
                m = np.zeros((k, k))
                m[np.triu_indices(k)] = xx
                m = m + np.triu(m, 1).T
                m[np.arange(1, k), np.arange(1, k)] += alpha
                beta = np.linalg.lstsq(m, np.asarray(xy, dtype=float), rcond=None)[0]
                rows += [(i, c, float(b)) for c, b in zip(["intercept", *columns], beta)]
            yield pd.DataFrame(rows, columns=["instance", "feature", "weight"])

    kind = dict(instances.dtypes)[key]
    return sums.mapInPandas(solve, f"instance {kind}, feature string, weight double")


def predicted_vs_actual(df: DataFrame, key: list[str], y: str, pred: str = "prediction") -> DataFrame:
    return df.select(*key, F.col(y).alias("actual"), F.col(pred).alias("predicted"))
