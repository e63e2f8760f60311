"""The data behind the figures: histograms, boxes, bars and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import exact_quantiles, salted_join


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width counts; the maximum falls into the last bin."""
    lim = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("l")).scalar()
    rows = df.select(F.col(value).alias("_v")).where("_v is not null").withColumn("_l", lim)
    width = F.nullif((F.col("_l.hi") - F.col("_l.lo")) / bins, F.lit(0.0))
    bin_ = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("_v") - F.col("_l.lo")) / width), F.lit(0)).cast("int"))
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, keys: list[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, the outermost values within ``whisker`` box lengths, and the outlier count."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    v, reach = F.col(value), whisker * (F.col("q3") - F.col("q1"))
    rows = salted_join(df.select(*keys, value).where(v.isNotNull()), q, keys, [value])
    low, high = v >= F.col("q1") - reach, v <= F.col("q3") + reach
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(low, v)).alias("low_whisker"), F.max(F.when(high, v)).alias("high_whisker"),
        F.count_if(~(low & high)).alias("n_outliers"))


def city_bars(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One bar height (median) per city and variable."""
    long = df.select(key, *values).unpivot([key], values, "variable", "value")
    med = exact_quantiles(long, [key, "variable"], "value", [0.5], ["bar"])
    return med.groupBy(key).agg(*[F.max(F.when(F.col("variable") == v, F.col("bar"))).alias(v) for v in values])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of columns in one pass, one row per pair."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"))
                            for a, b in pairs]).alias("p"))
    return wide.select(F.inline("p"))
