"""Seasonal patterns per series: one row with a 12-element array, smoothed without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as S


def month_arrays(df: DataFrame, keys: list[str], month: str, value: str, n: int = 12) -> DataFrame:
    """(keys, trend): one slot per month, missing months count 0."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(month) == m, F.col(value))).alias(f"_m{m}") for m in range(1, n + 1)]
    ).select(*keys, F.array(*[F.coalesce(F.col(f"_m{m}"), F.lit(0)).cast("double") for m in range(1, n + 1)]).alias("trend"))


def lowess(df: DataFrame, column: str, out: str, frac: float = 0.4, robust: int = 3) -> DataFrame:
    """Local linear smoother over equally spaced positions, with ``robust`` bisquare re-weights."""
    return df.withColumn(out, S.lowess_udf(frac, robust)(F.col(column)))


def seasonal_pattern(df: DataFrame, keys: list[str], month: str, value: str, robust: int = 3) -> DataFrame:
    """(keys, month, weight): shares + fixed noise, floored, smoothed, scaled to sum 1."""
    arrays = month_arrays(df, keys, month, value).withColumn("_noisy", S.noisy_shares(F.col("trend")))
    smooth = lowess(arrays, "_noisy", "_smooth", robust=robust).withColumn("_w", S.shares(F.col("_smooth")))
    return smooth.select(*keys, F.posexplode("_w").alias("_p", "weight")).select(
        *keys, (F.col("_p") + 1).alias("month"), "weight")


def explode_array(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("_p", name)).select(
        *keys, (F.col("_p") + 1).alias("month"), name)
