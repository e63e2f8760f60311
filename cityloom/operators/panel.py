"""Calendar completion, monthly aggregation and spreading of annual values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_name
from .scale import dense_index, exact_quantiles, group_median


def all_months(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Every distinct key with months 1..12."""
    return df.select(*keys).distinct().withColumn(month, F.explode(F.sequence(F.lit(1), F.lit(12))))


def complete_months(df: DataFrame, keys: list[str], month: str, value: str, how: str = "median") -> DataFrame:
    """All key x month cells. ``how='sum'`` fills gaps with 0, ``how='median'`` leaves them null."""
    if how == "sum":
        facts = df.groupBy(*keys, month).agg(F.sum(value).alias(value))
    else:
        facts = group_median(df, [*keys, month], value, value)
    out = all_months(df, keys, month).join(facts, [*keys, month], "left")
    return out.na.fill(0, [value]) if how == "sum" else out


def incident_rollup(df: DataFrame, day: str, place: str, amount: str, name: str) -> DataFrame:
    """Daily incident rows to city x month sums; unreadable dates and amounts are dropped."""
    rows = df.select(
        clean_name(F.col(place)).alias("city"),
        F.try_to_timestamp(F.col(day)).alias("_ts"),
        F.trim(F.col(amount)).try_cast("bigint").alias("_n"),
    ).where("_ts is not null and _n is not null")
    return rows.groupBy("city", F.year("_ts").alias("year"), F.month("_ts").alias("month")).agg(
        F.sum("_n").alias(name))


def resample_monthly_median(df: DataFrame, day: str, value: str) -> DataFrame:
    """Month median with the month-end label, and year and month taken from the date."""
    monthly = df.where(F.col(day).isNotNull()).withColumn("month_start", F.to_date(F.trunc(day, "MM")))
    out = group_median(monthly, ["month_start"], value, value)
    return out.select(
        F.last_day("month_start").alias("month_end"),
        F.year("month_start").alias("year"), F.month("month_start").alias("month"), value)


def lag_features(df: DataFrame, keys: list[str], order: str, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Lags inside each city; rows without a full history are dropped. The input holds one row
    per city and period, so a partition is as long as the calendar."""
    w = W.partitionBy(*keys).orderBy(order)
    out = df.withColumns({new: F.lag(c, k).over(w) for new, (c, k) in lags.items()})
    return out.na.drop(subset=list(lags))


def pooled_lag_features(df: DataFrame, order: list, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Lags over the whole table in a unique order, across city borders: dense row numbers and an
    equi-join per lag distance instead of one global window."""
    rows = dense_index(df, order)
    out = rows
    for k in sorted({k for _, k in lags.values()}):
        cols = {new: c for new, (c, d) in lags.items() if d == k}
        shifted = rows.select((F.col("idx") + k).alias("idx"), *[F.col(c).alias(n) for n, c in cols.items()])
        out = out.join(shifted, "idx")
    return out.na.drop(subset=list(lags))


def spread_over_months(annual: DataFrame, pattern: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Annual values times a 12-month pattern ``(on..., month, weight)``."""
    out = annual.join(pattern, on)
    return out.withColumns({v: F.col(v) * F.col("weight") for v in values}).drop("weight")


def repeat_over_months(annual: DataFrame, month: str = "month") -> DataFrame:
    """The same annual value in all 12 months."""
    return annual.withColumn(month, F.explode(F.sequence(F.lit(1), F.lit(12))))


def reconcile(parts: DataFrame, totals: DataFrame, keys: list[str], part: str, total: str,
              tolerance: float = 1e-9) -> DataFrame:
    """Do the parts of each key add back to its total?"""
    summed = parts.groupBy(*keys).agg(F.sum(part).alias("parts_sum"))
    return totals.join(summed, keys, "left").withColumn(
        "matches", F.abs(F.col("parts_sum") - F.col(total)) <= tolerance * F.abs(F.col(total)))


def time_bins(df: DataFrame, ts: str, value: str, bins: int = 7) -> DataFrame:
    """Equal-width time bins: right-closed edges, the lowest edge open below the minimum."""
    secs = df.select(F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_s"),
                     F.col(ts).alias("_ts"), F.col(value).alias("_v"))
    lim = secs.agg(F.struct(F.min("_s").alias("lo"), F.max("_s").alias("hi")).alias("l")).scalar()
    cut = secs.withColumn("_l", lim)
    pos = (F.col("_s") - F.col("_l.lo")) / F.nullif((F.col("_l.hi") - F.col("_l.lo")) / bins, F.lit(0.0))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.ceil(F.coalesce(pos, F.lit(0.0))) - 1).cast("int")))
    return cut.withColumn("bin", bin_).groupBy("bin").agg(
        F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean_value"))


def global_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, minimum, maximum of one column."""
    basic = df.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    med = exact_quantiles(df, [], value, [0.5], ["median"])
    return basic.withColumn("median", med.scalar())
