"""Row filters, audits and simple column features."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALWAYS_KEPT_CITIES, DEFLATION_PCT


def any_null(columns: list[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=subset)


def split_missing(df: DataFrame, subset: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows with at least one null), both from one flag."""
    flag = any_null(subset)
    return df.where(~flag), df.where(flag)


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its null count, all from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_null")


def promote_header(df: DataFrame, names: list[str]) -> DataFrame:
    """Headerless rows whose header arrives as a data row: name the columns and drop that row.

    Header cells may carry stray blanks, so they are compared trimmed."""
    named = df.toDF(*names)
    is_header = reduce(lambda a, b: a & b, [F.trim(F.col(n)) == F.lit(n) for n in names])
    return named.where(~F.coalesce(is_header, F.lit(False)))


def known_cities(cities: DataFrame, visitors: DataFrame, extra=ALWAYS_KEPT_CITIES) -> DataFrame:
    """Cities present in both lists, plus the ones always kept."""
    spark = cities.sparkSession
    fixed = spark.createDataFrame([(c,) for c in extra], "city string")
    return cities.select("city").intersect(visitors.select("city")).union(fixed).distinct()


def keep_known_cities(df: DataFrame, known: DataFrame) -> DataFrame:
    return df.join(known, "city", "left_semi")


def deflate(df: DataFrame, columns: dict[str, str], rates=DEFLATION_PCT) -> DataFrame:
    """Divide each spend column by one plus the price change of its item."""
    return df.withColumns({c: F.col(c) / (1 + F.lit(rates[item]) / 100) for c, item in columns.items()})


def align_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select by name and rename; ``mapping`` is new name -> source column."""
    return df.select(*[F.col(src).alias(new) for new, src in mapping.items()])


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
