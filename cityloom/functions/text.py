"""Name cleaning and parsing of text fields, all as built-in column expressions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import CITY_ALIASES, MONTHS_EN, MONTHS_ES, accent_table

_ACCENTS_FROM, _ACCENTS_TO = accent_table()


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTS_FROM, _ACCENTS_TO)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def clean_name(c: Column, aliases: dict[str, str] | None = CITY_ALIASES) -> Column:
    """Lower case, no blanks, no punctuation, no accents, no trailing ``ct``, aliases resolved.

    Aliases are looked up last, so accented spellings resolve in the same pass."""
    c = F.replace(F.lower(c), F.lit(" "), F.lit(""))
    c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    c = F.regexp_replace(strip_accents(c), "ct$", "")
    if aliases:
        c = F.coalesce(F.element_at(literal_map(aliases), c), c)
    return c


def normalize_name(df: DataFrame, column: str, name: str, aliases=CITY_ALIASES) -> DataFrame:
    """Clean ``column`` and rename it to ``name``; an absent column leaves the input unchanged."""
    if column not in df.columns:
        warnings.warn(f"column {column} is not in the DataFrame", stacklevel=2)
        return df
    return df.withColumn(column, clean_name(F.col(column), aliases)).withColumnRenamed(column, name)


def fix_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace whole names by an alias dimension ``(alias, canonical)``; unknown names stay."""
    dim = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = df.join(dim, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def month_number(c: Column) -> Column:
    """English month name to 1..12; anything else is null."""
    return F.element_at(literal_map({m: i for i, m in enumerate(MONTHS_EN, 1)}), c)


def month_name(c: Column) -> Column:
    """1..12 to the English month name; anything else is null."""
    return F.element_at(literal_map(dict(enumerate(MONTHS_EN, 1))), c.cast("int"))


def month_to_english(c: Column) -> Column:
    """Spanish month name to English; anything else is null."""
    return F.element_at(literal_map(dict(zip(MONTHS_ES, MONTHS_EN))), c)


def parse_decimal_comma(c: Column) -> Column:
    """``'12,5'`` to 12.5; text that is no number becomes null."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def parse_point(c: Column) -> tuple[Column, Column]:
    """``'(lat, lon)'`` to a latitude and a longitude column."""
    parts = F.split(F.btrim(c, F.lit("()")), ",")
    return (
        F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double"),
        F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double"),
    )


def period_key(month: Column, year: Column) -> Column:
    """``M-YYYY``."""
    return F.concat_ws("-", month.cast("int").cast("string"), year.cast("int").cast("string"))


def parse_period(c: Column) -> Column:
    """``M-YYYY`` to the first day of the month."""
    return F.to_date(c, "M-yyyy")
