"""Readers for delimited tables, GeoJSON shapes, roads and pixel scenes; the panel writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import promote_header


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def read_headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Delimited rows of text in which a header row sits among the data."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return promote_header(spark.read.schema(schema).csv(path, header=False), names)


def read_features(spark: SparkSession, path: str, properties: str, collection: bool = False) -> DataFrame:
    """GeoJSON features with declared properties. ``collection=True`` reads whole
    FeatureCollection documents; otherwise each line holds one feature and files split."""
    feature = f"properties struct<{properties}>, geometry struct<type:string, coordinates:string>"
    if collection:
        schema = f"features array<struct<{feature}>>"
        raw = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("features"))
    else:
        raw = spark.read.schema(feature).json(path)
    return raw.select("properties.*", "geometry")


def geometry_rings(geometry: Column) -> Column:
    """All rings or lines of a geometry as ``array<array<position>>``, whatever its type."""
    text, kind = geometry["coordinates"], geometry["type"]
    line = F.from_json(text, "array<array<double>>")
    poly = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    return (F.when(kind == "LineString", F.array(line))
            .when(kind.isin("Polygon", "MultiLineString"), poly)
            .when(kind == "MultiPolygon", multi))


def segments(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """One row per segment ``(keys..., ring_id, seg_id, x1, y1, x2, y2)`` in ring order."""
    rings = df.select(*keys, F.posexplode(geometry_rings(F.col(geometry))).alias("ring_id", "_ring"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("_ring") - 2),
        lambda i: F.struct(i.alias("seg_id"), F.get(F.get("_ring", i), F.lit(0)).alias("x1"),
                           F.get(F.get("_ring", i), F.lit(1)).alias("y1"),
                           F.get(F.get("_ring", i + 1), F.lit(0)).alias("x2"),
                           F.get(F.get("_ring", i + 1), F.lit(1)).alias("y2")))
    return rings.where(F.size("_ring") >= 2).select(*keys, "ring_id", F.inline(pairs))


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """Road lines with chainage; ``length`` is the absolute chainage difference."""
    roads = read_features(spark, path, "road_id:bigint, distanciai:double, distanciaf:double")
    return roads.withColumn("length", F.abs(F.col("distanciaf") - F.col("distanciai")))


def read_pixels(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Pixel rows stored by year; filters on ``year`` prune folders, others reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_panel(df: DataFrame, path: str, year: str = "year", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(year).parquet(path)


def write_panel_csv(df: DataFrame, path: str, names: dict[str, str]) -> None:
    """Text export under the published column names."""
    df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns]).write.csv(path, header=True)
