"""Checked queries: sources and sinks. Each writes a given table to the shared folder in the
raw form and reads it back through the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ATTRACTIONS
from ..functions.text import clean_name, parse_decimal_comma
from ..operators.scale import scratch_path
from ..sources import readers, schemas, workbooks
from .registry import query
from .tables import with_roles


@query("A1_csv_scan", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def csv_scan(t):
    path = scratch_path(t.spark, "orders-csv")
    t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).write.csv(path, header=True)
    return readers.read_csv(t.spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                           "o_totalprice double, day string")


@query("A2_spreadsheet_feed", """SELECT CAST(s_suppkey AS VARCHAR) AS code, lower(replace(s_name,'#','')) AS department,
  s_acctbal AS value FROM supplier""")
def spreadsheet_feed(t):
    path = scratch_path(t.spark, "gdp-csv")
    t.supplier.select(F.col("s_suppkey").alias("CÓDIGO"), F.col("s_name").alias("DEPARTAMENTO"),
                      F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("VALOR (unidades)")
                      ).write.csv(path, header=True)
    raw = readers.read_csv(t.spark, path, schemas.GDP)
    return raw.select(F.col("CÓDIGO").alias("code"), clean_name(F.col("DEPARTAMENTO")).alias("department"),
                      parse_decimal_comma(F.col("VALOR (unidades)")).alias("value"))


@query("A2_workbook", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, o_totalprice FROM orders""")
def workbook(t):
    """Orders as workbooks of up to 4 096 keys each, read back from their bytes."""
    names = ["o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"]
    books = workbooks.encode(t.orders.withColumn("block", F.expr("o_orderkey div 4096")), ["block"], ["o_orderkey"], names)
    rows = workbooks.table(workbooks.decode(books.select(F.concat(F.lit("orders-"), "block").alias("path"), "content"), "data"), names)
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.substring("o_orderdate", 1, 10).alias("day"), "o_orderpriority",
                       F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("A3_promote_header", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS "FECHA HECHO", o_orderpriority AS "MUNICIPIO",
  CAST(o_custkey AS VARCHAR) AS "CANTIDAD" FROM orders""")
def promote_header(t):
    path = scratch_path(t.spark, "crime-csv")
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.col("o_custkey").cast("string"))
    header = t.spark.createDataFrame([("FECHA HECHO ", "MUNICIPIO", "CANTIDAD ")], "a string, b string, c string")
    header.union(rows).write.csv(path, header=False, ignoreTrailingWhiteSpace=False)
    return readers.read_headerless(t.spark, path, schemas.CRIME_HEADER)


def square_features(t):
    """One square outline per customer place, as GeoJSON features, one per line."""
    lo, hi = F.col("lng") - 0.25, F.col("lng") + 0.25
    bo, to = F.col("lat") - 0.25, F.col("lat") + 0.25
    ring = F.array(F.array(lo, bo), F.array(hi, bo), F.array(hi, to), F.array(lo, to), F.array(lo, bo))
    return t.places.select(F.to_json(F.struct(
        F.struct(F.col("place_id"), F.lit("Peñol (CT)").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))


@query("A4_geojson_scan", with_roles("places") + """, c AS (SELECT place_id, lng-0.25 AS l, lng+0.25 AS r, lat-0.25 AS b, lat+0.25 AS u FROM places)
SELECT place_id, 'penol' AS name, 0 AS ring_id, s.seg_id, round(CASE s.seg_id WHEN 1 THEN r WHEN 2 THEN r ELSE l END,6) AS x1,
  round(CASE s.seg_id WHEN 2 THEN u WHEN 3 THEN u ELSE b END,6) AS y1,
  round(CASE s.seg_id WHEN 0 THEN r WHEN 1 THEN r ELSE l END,6) AS x2,
  round(CASE s.seg_id WHEN 1 THEN u WHEN 2 THEN u ELSE b END,6) AS y2
FROM c, (VALUES (0),(1),(2),(3)) s(seg_id)""")
def geojson_scan(t):
    path = scratch_path(t.spark, "outlines")
    square_features(t).write.text(path)
    shapes = readers.read_features(t.spark, path, "place_id:bigint, name:string")
    out = readers.segments(shapes.withColumn("name", clean_name(F.col("name"))), ["place_id", "name"])
    return out.withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@query("A5_road_feed", """SELECT event_id AS road_id, 0 AS seg_id, abs(value - ((event_id*7)%100)) AS length,
  round(value, 6) AS x1, CAST(user_id AS DOUBLE) AS y1, round(value+1, 6) AS x2, CAST(user_id AS DOUBLE) AS y2 FROM events""")
def road_feed(t):
    path = scratch_path(t.spark, "roads")
    x, y = F.col("value"), F.col("user_id").cast("double")
    line = F.array(F.array(x, y), F.array(x + 1, y))
    t.events.where("value is not null").select(F.to_json(F.struct(
        F.struct(F.col("event_id").alias("road_id"), x.alias("distanciai"),
                 ((F.col("event_id") * 7) % 100).cast("double").alias("distanciaf")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))).alias("value")
    ).write.text(path)
    roads = readers.read_roads(t.spark, path)
    out = readers.segments(roads, ["road_id", "length"]).drop("ring_id")
    return out.withColumns({c: F.round(c, 6) for c in ("x1", "x2")})


@query("A6_pixel_feed", """SELECT year(l_shipdate) AS year, l_suppkey%25 AS city_id, count(*) AS n_pixels, sum(l_linenumber) AS scenes
  FROM lineitem WHERE year(l_shipdate) IN (1996,1997) AND l_linenumber>=3 GROUP BY ALL""")
def pixel_feed(t):
    path = scratch_path(t.spark, "pixels")
    px = t.lineitem.select(F.year("l_shipdate").alias("year"), (F.col("l_suppkey") % 25).alias("city_id"),
                           F.col("l_linenumber").alias("scene"), F.col("l_partkey").alias("px"))
    px.write.partitionBy("year").parquet(path)
    kept = readers.read_pixels(t.spark, path).where("year in (1996, 1997) and scene >= 3")
    return kept.groupBy("year", "city_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("scene").alias("scenes"))


def attraction_struct():
    """The literal dimension as one array of structs: a constant that needs no join."""
    return F.array(*[F.struct(F.lit(n).alias("attraction"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng"),
                              F.lit(rev).alias("reviews"), F.lit(rat).alias("rating"))
                     for n, lat, lng, rev, rat in ATTRACTIONS])


def attractions(spark):
    return spark.createDataFrame(list(ATTRACTIONS), "attraction string, lat double, lng double, reviews bigint, rating double")


ATTRACTION_VALUES = ", ".join(
    f"('{n}', {lat!r}::DOUBLE, {lng!r}::DOUBLE, {rev}, {rat!r}::DOUBLE)" for n, lat, lng, rev, rat in ATTRACTIONS)


@query("A7_literal_dim", with_roles("places") + f""", a(attraction, alat, alng, reviews, rating) AS (VALUES {ATTRACTION_VALUES})
SELECT attraction, reviews, rating, count(*) AS places_within_2_degrees FROM a JOIN places
  ON abs(lat-alat) <= 2 AND abs(lng-alng) <= 2 GROUP BY ALL""")
def literal_dim(t):
    near = F.filter(attraction_struct(), lambda a: (F.abs(F.col("lat") - a["lat"]) <= 2) & (F.abs(F.col("lng") - a["lng"]) <= 2))
    hits = t.places.select(F.explode(near).alias("a"))
    return hits.groupBy("a.attraction", "a.reviews", "a.rating").agg(F.count(F.lit(1)).alias("places_within_2_degrees"))


@query("A8_panel_sink", with_roles("panel") + " SELECT city_id, year, month, visitors, gdp, crimes FROM panel")
def panel_sink(t):
    path = scratch_path(t.spark, "panel")
    readers.write_panel(t.panel.select("city_id", "year", "month", "visitors", "gdp", "crimes"), path)
    return t.spark.read.parquet(path)
