"""The given tables, and the domain roles they play (cities, arrivals, stations, pixels...)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import project_utm
from ..operators.scale import materialise


class Tables:
    """Lazy access to one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # -- roles ---------------------------------------------------------------------------------

    @cached_property
    def cities(self) -> DataFrame:
        """One row per city: nation, its region as department, coordinates from the key."""
        n, r = self.nation, self.region
        k = F.col("n_nationkey")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            k.alias("city_id"), F.lower("n_name").alias("city"), F.lower("r_name").alias("department"),
            ((k * 37) % 17 - 4).cast("double").alias("lat"),
            ((k * 53) % 13 - 80).cast("double").alias("lng"))

    @cached_property
    def arrivals(self) -> DataFrame:
        """One row per arrival: an order placed from a city in a month."""
        o, c = self.orders, self.customer
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("c_nationkey").alias("city_id"), F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("amount"),
            F.col("o_orderkey").alias("arrival_id"))

    @cached_property
    def incidents(self) -> DataFrame:
        """Returned lines by supplier city and ship month."""
        l, s = self.lineitem, self.supplier
        return l.where("l_returnflag = 'R'").join(s, l.l_suppkey == s.s_suppkey).select(
            F.col("s_nationkey").alias("city_id"), F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("quantity"))

    @cached_property
    def entry_points(self) -> DataFrame:
        """Suppliers as entry points; the weight is what arrived through them."""
        w = self.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("weight"))
        return self.supplier_points.join(w, F.col("l_suppkey") == F.col("point_id")).select("point_id", "lat", "lng", "weight")

    @cached_property
    def supplier_points(self) -> DataFrame:
        """Where the entry points are, without what arrived through them."""
        k = F.col("s_suppkey")
        return self.supplier.select(
            k.alias("point_id"),
            (((k * 41) % 1700) / 100.0 - 3.995).alias("lat"),
            (((k * 29) % 1300) / 100.0 - 79.995).alias("lng"))

    @cached_property
    def places(self) -> DataFrame:
        """Customers as a large set of located cities."""
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("place_id"), F.col("c_nationkey").alias("city_id"),
            (((k * 37) % 1700) / 100.0 - 3.997).alias("lat"),
            (((k * 53) % 1300) / 100.0 - 79.993).alias("lng"))

    @cached_property
    def readings(self) -> DataFrame:
        """Station readings: event values by station and day, located by the station key."""
        k = F.col("user_id")
        return self.events.select(
            k.alias("station_id"), F.dayofmonth("ts").alias("day"), F.col("value"),
            (((k * 37) % 170) * 10000.0).alias("x"), (((k * 53) % 130) * 10000.0 + (k % 7) * 1000.0).alias("y"))

    @cached_property
    def panel(self) -> DataFrame:
        """City x month facts used by the models: arrivals, amounts, incidents, GDP and spend."""
        facts = self.arrivals.groupBy("city_id", "year", "month").agg(
            F.count(F.lit(1)).cast("double").alias("visitors"),
            F.round(F.sum("amount"), 2).alias("gdp"),
            F.round(F.max("amount"), 2).alias("trip_spend"),
            F.round(F.min("amount"), 2).alias("daily_spend"))
        bad = self.incidents.groupBy("city_id", "year", "month").agg(
            F.sum("quantity").alias("crimes"), F.count(F.lit(1)).cast("double").alias("thefts"))
        return (facts.join(bad, ["city_id", "year", "month"], "left").na.fill(0.0, ["crimes", "thefts"])
                .withColumn("period", F.col("year") * 12 + F.col("month") - 1))

    @cached_property
    def facts(self) -> DataFrame:
        """The panel, joined once and written: models read it many times."""
        return materialise(self.panel, "panel")


# ANSI SQL for the same roles, as common table expressions for the checking engine.
SQL = {
    "cities": """cities AS (SELECT n_nationkey AS city_id, lower(n_name) AS city, lower(r_name) AS department,
      CAST((n_nationkey*37)%17-4 AS DOUBLE) AS lat, CAST((n_nationkey*53)%13-80 AS DOUBLE) AS lng
      FROM nation JOIN region ON n_regionkey=r_regionkey)""",
    "arrivals": """arrivals AS (SELECT c_nationkey AS city_id, year(o_orderdate) AS year, month(o_orderdate) AS month,
      o_totalprice AS amount, o_orderkey AS arrival_id FROM orders JOIN customer ON o_custkey=c_custkey)""",
    "incidents": """incidents AS (SELECT s_nationkey AS city_id, year(l_shipdate) AS year, month(l_shipdate) AS month,
      l_quantity AS quantity FROM lineitem JOIN supplier ON l_suppkey=s_suppkey WHERE l_returnflag='R')""",
    "entry_points": """entry_points AS (SELECT s_suppkey AS point_id, ((s_suppkey*41)%1700)/100.0::DOUBLE-3.995::DOUBLE AS lat,
      ((s_suppkey*29)%1300)/100.0::DOUBLE-79.995::DOUBLE AS lng, weight FROM supplier
      JOIN (SELECT l_suppkey, sum(l_quantity) AS weight FROM lineitem GROUP BY 1) ON l_suppkey=s_suppkey)""",
    "places": """places AS (SELECT c_custkey AS place_id, c_nationkey AS city_id,
      ((c_custkey*37)%1700)/100.0::DOUBLE-3.997::DOUBLE AS lat, ((c_custkey*53)%1300)/100.0::DOUBLE-79.993::DOUBLE AS lng FROM customer)""",
    "readings": """readings AS (SELECT user_id AS station_id, day(ts) AS day, value,
      ((user_id*37)%170)*10000.0::DOUBLE AS x, ((user_id*53)%130)*10000.0::DOUBLE+(user_id%7)*1000.0::DOUBLE AS y FROM events)""",
    "panel": """panel AS (SELECT f.*, coalesce(b.crimes,0.0) AS crimes, coalesce(b.thefts,0.0) AS thefts,
      f.year*12+f.month-1 AS period FROM
      (SELECT city_id, year, month, count(*)::DOUBLE AS visitors, round(sum(amount),2) AS gdp,
        round(max(amount),2) AS trip_spend, round(min(amount),2) AS daily_spend FROM arrivals GROUP BY ALL) f
      LEFT JOIN (SELECT city_id, year, month, sum(quantity) AS crimes, count(*)::DOUBLE AS thefts FROM incidents GROUP BY ALL) b
      USING (city_id, year, month))""",
}


def with_roles(*names: str) -> str:
    """``WITH`` header that defines the named roles in dependency order."""
    order = ["cities", "arrivals", "incidents", "entry_points", "places", "readings", "panel"]
    wanted = set(names) | ({"arrivals", "incidents"} if "panel" in names else set())
    return "WITH " + ",\n".join(SQL[n] for n in order if n in wanted)


def utm(df: DataFrame, zone: int = 18) -> DataFrame:
    x, y = project_utm(F.col("lng"), F.col("lat"), zone)
    return df.withColumns({"x": x, "y": y})
