"""Checked query: the flagship city-month panel over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import MONTHS_ES
from ..functions.text import literal_map
from ..operators import panel as P
from ..operators import raster as R
from ..operators import smoothing
from ..operators import spatial as S
from ..operators.scale import materialise, scratch_path
from ..sources.readers import write_panel_csv
from ..sources.schemas import PANEL_EXPORT_NAMES
from . import panel as whole
from .catalog_series import _YEAR_ARR, _pattern_sql
from .catalog_raster import pixels
from .catalog_spatial import _X, _Y, road_segments, squares
from .registry import query
from .tables import utm, with_roles


@query("PANEL_city_month", with_roles("cities", "arrivals", "incidents", "entry_points") + f""", c AS (SELECT city_id, {_X} AS cx, {_Y} AS cy FROM cities), ep AS (SELECT point_id, weight, {_X} AS px, {_Y} AS py FROM entry_points),
 dist AS (SELECT city_id, sum(sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy))/1000*weight)/sum(weight) AS km FROM c, ep GROUP BY 1),
 {_YEAR_ARR}, {_pattern_sql('ya')},
 cells AS (SELECT city_id, year, m.month AS month FROM (SELECT DISTINCT city_id, year FROM arrivals), (SELECT unnest(range(1,13)) AS month) m),
 f AS (SELECT city_id, year, month, count(*) AS visitors, sum(amount) AS spend, median(amount) AS middle FROM arrivals GROUP BY ALL),
 cr AS (SELECT city_id, year, month, sum(quantity) AS crimes FROM incidents GROUP BY ALL),
 gd AS (SELECT city_id, year, sum(amount) AS gdp FROM arrivals GROUP BY ALL)
 SELECT cells.city_id AS city_id, city, department, cells.month || '-' || cells.year AS period, coalesce(visitors,0) AS visitors, round(coalesce(spend,0),2) AS spend,
  round(middle,6) AS median_spend, coalesce(crimes,0) AS crimes, round(km,5) AS access_distance, round(gdp*w[cells.month],2) AS monthly_gdp
 FROM cells JOIN cities ON cells.city_id=cities.city_id LEFT JOIN f ON f.city_id=cells.city_id AND f.year=cells.year AND f.month=cells.month
 LEFT JOIN cr ON cr.city_id=cells.city_id AND cr.year=cells.year AND cr.month=cells.month LEFT JOIN dist ON dist.city_id=cells.city_id
 LEFT JOIN gd ON gd.city_id=cells.city_id AND gd.year=cells.year LEFT JOIN pat ON pat.year=cells.year""")
def city_month(t):
    """Arrivals, cost, safety, access and monthly GDP of every city and month."""
    keys = ["city_id", "year", "month"]
    a = t.arrivals
    cells = P.complete_months(a.withColumn("visitors", F.lit(1)), keys[:2], "month", "visitors", "sum")
    spend = a.groupBy(*keys).agg(F.sum("amount").alias("spend"))
    middle = P.group_median(a, keys, "amount", "median_spend")
    crimes = t.incidents.groupBy(*keys).agg(F.sum("quantity").alias("crimes"))
    km = S.weighted_mean_distance(utm(t.cities), utm(t.entry_points), "city_id", "point_id", "weight")
    annual = a.groupBy("city_id", "year").agg(F.sum("amount").alias("gdp"))
    gdp = P.spread_over_months(annual, smoothing.seasonal_pattern(t.incidents, ["year"], "month", "quantity"), ["year"], ["gdp"])
    out = (cells.join(t.cities.select("city_id", "city", "department"), "city_id").join(spend, keys, "left").join(middle, keys, "left")
           .join(crimes, keys, "left").join(km, "city_id", "left").join(gdp, keys, "left").na.fill(0.0, ["spend", "crimes"]))
    return out.select("city_id", "city", "department", F.concat_ws("-", F.col("month"), F.col("year")).alias("period"), "visitors",
                      F.round("spend", 2).alias("spend"), F.round("median_spend", 6).alias("median_spend"), "crimes",
                      F.round("distance_km", 5).alias("access_distance"), F.round("gdp", 2).alias("monthly_gdp"))


# -- the whole panel, from the given tables in the roles of the raw ones ------------------------


def published_year(ts):
    """The given years in turn on the published ones."""
    return F.element_at(F.array(*[F.lit(y) for y in whole.YEARS]), (F.year(ts) - 1995) % len(whole.YEARS) + 1)


def _day(ts):
    return F.concat_ws("-", published_year(ts).cast("string"), F.date_format(ts, "MM"), F.lit("15"))


def raw_sources(t) -> dict:
    """Every raw table of the panel under the name and with the columns it arrives with."""
    names = t.nation.select("n_nationkey", "n_name").join(t.cities.select(F.col("city_id").alias("n_nationkey"), "department", "lat", "lng"), "n_nationkey")
    people = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count(F.lit(1)) * 1000).alias("population"))
    ship = F.col("l_shipdate")
    o = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(names, F.col("c_nationkey") == F.col("n_nationkey"))
         .withColumns({"year": published_year(F.col("o_orderdate")), "month": F.month("o_orderdate")}))
    l = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(names, F.col("s_nationkey") == F.col("n_nationkey"))
         .withColumns({"year": published_year(ship), "month": F.month(ship), "day": _day(ship)}))
    month_es = F.element_at(literal_map(dict(enumerate(MONTHS_ES, 1))), F.col("month"))

    crimes = materialise(l.groupBy("l_returnflag", "n_name", "day").agg(F.sum("l_quantity").cast("bigint").alias("n")), "crimes")

    def crime(flag):
        return (crimes.where(F.col("l_returnflag") == flag)
                .select(F.col("day").alias("FECHA HECHO"), F.concat("n_name", F.lit(" (CT)")).alias("MUNICIPIO"), F.col("n").cast("string").alias("CANTIDAD")))

    price = F.col("o_totalprice")
    spend = (o.groupBy(F.col("n_name").alias("city"), "year")
             .agg(*[f.alias(n) for n, f in zip(whole.SPEND_ITEMS, (F.avg(price), F.min(price), F.max(price), F.avg(price / 2), F.avg(price / 3)))]))
    totals = names.join(people, "n_nationkey").groupBy("department").agg(F.sum("population").alias("whole"))
    share = (names.join(people, "n_nationkey").join(totals, "department")
             .select(F.col("department").alias("Departamento"), F.col("n_name").alias("Municipio / Distrito"),
                     (100 * F.col("population") / F.col("whole")).alias("Peso relativo municipal en el valor agregado departamental %")))
    stations = t.events.join(names, F.col("user_id") % 25 == F.col("n_nationkey"))
    sides = ["x1", "y1", "x2", "y2"]
    land = R.land_cover(pixels(t)).join(names, F.col("city_id") == F.col("n_nationkey"))
    land = land.groupBy(F.col("n_name").alias("ciudad"), F.element_at(F.array(*[F.lit(y) for y in whole.YEARS]), (F.col("year") - 1995) % len(whole.YEARS) + 1).alias("año")).agg(*[F.sum(c).alias(c) for c in ("urban", "green", "water")])
    return {
        "cities": names.join(people, "n_nationkey").select(F.col("n_name").alias("city"), "lat", "lng", F.col("department").alias("admin_name"), "population"),
        "visitors": o.groupBy(F.col("year").alias("Año"), F.col("n_name").alias("Ciudad"), F.col("month").alias("Mes")).agg(F.count(F.lit(1)).alias("Extranjeros no Residentes")),
        "homicides": crime("R"), "thefts": crime("A"), "sexual_crimes": crime("N"),
        "departments": squares(t).join(t.cities.select("city_id", "department"), "city_id").select("department", *sides),
        "weather": stations.select(_day(F.col("ts")).alias("FechaObservacion"), F.col("n_name").alias("Municipio"), F.col("value").alias("ValorObservado")),
        "fx": l.select(F.col("day").alias("Fecha"), F.col("l_extendedprice").alias("Dolar")),
        "gdp": (o.groupBy("year", F.col("department").alias("DEPARTAMENTO")).agg(F.round(F.sum("o_totalprice"), 0).cast("bigint").alias("v"))
                .select("year", "DEPARTAMENTO", F.concat(F.col("v").cast("string"), F.lit(",5")).alias("VALOR (unidades)"))),
        "municipal_weight": share,
        "border_entries": (t.lineitem.groupBy(F.col("l_suppkey").alias("point_id"), published_year(ship).alias("year"), F.month(ship).alias("month")).agg(F.sum("l_quantity").cast("bigint").alias("Total"))
                           .join(t.supplier_points, "point_id")
                           .select(F.col("year").alias("Año"), month_es.alias("Mes"), F.format_string("(%.3f, %.3f)", "lat", "lng").alias("Latitud - Longitud"), "Total")),
        "lodging": o.where("year < 2023").select(F.col("year").alias("AÑO"), F.col("n_name").alias("NOMBRE-MUNI"), F.col("department").alias("NOMDEP"), F.col("c_mktsegment").alias("CATEGORIA"),
                                                 (F.col("c_custkey") % 50).alias("HABITACIONES"), (F.col("c_custkey") % 90).alias("CAMAS")),
        "lodging_2023": o.where("year = 2023").select(F.col("n_name").alias("MUNICIPIO"), F.col("month").alias("MES"), F.col("c_mktsegment").alias("CATEGORIA"),
                                                      (F.col("c_custkey") % 50).alias("NÚMERO DE HABIATACIONES"), (F.col("c_custkey") % 90).alias("NÚMERO DE CAMAS")),
        "spend_daily": spend, "spend_trip": spend,
        "inflation": l.groupBy(F.col("day").alias("Fecha")).agg(F.avg("l_tax").alias("Inflacion")),
        "outlines": squares(t, 15000.0, 100000.0).join(names, F.col("city_id") == F.col("n_nationkey")).select(F.lower("n_name").alias("city"), *sides),
        "roads": road_segments(t),
        "events": o.groupBy(F.col("department").alias("Departamento"), "year", F.col("month").alias("Mes")).agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("Eventos")),
        "land_areas": land,
    }


@query("PANEL_full")
def panel_full(t):
    """All columns of the panel for every city and month, gaps of lodging and land filled."""
    return whole.impute(whole.assemble(raw_sources(t)))


_PY = "[2018,2019,2021,2022,2023][(year({0})-1995)%5+1]"


@query("PANEL_facts", with_roles("cities", "entry_points") + f""", n AS (SELECT n_nationkey, replace(lower(n_name),' ','') AS city, replace(department,' ','') AS department FROM nation JOIN cities ON city_id=n_nationkey),
 o AS (SELECT city, department, {_PY.format('o_orderdate')} AS year, month(o_orderdate) AS month, o_orderpriority FROM orders JOIN customer ON o_custkey=c_custkey JOIN n ON c_nationkey=n_nationkey),
 l AS (SELECT city, {_PY.format('l_shipdate')} AS year, month(l_shipdate) AS month, l_returnflag, l_quantity, l_extendedprice, l_tax FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN n ON s_nationkey=n_nationkey),
 cells AS (SELECT city, year, m.month AS month FROM (SELECT DISTINCT city, year FROM o), (SELECT unnest(range(1,13)) AS month) m),
 v AS (SELECT city, year, month, count(*) AS visitors FROM o GROUP BY ALL),
 cr AS (SELECT city, year, month, sum(l_quantity) FILTER (l_returnflag='R')::BIGINT AS homicides, sum(l_quantity) FILTER (l_returnflag='A')::BIGINT AS thefts, sum(l_quantity) FILTER (l_returnflag='N')::BIGINT AS sexual_crimes FROM l GROUP BY ALL),
 fx AS (SELECT year, month, median(l_extendedprice) AS fx, avg(l_tax) AS inflation FROM l GROUP BY ALL),
 ev AS (SELECT department, year, month, count(*) FILTER (o_orderpriority='1-URGENT') AS events FROM o GROUP BY ALL)
 SELECT cells.city AS city, cells.year AS year, cells.month AS month, n.department AS department, cells.month || '-' || cells.year AS period, coalesce(visitors,0)::BIGINT AS visitors,
  coalesce(homicides,0)::BIGINT AS homicides, coalesce(thefts,0)::BIGINT AS thefts, coalesce(sexual_crimes,0)::BIGINT AS sexual_crimes, round(fx+1e-6::DOUBLE,3) AS fx, round(inflation+1e-9::DOUBLE,5) AS inflation, coalesce(events,0)::BIGINT AS events
 FROM cells JOIN n USING (city) LEFT JOIN v USING (city, year, month) LEFT JOIN cr USING (city, year, month) LEFT JOIN fx ON fx.year=cells.year AND fx.month=cells.month
 LEFT JOIN ev ON ev.department=n.department AND ev.year=cells.year AND ev.month=cells.month""")
def panel_facts(t):
    """The columns of the whole panel that have a closed form."""
    s = raw_sources(t)
    points = whole.city_points(s["cities"])
    return whole.facts(s, points, whole.visitor_scaffold(s["visitors"], points)).select(
        "city", "year", "month", "department", "period", "visitors", "homicides", "thefts", "sexual_crimes", F.round(F.col("fx") + 1e-6, 3).alias("fx"), F.round(F.col("inflation") + 1e-9, 5).alias("inflation"), "events")


@query("PANEL_export", with_roles("panel") + """ SELECT city_id::VARCHAR AS "Ciudad", month || '-' || year AS "Mes", visitors::BIGINT::VARCHAR AS "Nmero Extranjeros", thefts::BIGINT::VARCHAR AS "Hurtos" FROM panel""")
def panel_export(t):
    """The panel written as text under its published names and read back as text."""
    path = scratch_path(t.spark, "export")
    rows = t.panel.select(F.col("city_id").alias("city"), F.concat_ws("-", "month", "year").alias("period"), F.col("visitors").cast("bigint").alias("visitors"), F.col("thefts").cast("bigint").alias("thefts"))
    write_panel_csv(rows, path, PANEL_EXPORT_NAMES)
    return t.spark.read.csv(path, header=True)
