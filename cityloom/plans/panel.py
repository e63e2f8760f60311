"""Assembly of the city-month panel from the raw tables: one lazy plan for all years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ATTRACTIONS, DEPARTMENT_ALIASES, GDP_TRENDS, LODGING_TRENDS
from ..functions.geo import project_utm
from ..functions.text import clean_name, literal_map, month_number, month_to_english, parse_decimal_comma, parse_point, period_key
from ..operators import cleaning, kriging, panel, smoothing, spatial
from ..operators.knn import knn_impute
from ..operators.scale import dense_index, group_median, materialise

YEARS = (2018, 2019, 2021, 2022, 2023)
KEYS = ["city", "year", "month"]
IMPUTED = ["establishments", "rooms", "beds", "urban_area", "rural_area", "water_area"]
SPEND_ITEMS = ("average", "lodging", "transport", "food", "other")


def patterns(spark: SparkSession, trends: dict[int, tuple], robust: int = 3) -> DataFrame:
    """(year, month, weight) from the fixed monthly lists."""
    rows = [(y, m, float(v)) for y, t in trends.items() for m, v in enumerate(t, 1)]
    return smoothing.seasonal_pattern(spark.createDataFrame(rows, "year int, month int, v double"), ["year"], "month", "v", robust)


def _department(c):
    name = clean_name(c, None)
    return F.coalesce(F.element_at(literal_map(DEPARTMENT_ALIASES), name), name)


def city_points(cities: DataFrame) -> DataFrame:
    """(city, lat, lng, population, x, y), names cleaned, one row per city."""
    c = cities.select(clean_name(F.col("city")).alias("city"), "lat", "lng", "population").dropDuplicates(["city"])
    x, y = project_utm(F.col("lng"), F.col("lat"), 18)
    return c.withColumns({"x": x, "y": y})


def visitor_scaffold(visitors: DataFrame, cities: DataFrame, years=YEARS) -> DataFrame:
    """Twelve months for every kept city and year, visitors summed, gaps 0."""
    v = visitors.where(F.col("Año").isin(*years)).select(
        clean_name(F.col("Ciudad")).alias("city"), F.col("Año").alias("year"), F.col("Mes").alias("month"),
        F.col("Extranjeros no Residentes").alias("visitors"))
    v = materialise(v, "visitors")
    kept = cleaning.keep_known_cities(v, cleaning.known_cities(cities, v))
    return panel.complete_months(kept, ["city", "year"], "month", "visitors", "sum")


def city_departments(points: DataFrame, departments: DataFrame, cell: float) -> DataFrame:
    """(city, department) by the nearest department polygon, in degrees."""
    deps = departments.select(_department(F.col("department")).alias("department"), "x1", "y1", "x2", "y2")
    at = points.select("city", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return spatial.nearest_polygon(at, deps, "city", "department", cell).groupBy("city").agg(F.min("department").alias("department"))


def temperature(weather: DataFrame, cells: DataFrame, points: DataFrame) -> DataFrame:
    """Median reading per city-month; cities without one are kriged inside their month."""
    w = weather.select(F.try_to_timestamp(F.col("FechaObservacion")).alias("ts"), clean_name(F.col("Municipio")).alias("city"),
                       F.col("ValorObservado").alias("temperature")).where("ts is not null and temperature is not null")
    med = group_median(w.select("city", F.year("ts").alias("year"), F.month("ts").alias("month"), "temperature"), KEYS, "temperature", "temperature")
    rows = cells.select(*KEYS).join(points.select("city", "x", "y"), "city").join(med, KEYS, "left")
    return kriging.fill_by_kriging(rows, ["year", "month"], "city", "temperature").select(*KEYS, "temperature")


def weighted_gdp(gdp: DataFrame, weights: DataFrame) -> DataFrame:
    """Annual department GDP over months by the pattern of its year, times the city's share."""
    dep = gdp.select(F.col("year"), _department(F.col("DEPARTAMENTO")).alias("department"),
                     parse_decimal_comma(F.col("VALOR (unidades)")).alias("gdp")).where("gdp is not null")
    monthly = panel.spread_over_months(dep, patterns(gdp.sparkSession, GDP_TRENDS), ["year"], ["gdp"])
    share = weights.select(clean_name(F.col("Municipio / Distrito")).alias("city"), _department(F.col("Departamento")).alias("department"),
                           (F.col("Peso relativo municipal en el valor agregado departamental %") / 100).alias("share")).distinct()
    return share.join(monthly, "department").select(*KEYS, (F.col("share") * F.col("gdp")).alias("weighted_gdp"))


def entry_flows(entries: DataFrame, years=YEARS) -> DataFrame:
    """(point_id, lat, lng, x, y, year, month, people): sentinel rows dropped, Spanish months read."""
    lat, lng = parse_point(F.col("Latitud - Longitud"))
    e = entries.where((F.col("Latitud - Longitud") != "No Aplica,No Aplica") & F.col("Año").isin(*years)).select(
        F.col("Latitud - Longitud").alias("point_id"), lat.alias("lat"), lng.alias("lng"), F.col("Año").alias("year"),
        month_number(month_to_english(F.col("Mes"))).alias("month"), F.col("Total").alias("people")).where("lat is not null")
    x, y = project_utm(F.col("lng"), F.col("lat"), 18)
    return e.groupBy("point_id", "lat", "lng", "year", "month").agg(F.sum("people").alias("people")).withColumns({"x": x, "y": y})


def access_features(flows: DataFrame, points: DataFrame, departments: DataFrame, cell: float):
    """(zone entries by department and month, distance by city and year, score by department and year)."""
    spots = materialise(flows.select("point_id", "lng", "lat").distinct().select(F.col("point_id").alias("city"), "lng", "lat"), "spots")
    dep = materialise(city_departments(spots, departments, cell).withColumnRenamed("city", "point_id"), "zones")
    zone = flows.join(dep, "point_id").groupBy("department", "year", "month").agg(F.sum("people").alias("zone_entries"))
    per_year = flows.groupBy("year", "point_id", "x", "y").agg(F.sum("people").alias("people"))
    km = spatial.weighted_mean_distance(points, per_year, "city", "point_id", "people", ["year"]).withColumnRenamed("distance_km", "access_distance")
    score = spatial.access_importance(per_year.join(dep, "point_id"), "department", "people", by=["year"]).select("department", "year", "access_importance")
    return zone, km, score


def lodging_months(annual: DataFrame, monthly: DataFrame, years=YEARS, monthly_year: int = 2023) -> DataFrame:
    """Establishments, rooms and beds per city-month from the two layouts of the register; the monthly
    layout holds ``monthly_year``."""
    a = annual.where(F.col("AÑO").isin(*years)).groupBy(clean_name(F.col("NOMBRE-MUNI")).alias("city"), F.col("AÑO").alias("year")).agg(
        F.count("CATEGORIA").alias("establishments"), F.sum("HABITACIONES").alias("rooms"), F.sum("CAMAS").alias("beds"))
    spread = panel.spread_over_months(a, patterns(annual.sparkSession, LODGING_TRENDS), ["year"], ["establishments", "rooms", "beds"])
    m = monthly.groupBy(clean_name(F.col("MUNICIPIO")).alias("city"), F.lit(monthly_year).alias("year"), F.col("MES").alias("month")).agg(
        F.count("CATEGORIA").cast("double").alias("establishments"), F.sum("NÚMERO DE HABIATACIONES").cast("double").alias("rooms"),
        F.sum("NÚMERO DE CAMAS").cast("double").alias("beds"))
    cols = [*KEYS, "establishments", "rooms", "beds"]
    return spread.select(*cols).unionByName(m.select(*cols))


def spend_months(spend: DataFrame, cells: DataFrame, points: DataFrame, prefix: str, deflate_year: int | None = 2018) -> DataFrame:
    """Five spend items per city and year, kriged where the survey has none, the same all year.
    Prices of ``deflate_year`` come from the survey one year later."""
    s = materialise(spend.select(clean_name(F.col("city")).alias("city"), "year", *SPEND_ITEMS), "spend")
    now = F.col("year") == deflate_year if deflate_year else F.lit(False)
    deflated = cleaning.deflate(s, {i: i for i in SPEND_ITEMS})
    s = deflated.where(now).unionByName(s.where(~now))
    complete, _ = cleaning.split_missing(s, list(SPEND_ITEMS))
    rows = cells.select("city", "year").distinct().join(complete, ["city", "year"], "full").join(points.select("city", "x", "y"), "city")
    long = rows.unpivot(["city", "year", "x", "y"], list(SPEND_ITEMS), "item", "value")
    filled = kriging.fill_by_kriging(long, ["year", "item"], "city", "value")
    wide = filled.groupBy("city", "year").agg(*[F.max(F.when(F.col("item") == i, F.col("value"))).alias(f"{prefix}_{i}") for i in SPEND_ITEMS])
    return panel.repeat_over_months(wide)


def facts(s: dict[str, DataFrame], points: DataFrame, cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """The counted columns of the panel: visitors, crimes, department, exchange rate, inflation and events."""
    out = cells
    for name in ("homicides", "thefts", "sexual_crimes"):
        counts = panel.incident_rollup(s[name], "FECHA HECHO", "MUNICIPIO", "CANTIDAD", name)
        out = out.join(counts, KEYS, "left").na.fill(0, [name])
    dep = city_departments(points, s["departments"], cell)
    fx = panel.resample_monthly_median(s["fx"].select(F.to_date(F.try_to_timestamp(F.col("Fecha"))).alias("day"), F.col("Dolar").alias("fx")), "day", "fx")
    infl = s["inflation"].select(F.to_date(F.try_to_timestamp(F.col("Fecha"))).alias("d"), "Inflacion").select(
        F.year("d").alias("year"), F.month("d").alias("month"), F.col("Inflacion").alias("inflation"))
    events = s["events"].select(_department(F.col("Departamento")).alias("department"), "year", F.col("Mes").alias("month"),
                                F.coalesce("Eventos", F.lit(0)).alias("events"))
    out = (out.join(dep, "city", "left").join(fx.select("year", "month", "fx"), ["year", "month"], "left")
           .join(infl, ["year", "month"], "left").join(events, ["department", "year", "month"], "left").na.fill(0, ["events"]))
    return out.withColumn("period", period_key(F.col("month"), F.col("year")))


def assemble(s: dict[str, DataFrame], years=YEARS, cell: float = 1.0, road_metres: float = 10_000.0) -> DataFrame:
    """The panel before imputation. ``s`` holds the raw tables under the names of the sources; what is read more than once is
    worked out from them once and written."""
    points = materialise(city_points(s["cities"]), "points")
    cells = materialise(visitor_scaffold(s["visitors"], points, years), "cells")
    zone, km, score = access_features(materialise(entry_flows(s["border_entries"], years), "flows"), points, s["departments"], cell)
    roads = spatial.roads_within(s["outlines"], s["roads"], "city", "road_id", road_metres, 2 * road_metres)
    land = s["land_areas"].select(clean_name(F.col("ciudad")).alias("city"), F.col("año").alias("year"), F.col("urban").alias("urban_area"),
                                  F.col("green").alias("rural_area"), F.col("water").alias("water_area"))
    top = spatial.popularity_distance(points, "city", ATTRACTIONS)
    return (facts(s, points, cells, cell).join(temperature(s["weather"], cells, points), KEYS, "left")
            .join(weighted_gdp(s["gdp"], s["municipal_weight"]), KEYS, "left")
            .join(zone, ["department", "year", "month"], "left").na.fill(0, ["zone_entries"])
            .join(km, ["city", "year"], "left").join(score, ["department", "year"], "left").na.fill(0.0, ["access_importance"])
            .join(lodging_months(s["lodging"], s["lodging_2023"], years), KEYS, "left").join(top, "city", "left")
            .join(points.select("city", "population"), "city", "left")
            .withColumn("poverty_proxy", F.try_divide("weighted_gdp", "population")).drop("population")
            .join(spend_months(s["spend_daily"], cells, points, "daily"), KEYS, "left")
            .join(spend_months(s["spend_trip"], cells, points, "trip"), KEYS, "left")
            .join(roads, "city", "left").join(land, ["city", "year"], "left"))


def impute(panel_rows: DataFrame) -> DataFrame:
    """Fill the lodging and land columns from the five nearest panel rows."""
    rows = materialise(dense_index(materialise(panel_rows, "panel"), [F.col(k) for k in KEYS], "_row"), "numbered")
    fixed = {*KEYS, "department", "period", "_row"}
    numeric = [c for c in panel_rows.columns if c not in fixed]
    return knn_impute(rows, "_row", "city", ["city", "department", "period"], numeric, IMPUTED, 5).drop("_row")
