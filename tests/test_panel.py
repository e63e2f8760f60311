"""The whole panel from small raw tables with the usual traps in them."""

import pytest
from pyspark.sql import functions as F

from cityloom.plans import panel
from cityloom.sources import schemas

YEARS = (2018, 2019)
SEG = "x1 double, y1 double, x2 double, y2 double"


def ring(key, x0, y0, x1, y1):
    p = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(key, *a, *b) for a, b in zip(p, p[1:] + p[:1])]


@pytest.fixture(scope="module")
def raw(spark):
    make = spark.createDataFrame
    cities = [("Bogotá", 4.6, -74.1, "Cundinamarca", 7000), ("Tumaco", 1.8, -78.8, None, 200), ("Cali", 3.4, -76.5, "Valle", 2000),
              ("Peñol", 6.2, -75.2, "Antioquia", 20), ("Leticia", -4.2, -69.9, "Amazonas", 50)]
    visits = [(y, c, m, 10 * m) for y in YEARS for c in ("BOGOTÁ, D.C.", "San Andrés de Tumaco", "Cali", "Peñol") for m in (1, 2, 12)]
    visits += [(2018, "Cali", 1, 5), (2018, "Nowhere", 1, 9), (2017, "Cali", 1, 1000)]
    crime = [("2018-01-05 00:00:00", "BOGOTÁ D.C. (CT)", "2"), ("2018-01-09 00:00:00", "BOGOTÁ D.C. (CT)", "3"), ("Fuente: x", None, None)]
    deps = ring("Cundinamarca", -75.0, 4.0, -73.0, 5.5) + ring("Valle", -77.5, 3.0, -76.0, 5.0) + ring("Antioquia", -77.0, 5.6, -74.5, 8.0) + ring("Nariño", -79.0, 0.5, -77.6, 2.5)
    spend = [(c, y, *[100.0 * (i + 1) * k for i in range(5)]) for y in YEARS for c, k in (("Bogotá", 1.038), ("Cali", 2.0), ("Peñol", 3.0))]
    weather = [(f"{y}-{m:02d}-15 10:00:00", c, v) for y in YEARS for m in range(1, 13) for c, v in (("Cali", 25.0), ("Peñol", 18.0), ("Bogotá", 13.0), ("Bogotá", 15.0))]
    points = "(4.70, -74.14)", "(3.54, -76.38)"
    return {
        "cities": make(cities, schemas.CITIES), "visitors": make(visits, schemas.VISITORS),
        **{n: make(crime, "`FECHA HECHO` string, MUNICIPIO string, CANTIDAD string") for n in ("homicides", "thefts", "sexual_crimes")},
        "departments": make(deps, f"department string, {SEG}"), "weather": make(weather, schemas.WEATHER),
        "fx": make([(f"{y}-{m:02d}-{d:02d}", 3000.0 + m + d) for y in YEARS for m in range(1, 13) for d in (1, 2)] + [("bad", 1.0)], schemas.FX),
        "gdp": make([(y, "1", d, v) for y in YEARS for d, v in (("Cundinamarca", "1200,5"), ("Valle", "600"), ("Nariño", "n.d."))], "year int, " + schemas.GDP),
        "municipal_weight": make([("Cundinamarca", "Bogotá", 50.0), ("Cundinamarca", "Bogotá", 50.0), ("Valle", "Cali", 40.0)], schemas.MUNICIPAL_WEIGHT),
        "border_entries": make([(y, "Enero", p, n) for y in YEARS for p, n in ((points[0], 300), (points[1], 100), ("No Aplica,No Aplica", 7))], schemas.BORDER_ENTRIES),
        "lodging": make([(y, "CALI", "VALLE", "HOTEL", 10, 20) for y in YEARS] + [(2018, "CALI", "VALLE", None, 5, None)], schemas.LODGING),
        "lodging_2023": make([("CALI", 1, "HOTEL", 1, 1)], schemas.LODGING_2023),
        "spend_daily": make(spend, "city string, year int, average double, lodging double, transport double, food double, other double"),
        "spend_trip": make(spend, "city string, year int, average double, lodging double, transport double, food double, other double"),
        "inflation": make([(f"{y}-{m:02d}-01", float(m)) for y in YEARS for m in range(1, 13)], schemas.INFLATION),
        "outlines": make(ring("bogota", 0.0, 0.0, 20000.0, 20000.0) + ring("cali", 9e5, 0.0, 9.1e5, 1e4), f"city string, {SEG}"),
        "roads": make([(1, 29000.0, 0.0, 29900.0, 0.0), (2, 5e5, 5e5, 5.1e5, 5e5)], f"road_id int, {SEG}"),
        "events": make([("Cundinamarca", 2018, 1, 4), ("Valle", 2018, 1, None)], "Departamento string, year int, Mes int, Eventos bigint"),
        "land_areas": make([("Bogotá", 2018, 190.0, 38.0, 0.8), ("Cali", 2018, None, None, None)], schemas.LAND_AREAS),
    }


@pytest.fixture(scope="module")
def built(raw):
    return panel.assemble(raw, YEARS).toPandas()


def cell(df, city, year, month):
    return df[(df.city == city) & (df.year == year) & (df.month == month)].iloc[0]


def test_shape_and_scaffold(built):
    assert sorted(built.city.unique()) == ["bogota", "cali", "penol", "tumaco"]
    assert len(built) == 4 * 2 * 12 and not built.duplicated(["city", "year", "month"]).any()
    assert cell(built, "cali", 2018, 1).visitors == 15 and cell(built, "cali", 2018, 3).visitors == 0


def test_joined_features(built):
    b = cell(built, "bogota", 2018, 1)
    assert (b.homicides, b.thefts, b.department, b.events, b.roads, b.period) == (5, 5, "cundinamarca", 4, 1, "1-2018")
    assert b.fx == 3002.5 and b.temperature == 14.0 and b.inflation == 1.0 and b.urban_area == 190.0
    assert cell(built, "cali", 2018, 1).events == 0 and cell(built, "tumaco", 2018, 1).department == "narino"
    assert built.temperature.notna().all() and built.daily_food.notna().all()


def test_annual_values_add_back(built):
    g = built[(built.city == "bogota") & (built.year == 2018)].weighted_gdp
    assert g.sum() == pytest.approx(1200.5 * 0.5)
    h = built[(built.city == "cali") & (built.year == 2018)]
    assert h.establishments.sum() == pytest.approx(1.0) and h.rooms.sum() == pytest.approx(15.0)


def test_access_and_spend(built):
    b, c = cell(built, "bogota", 2018, 1), cell(built, "cali", 2018, 1)
    assert b.zone_entries == 300 and cell(built, "bogota", 2018, 2).zone_entries == 0
    assert b.access_importance == pytest.approx(0.7) and c.access_importance == 0.0
    assert b.access_distance < c.access_distance
    assert b.daily_average == pytest.approx(100.0) and cell(built, "bogota", 2019, 1).daily_average == pytest.approx(103.8)
    assert built.groupby("city").access_distance.nunique().max() <= 2


def test_imputation_fills_only_gaps(spark, built):
    cols = [c for c in built.columns if c not in ("city", "year", "month", "department", "period")]
    frame = spark.createDataFrame(built.astype({c: float for c in cols}))
    frame = frame.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})
    done = panel.impute(frame).toPandas()
    assert done[panel.IMPUTED].notna().all().all() and len(done) == len(built)
    assert cell(done, "bogota", 2018, 1).urban_area == 190.0
