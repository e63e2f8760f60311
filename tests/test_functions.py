import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.functions import constants, geo, series, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("raw,clean", [(" Bogotá, D.C. ", "bogota"), ("San Andrés de Tumaco", "tumaco"), ("Fortul CT", "fortul"),
                                       ("Peñol", "penol"), ("BOGOTÁ D.C. (CT)", "bogota"), ("Cúcuta", "cucuta"), ("", "")])
def test_clean_name(spark, raw, clean):
    assert one(spark, text.clean_name(F.lit(raw)))[0] == clean


def test_clean_name_absent_column_is_left_alone(spark):
    df = spark.range(2)
    assert text.normalize_name(df, "nope", "city") is df


def test_decomposed_accents_are_removed(spark):
    assert one(spark, text.strip_accents(F.lit("Bogotá")))[0] == "Bogota"


def test_parsing(spark):
    lat, lng = text.parse_point(F.lit("(4.60, -74.07)"))
    row = one(spark, text.parse_decimal_comma(F.lit("12,5")), text.parse_decimal_comma(F.lit("n.d.")), lat, lng,
              text.parse_point(F.lit("No Aplica"))[1], text.period_key(F.lit(3), F.lit(2019)), text.parse_period(F.lit("3-2019")).cast("string"))
    assert tuple(row) == (12.5, None, 4.60, -74.07, None, "3-2019", "2019-03-01")


def test_months(spark):
    row = one(spark, text.month_number(F.lit("March")), text.month_name(F.lit(12)), text.month_to_english(F.lit("Enero")), text.month_to_english(F.lit("x")))
    assert tuple(row) == (3, "December", "January", None)


def test_projection_matches_known_point_and_literal_version(spark):
    x, y = geo.project_utm(F.lit(-74.0), F.lit(4.0), 18)
    row = one(spark, x, y)
    assert row[0] == pytest.approx(geo.project_point(-74.0, 4.0)[0], abs=1e-6)
    assert row[1] == pytest.approx(geo.project_point(-74.0, 4.0)[1], abs=1e-6)
    # the central meridian maps to 500 km east; one degree of latitude at the equator is 110.57 km
    assert geo.project_point(-75.0, 0.0) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert geo.project_point(-75.0, 1.0)[1] == pytest.approx(0.9996 * 110574.38, abs=1.0)


def test_segment_distances(spark):
    p = geo.point_segment_distance(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 1.0, 0.0)))
    q = geo.point_segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)))
    seg = lambda a, b, c, d: F.struct(F.lit(a).alias("x1"), F.lit(b).alias("y1"), F.lit(c).alias("x2"), F.lit(d).alias("y2"))
    s = geo.segment_segment_distance(seg(0.0, 0.0, 2.0, 0.0), seg(1.0, -1.0, 1.0, 1.0))
    r = geo.segment_segment_distance(seg(0.0, 0.0, 2.0, 0.0), seg(3.0, 0.0, 4.0, 5.0))
    assert tuple(one(spark, p, q, s, r)) == (1.0, 5.0, 0.0, 1.0)


def test_smoother_reproduces_lines_and_resists_an_outlier():
    y = np.arange(12.0)[None, :] * 2 + 1
    assert np.allclose(series.local_fit(y, np.ones_like(y), 0.4), y)
    x = np.arange(40.0)[None, :]  # long enough that a window outvotes one bad point
    bumpy = 2 * x + np.sin(x) * 0.1
    spike = bumpy.copy()
    spike[0, 20] += 50
    plain = series.local_fit(spike, np.ones_like(spike), 0.4)
    fit = plain
    for _ in range(3):
        fit = series.local_fit(spike, series.bisquare(spike, fit), 0.4)
    assert abs(fit[0, 22] - bumpy[0, 22]) < 0.2 < abs(plain[0, 22] - bumpy[0, 22])


def test_neighbourhoods_of_twelve_points():
    near = series.neighbourhoods(12, 0.4)
    assert near[0] == (0, 3, 3.0) and near[2] == (0, 3, 2.0) and near[3] == (1, 4, 2.0) and near[11] == (8, 11, 3.0)


def test_fixed_tables():
    assert len(constants.ATTRACTIONS) == 41 and len(constants.PATTERN_NOISE) == 12
    assert all(len(t) == 12 for t in (*constants.GDP_TRENDS.values(), *constants.LODGING_TRENDS.values()))
    rng = np.random.RandomState(42).normal(0, 0.005, 12)
    assert np.allclose(rng, constants.PATTERN_NOISE, atol=1e-8)
    assert math.isclose(dict(zip(*constants.accent_table()))["ñ"] == "n", True)
