"""Checked queries: land cover from pixels. Line items play the pixels of a scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators.scale import materialise
from .registry import query


def pixels(t):
    """A scene is a city's day of shipping; two nations have none. The grid grows with the parts, so
    the scenes of a pixel stay few at any size."""
    scene = F.dayofyear("l_shipdate")
    city = F.col("l_suppkey") % 23
    return t.lineitem.select(
        city.alias("city_id"), F.year("l_shipdate").alias("year"), scene.alias("scene_id"),
        F.to_date("l_shipdate").alias("scene_ts"), ((scene * 37 + city * 11) % 100).cast("double").alias("scene_cloud_pct"),
        F.floor(F.col("l_partkey") / 500).alias("px"), (F.col("l_orderkey") % 3).alias("py"),
        (F.col("l_quantity") * 40).alias("b2"), (F.col("l_discount") * 20000 + 300).alias("b3"),
        (F.col("l_tax") * 20000 + 200).alias("b4"), (F.col("l_extendedprice") / 32).alias("b8"),
        (F.col("l_quantity") * 60).alias("b11"), (F.col("l_extendedprice") / 64).alias("b12"),
        F.when(scene % 9 != 0, (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 100).alias("cloud_prob"))


def _cte(*steps: str) -> str:
    all_steps = {
        "px": """px AS (SELECT l_suppkey%23 AS city_id, year(l_shipdate) AS year, dayofyear(l_shipdate) AS scene_id, l_shipdate::DATE AS scene_ts,
 (dayofyear(l_shipdate)*37+(l_suppkey%23)*11)%100 AS cloud, l_partkey//500 AS px, l_orderkey%3 AS py, l_quantity*40 AS b2, l_discount*20000+300 AS b3,
 l_tax*20000+200 AS b4, l_extendedprice/32 AS b8, l_quantity*60 AS b11, l_extendedprice/64 AS b12,
 CASE WHEN dayofyear(l_shipdate)%9<>0 THEN (l_partkey*7+l_linenumber*13)%100 END AS cloud_prob FROM lineitem)""",
        "sc": """sc AS (SELECT city_id, year, scene_id FROM (SELECT DISTINCT city_id, year, scene_id, scene_ts FROM px WHERE cloud<50)
 QUALIFY row_number() OVER (PARTITION BY city_id, year ORDER BY scene_ts, scene_id)<=55)""",
        "kept": "kept AS (SELECT px.* FROM px JOIN sc USING (city_id, year, scene_id))",
        "mask": "mask AS (SELECT * FROM kept WHERE coalesce(cloud_prob<40, true))",
        "comp": "comp AS (SELECT city_id, year, px, py, " + ", ".join(f"median({b})*0.0001::DOUBLE AS {b}" for b in R.BANDS) + " FROM mask GROUP BY ALL)",
        "idx": "idx AS (SELECT city_id, year, px, py, " + ", ".join(
            f"CASE WHEN {a}>=0 AND {b}>=0 THEN ({a}-{b})/nullif({a}+{b},0) END AS {n}" for n, a, b in (
                ("ndwi", "b3", "b8"), ("ndbi", "b11", "b8"), ("ndvi", "b8", "b4"), ("gndvi", "b8", "b3"), ("mndwi", "b3", "b11")))
        + ", 2.5*(b8-b4)/nullif(b8+6*b4-7.5*b2+1,0) AS evi, b3+2.5*b8-1.5*(b11+b12)-0.25*b2 AS aweish FROM comp)",
        "hist": "hist AS (SELECT city_id, year, CAST(greatest(0,least(254,floor((ndbi+1)/(2.0::DOUBLE/255)))) AS INTEGER) AS bin, count(*) AS n, avg(ndbi) AS bin_mean FROM idx WHERE ndbi IS NOT NULL GROUP BY ALL)",
        "otsu": """run AS (SELECT *, sum(n) OVER w AS wb, sum(n*bin_mean) OVER w AS sb, sum(n) OVER g AS wt, sum(n*bin_mean) OVER g AS st FROM hist
 WINDOW w AS (PARTITION BY city_id, year ORDER BY bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY city_id, year)),
 btw AS (SELECT *, CASE WHEN wt>wb THEN round(wb*(wt-wb)*power(sb/wb-(st-sb)/(wt-wb),2),6) END AS v FROM run),
 otsu AS (SELECT city_id, year, CASE WHEN v IS NOT NULL THEN bin_mean END AS threshold FROM btw QUALIFY row_number() OVER (PARTITION BY city_id, year ORDER BY v DESC NULLS LAST, bin)=1)""",
        "pct": "pct AS (SELECT city_id, year, " + ", ".join(f"quantile_cont({i},{p}) AS {n}" for n, (i, p) in R.PERCENTILES.items()) + " FROM idx GROUP BY ALL)",
        "cls": """cls AS (SELECT idx.city_id, idx.year, px, py, (ndbi>coalesce(threshold,0.2) AND evi<evi_urban AND ndvi<ndvi_urban AND ndwi<0) AS urban,
 (ndvi>ndvi_green AND evi>evi_green AND gndvi>gndvi_green) AS green, (ndwi>ndwi_water AND mndwi>mndwi_water AND aweish>aweish_water) AS water
 FROM idx JOIN pct USING (city_id, year) LEFT JOIN otsu USING (city_id, year))""",
        "area": "area AS (SELECT city_id, year, " + ", ".join(f"round(count(*) FILTER ({m})*0.0001,6) AS {m}" for m in ("urban", "green", "water")) + " FROM cls GROUP BY ALL)",
    }
    last = list(all_steps).index(steps[0])
    return "WITH " + ",\n".join(list(all_steps.values())[:last + 1])


@query("F3_limit_scenes", _cte("sc") + " SELECT city_id, year, scene_id FROM sc")
def limit_scenes(t):
    return R.limit_scenes(pixels(t).where("scene_cloud_pct < 50")).select("city_id", "year", "scene_id")


@query("K1_scene_filter", _cte("kept") + " SELECT city_id, year, scene_id, count(*) AS n_pixels, sum(b2) AS total_b2 FROM kept WHERE year IN (1996,1997,1998,2000) GROUP BY ALL")
def scene_filter(t):
    return R.scene_filter(pixels(t), [1996, 1997, 1998, 2000]).groupBy("city_id", "year", "scene_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("b2").alias("total_b2"))


def masked(t):
    return R.cloud_mask(R.scene_filter(pixels(t)))


@query("K2_cloud_mask", _cte("mask") + " SELECT city_id, year, scene_id, count(*) AS n_clear, count(cloud_prob) AS n_with_probability FROM mask GROUP BY ALL")
def cloud_mask(t):
    return masked(t).groupBy("city_id", "year", "scene_id").agg(
        F.count(F.lit(1)).alias("n_clear"), F.count("cloud_prob").alias("n_with_probability"))


def composite(t):
    return R.median_composite(masked(t))


def indices(t):
    """The index table, written once for the thresholds and the flags that read it."""
    return materialise(R.spectral_indices(composite(t)), "indices")


@query("K3_median_composite", _cte("comp") + " SELECT city_id, year, px, py, " + ", ".join(f"round({b},14) AS {b}" for b in R.BANDS) + " FROM comp")
def median_composite(t):
    return composite(t).withColumns({b: F.round(b, 14) for b in R.BANDS})


_INDICES = ("ndwi", "ndbi", "ndvi", "gndvi", "mndwi", "evi", "aweish")


@query("K4_spectral_indices", _cte("idx") + " SELECT city_id, year, px, py, " + ", ".join(f"round({i},{14 if i == 'aweish' else 9}) AS {i}" for i in _INDICES) + " FROM idx")
def spectral_indices(t):
    return R.spectral_indices(composite(t)).withColumns({i: F.round(i, 14 if i == "aweish" else 9) for i in _INDICES})


@query("K5_index_histogram", _cte("hist") + " SELECT city_id, year, bin, n, round(bin_mean,8) AS bin_mean FROM hist")
def index_histogram(t):
    return R.index_histogram(R.spectral_indices(composite(t))).withColumn("bin_mean", F.round("bin_mean", 8))


@query("K6_otsu_threshold", _cte("otsu") + " SELECT city_id, year, round(threshold,8) AS threshold FROM otsu")
def otsu_threshold(t):
    out = R.otsu_threshold(R.index_histogram(R.spectral_indices(composite(t))))
    return out.withColumn("threshold", F.round("threshold", 8))


@query("F4_argmax_threshold", """WITH hist AS (SELECT s_nationkey AS city_id, CAST(greatest(0,least(19,floor((s_acctbal+1000)/600))) AS INTEGER) AS bin, count(*) AS n, avg(s_acctbal) AS bin_mean FROM supplier GROUP BY ALL),
 run AS (SELECT *, sum(n) OVER w AS wb, sum(n*bin_mean) OVER w AS sb, sum(n) OVER g AS wt, sum(n*bin_mean) OVER g AS st FROM hist WINDOW w AS (PARTITION BY city_id ORDER BY bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY city_id)),
 btw AS (SELECT *, CASE WHEN wt>wb THEN round(wb*(wt-wb)*power(sb/wb-(st-sb)/(wt-wb),2),6) END AS v FROM run)
 SELECT city_id AS nation, round(CASE WHEN v IS NOT NULL THEN bin_mean END,6) AS threshold FROM btw QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY v DESC NULLS LAST, bin)=1""")
def argmax_threshold(t):
    """The balance that splits each nation's suppliers into two groups with the largest variance between them."""
    rows = t.supplier.select(F.col("s_nationkey").alias("city_id"), F.lit(0).alias("year"), "s_acctbal")
    out = R.otsu_threshold(R.index_histogram(rows, "s_acctbal", 20, -1000.0, 11000.0))
    return out.select(F.col("city_id").alias("nation"), F.round("threshold", 6).alias("threshold"))


@query("K7_percentile_threshold", _cte("pct") + " SELECT city_id, year, " + ", ".join(f"round({n},7) AS {n}" for n in R.PERCENTILES) + " FROM pct")
def percentile_threshold(t):
    return R.percentile_thresholds(indices(t)).withColumns({n: F.round(n, 7) for n in R.PERCENTILES})


@query("K8_classify_masks", _cte("cls") + " SELECT * FROM cls")
def classify_masks(t):
    idx = indices(t)
    return R.classify(idx, R.otsu_threshold(R.index_histogram(idx)), R.percentile_thresholds(idx))


@query("K9_area_km2", _cte("area") + " SELECT * FROM area")
def area_km2(t):
    return R.land_cover(pixels(t)).withColumns({m: F.round(m, 6) for m in ("urban", "green", "water")})


@query("K10_area_table", _cte("area") + """ SELECT n_nationkey::BIGINT AS city_id, y.year AS year, urban, green, water FROM nation
 CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y LEFT JOIN area a ON a.city_id=n_nationkey AND a.year=y.year""")
def area_table(t):
    areas = R.land_cover(pixels(t)).withColumns({m: F.round(m, 6) for m in ("urban", "green", "water")})
    years = t.lineitem.select(F.year("l_shipdate").alias("year")).distinct()
    return R.area_table(areas, t.nation.select(F.col("n_nationkey").cast("bigint").alias("city_id")), years)
