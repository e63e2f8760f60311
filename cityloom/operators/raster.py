"""Land cover from a pixel table: scene choice, cloud mask, composite, indices, thresholds, areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import exact_quantiles, materialise, salted_join

CITY_YEAR = ["city_id", "year"]
PIXEL = [*CITY_YEAR, "px", "py"]
BANDS = ["b2", "b3", "b4", "b8", "b11", "b12"]

# Percentile of each index used as a threshold.
PERCENTILES = {
    "ndvi_urban": ("ndvi", 0.55), "evi_urban": ("evi", 0.45),
    "ndvi_green": ("ndvi", 0.86), "evi_green": ("evi", 0.81), "gndvi_green": ("gndvi", 0.86),
    "ndwi_water": ("ndwi", 0.91), "mndwi_water": ("mndwi", 0.91), "aweish_water": ("aweish", 0.92),
}
# Scene cloud limit, pixel cloud limit, scenes per city-year, fallback cut, pixel size.
MAX_SCENE_CLOUD, MAX_PIXEL_CLOUD, MAX_SCENES, DEFAULT_NDBI, KM2_PER_PIXEL = 50, 40, 55, 0.2, 1e-4


def limit_scenes(pixels: DataFrame, n: int = MAX_SCENES) -> DataFrame:
    """The first ``n`` scenes of each city-year by time; ranks scenes, not pixels."""
    scenes = pixels.select(*CITY_YEAR, "scene_id", "scene_ts").distinct()
    first = W.partitionBy(*CITY_YEAR).orderBy("scene_ts", "scene_id")
    return scenes.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r")


def scene_filter(pixels: DataFrame, years: list[int] | None = None, max_cloud: float = MAX_SCENE_CLOUD,
                 n: int = MAX_SCENES) -> DataFrame:
    """Pixels of the scenes used: below the cloud limit, in the years asked for, at most ``n``."""
    kept = pixels.where(F.col("scene_cloud_pct") < max_cloud)
    if years:
        kept = kept.where(F.col("year").isin(years))
    chosen = limit_scenes(kept, n).select(*CITY_YEAR, "scene_id")
    return salted_join(kept, chosen, [*CITY_YEAR, "scene_id"], ["px", "py"], "left_semi")


def cloud_mask(pixels: DataFrame, limit: int = MAX_PIXEL_CLOUD) -> DataFrame:
    """Drop cloudy pixels; pixels of scenes without a probability layer pass."""
    return pixels.where(F.coalesce(F.col("cloud_prob") < limit, F.lit(True)))


def median_composite(pixels: DataFrame, scale: float = 0.0001) -> DataFrame:
    """Per pixel and band the median over its (at most 55) scenes, as reflectance."""
    return pixels.groupBy(*PIXEL).agg(*[(F.median(b) * scale).alias(b) for b in BANDS])


def normalized_difference(a: str, b: str) -> Column:
    """(a - b) / (a + b); null for negative inputs or a zero sum."""
    x, y = F.col(a), F.col(b)
    return F.when((x >= 0) & (y >= 0), F.try_divide(x - y, x + y))


def spectral_indices(composite: DataFrame) -> DataFrame:
    b2, b3, b4, b8, b11, b12 = (F.col(b) for b in BANDS)
    return composite.select(
        *PIXEL,
        normalized_difference("b3", "b8").alias("ndwi"),
        normalized_difference("b11", "b8").alias("ndbi"),
        normalized_difference("b8", "b4").alias("ndvi"),
        normalized_difference("b8", "b3").alias("gndvi"),
        normalized_difference("b3", "b11").alias("mndwi"),
        F.try_divide(2.5 * (b8 - b4), b8 + 6 * b4 - 7.5 * b2 + 1).alias("evi"),
        (b3 + 2.5 * b8 - 1.5 * (b11 + b12) - 0.25 * b2).alias("aweish"),
    )


def index_histogram(indices: DataFrame, index: str = "ndbi", bins: int = 255, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """(city, year, bin, n, bin_mean) over equal-width bins."""
    pos = F.floor((F.col(index) - lo) / ((hi - lo) / bins))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), pos)).cast("int")
    return indices.where(F.col(index).isNotNull()).groupBy(*CITY_YEAR, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(index).alias("bin_mean"))


def otsu_threshold(histogram: DataFrame) -> DataFrame:
    """(city, year, threshold): mean of the last background bin of the split with the largest
    between-class variance; the earliest split wins ties. One bin gives no split, hence null."""
    w = W.partitionBy(*CITY_YEAR).orderBy("bin")
    up_to, whole = w.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(*CITY_YEAR)
    mass = F.col("n") * F.col("bin_mean")
    h = histogram.select("*", F.sum("n").over(up_to).alias("wb"), F.sum(mass).over(up_to).alias("sb"),
                         F.sum("n").over(whole).alias("wt"), F.sum(mass).over(whole).alias("st"))
    wf = F.col("wt") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - F.try_divide(F.col("st") - F.col("sb"), wf)
    h = h.withColumn("between", F.when(wf > 0, F.round(F.col("wb") * wf * gap * gap, 6)))
    best = F.max_by("bin_mean", F.when(F.col("between").isNotNull(), F.struct("between", (-F.col("bin")).alias("b"))))
    return h.groupBy(*CITY_YEAR).agg(best.alias("threshold"))


def percentile_thresholds(indices: DataFrame, wanted: dict[str, tuple[str, float]] = PERCENTILES) -> DataFrame:
    """One row per city-year with every wanted percentile, exact."""
    names = sorted({i for i, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    long = indices.select(*CITY_YEAR, *names).unpivot(CITY_YEAR, names, "index", "value")
    q = exact_quantiles(long, [*CITY_YEAR, "index"], "value", probs, [f"q{i}" for i in range(len(probs))])
    return q.groupBy(*CITY_YEAR).agg(*[
        F.max(F.when(F.col("index") == i, F.col(f"q{probs.index(p)}"))).alias(n) for n, (i, p) in wanted.items()])


def classify(indices: DataFrame, otsu: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Urban, green and water flags per pixel."""
    cuts = thresholds.join(otsu, CITY_YEAR, "left").withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_NDBI)))
    j = salted_join(indices, cuts, CITY_YEAR, ["px", "py"])
    c = F.col
    return j.select(
        *PIXEL,
        ((c("ndbi") > c("threshold")) & (c("evi") < c("evi_urban")) & (c("ndvi") < c("ndvi_urban")) & (c("ndwi") < 0)).alias("urban"),
        ((c("ndvi") > c("ndvi_green")) & (c("evi") > c("evi_green")) & (c("gndvi") > c("gndvi_green"))).alias("green"),
        ((c("ndwi") > c("ndwi_water")) & (c("mndwi") > c("mndwi_water")) & (c("aweish") > c("aweish_water"))).alias("water"))


def areas_km2(flags: DataFrame) -> DataFrame:
    return flags.groupBy(*CITY_YEAR).agg(*[(F.count_if(F.col(m)) * KM2_PER_PIXEL).alias(m) for m in ("urban", "green", "water")])


def area_table(areas: DataFrame, cities: DataFrame, years: DataFrame) -> DataFrame:
    """Every city in every year of ``years``; pairs without scenes have null areas."""
    wanted = years.agg(F.array_sort(F.collect_set("year"))).scalar()
    return cities.select("city_id", F.explode(wanted).alias("year")).join(areas, CITY_YEAR, "left")


def land_cover(pixels: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Pixels to areas per city and year."""
    composite = median_composite(cloud_mask(scene_filter(pixels, years)))
    idx = materialise(spectral_indices(composite), "indices")
    return areas_km2(classify(idx, otsu_threshold(index_histogram(idx)), percentile_thresholds(idx)))
