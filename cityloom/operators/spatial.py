"""Distance features and spatial joins on grid cells. Pairs of rows are never emitted: one side
is packed into bounded arrays, distances are taken inside the row, and only results leave it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import distance, point_segment_distance, project_point, ray_crosses, segment_segment_distance
from .scale import BLOCK_ROWS, blocks, materialise, salted_join

NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


# -- sums over all points ---------------------------------------------------------------------

def distance_sums(cities: DataFrame, points: DataFrame, key: str, point_key: str,
                  weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Per city (and per ``by`` of the points) over all points, in km: ``n, sum_km, min_km, max_km, sum_wkm, sum_w``.

    Both sides carry ``x, y`` in metres. Points are packed into blocks; each city meets each
    block once through an equi-join on the block and adds up one partial result."""
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    packed = blocks(points.select(*by, point_key, "x", "y", w.alias("w")), by, [point_key], ["x", "y", "w"]).drop("n_blocks")
    listed = packed.agg(F.collect_list(F.struct(*by, "block"))).scalar()  # one entry for each 512 points
    left = cities.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), F.inline(listed))
    both = left.join(packed, [*by, "block"]).withColumn("km", F.transform(
        "items", lambda p: distance(p["x"], p["y"], F.col("_x"), F.col("_y")) / 1000))
    add = lambda s, v: s + v
    part = both.select(
        key, *by, F.size("km").alias("n"), F.aggregate("km", F.lit(0.0), add).alias("s"),
        F.array_min("km").alias("lo"), F.array_max("km").alias("hi"),
        F.aggregate(F.zip_with("km", "items", lambda d, p: d * p["w"]), F.lit(0.0), add).alias("sw"),
        F.aggregate("items", F.lit(0.0), lambda s, p: s + p["w"]).alias("w"))
    return part.groupBy(key, *by).agg(
        F.sum("n").alias("n"), F.sum("s").alias("sum_km"), F.min("lo").alias("min_km"),
        F.max("hi").alias("max_km"), F.sum("sw").alias("sum_wkm"), F.sum("w").alias("sum_w"))


def weighted_mean_distance(cities, points, key, point_key, weight, by: list[str] | None = None) -> DataFrame:
    """Mean km to the entry points, weighted by what arrived through each."""
    sums = distance_sums(cities, points, key, point_key, weight, by)
    return sums.select(key, *(by or []), F.try_divide("sum_wkm", "sum_w").alias("distance_km"))


def popularity_distance(cities: DataFrame, key: str, attractions, w_reviews: float = 0.6,
                        w_rating: float = 0.4, zone: int = 18) -> DataFrame:
    """Closeness to a fixed list ``(name, lat, lng, reviews, rating)``.

    Kilometres are scaled to 0..1 over all pairs, reviews and rating over the list; because only
    kilometres differ by city, each city needs its sum and the global extremes."""
    reviews, ratings = [float(a[3]) for a in attractions], [float(a[4]) for a in attractions]

    def scaled_total(v):
        lo, hi = min(v), max(v)
        return sum((x - lo) / (hi - lo) for x in v) if hi > lo else 0.0

    rev, rat, n = scaled_total(reviews), scaled_total(ratings), len(attractions)
    at = [project_point(a[2], a[1], zone) for a in attractions]
    spots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in at])
    km = F.transform(spots, lambda p: distance(p["x"], p["y"], F.col("x"), F.col("y")) / 1000)
    per = cities.select(key, km.alias("km")).select(
        key, F.aggregate("km", F.lit(0.0), lambda s, v: s + v).alias("s"),
        F.array_min("km").alias("lo"), F.array_max("km").alias("hi"))
    lim = per.agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("l")).scalar()
    span = F.nullif(F.col("_l.hi") - F.col("_l.lo"), F.lit(0.0))
    scaled = F.coalesce((F.col("s") - n * F.col("_l.lo")) / span, F.lit(0.0))
    return per.withColumn("_l", lim).select(
        key, ((scaled + w_reviews * rev + w_rating * rat) / (rev + rat)).alias("top_distance"))


def minmax(df: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Scale columns to 0..1 over the whole table or each ``by`` (new name -> column); a constant becomes 0."""
    limits = F.struct(*[f(c).alias(f"{n}_{t}") for n, c in columns.items() for f, t in ((F.min, "lo"), (F.max, "hi"))]).alias("_l")
    out = df.join(df.groupBy(*by).agg(limits), by) if by else df.withColumn("_l", df.agg(limits).scalar())
    for n, c in columns.items():
        lo, hi = F.col(f"_l.{n}_lo"), F.col(f"_l.{n}_hi")
        out = out.withColumn(n, F.when(F.col(c).isNotNull(), F.coalesce(
            (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0)).cast("double"), F.lit(0.0))))
    return out.drop("_l")


def access_importance(points: DataFrame, department: str, people: str, w_points: float = 0.3,
                      w_people: float = 0.7, by: list[str] | None = None) -> DataFrame:
    """Score per department from its number of entry points and the people through them."""
    by = by or []
    per = points.groupBy(*by, department).agg(F.count(F.lit(1)).alias("points"), F.sum(people).alias("people"))
    scaled = minmax(per, {"p": "points", "q": "people"}, by)
    return scaled.select(*by, department, "points", "people",
                         (w_points * F.col("p") + w_people * F.col("q")).alias("access_importance"))


# -- grid cells -------------------------------------------------------------------------------

def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def _span_cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(cell(lo, size), cell(hi, size))


def segment_cells(segs: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """One row per (segment, cell) that holds a part of the segment, ``cx, cy``. Long segments
    are cut into pieces of at most one cell, so a diagonal does not fill its whole box."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / F.lit(float(size)))).cast("int")
    cut = segs.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    ax, ay = F.col("x1") + dx * F.col("_i") / F.col("_n"), F.col("y1") + dy * F.col("_i") / F.col("_n")
    bx, by = F.col("x1") + dx * (F.col("_i") + 1) / F.col("_n"), F.col("y1") + dy * (F.col("_i") + 1) / F.col("_n")
    return (cut.withColumn("cx", F.explode(_span_cells(F.least(ax, bx) - grow, F.greatest(ax, bx) + grow, size)))
            .withColumn("cy", F.explode(_span_cells(F.least(ay, by) - grow, F.greatest(ay, by) + grow, size)))
            .drop("_n", "_i").distinct())


def points_in_polygons(points: DataFrame, segs: DataFrame, point_key: str, poly_key: str, size: float) -> DataFrame:
    """(point, polygon) for every polygon that holds the point: even-odd rule over edges.

    A cell join on polygon boxes gives the candidates; only edges of a candidate in the point's
    own horizontal strip can cross its ray."""
    box = segs.groupBy(poly_key).agg(*[f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for f, a, b, n in (
        (F.min, "x1", "x2", "lx"), (F.max, "x1", "x2", "hx"), (F.min, "y1", "y2", "ly"), (F.max, "y1", "y2", "hy"))])
    box = box.withColumn("cx", F.explode(_span_cells(F.col("lx"), F.col("hx"), size))).withColumn(
        "cy", F.explode(_span_cells(F.col("ly"), F.col("hy"), size)))
    pts = points.select(point_key, F.col("x").alias("px"), F.col("y").alias("py"),
                        cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    near = salted_join(pts, box, ["cx", "cy"], [point_key]).where(
        "px between lx and hx and py between ly and hy").select(point_key, poly_key, "px", "py", "cy")
    strips = segs.select(poly_key, "x1", "y1", "x2", "y2").withColumn("cy", F.explode(
        _span_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
    packed = blocks(strips, [poly_key, "cy"], ["x1", "y1", "x2", "y2"], ["x1", "y1", "x2", "y2"])
    hit = salted_join(near, packed, [poly_key, "cy"], [point_key]).select(
        point_key, poly_key, F.size(F.filter("items", lambda e: ray_crosses(F.col("px"), F.col("py"), e))).alias("n"))
    return hit.groupBy(point_key, poly_key).agg(F.sum("n").alias("n")).where("n % 2 = 1").select(point_key, poly_key)


def _levels(frames: list[tuple[DataFrame, list[str], list[str]]], size: float) -> int:
    """Doublings of ``size`` after which one cell is as wide as everything."""
    lo_x, hi_x, lo_y, hi_y = [], [], [], []
    for df, xs, ys in frames:
        row = df.agg(*[F.min(F.least(F.col(c[0]), F.col(c[-1]))) for c in (xs, ys)],
                     *[F.max(F.greatest(F.col(c[0]), F.col(c[-1]))) for c in (xs, ys)]).first()
        if row[0] is None:
            continue
        lo_x.append(row[0]); lo_y.append(row[1]); hi_x.append(row[2]); hi_y.append(row[3])
    if not lo_x:
        return 0
    extent = max(max(hi_x) - min(lo_x), max(hi_y) - min(lo_y), size)
    return max(0, math.ceil(math.log2(extent / size)))


def _first_level(cells: DataFrame, occupied: DataFrame, group: list[str], top: int, k: int) -> DataFrame:
    """For each point cell the lowest level whose 3 x 3 cells hold at least ``k`` items."""
    probes = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    found = (_neighbour_cells(probes, keep_cell=True).join(occupied, [*group, "level", "lx", "ly"])
             .groupBy(*group, "cx", "cy", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
             .groupBy(*group, "cx", "cy").agg(F.min("level").alias("level")))
    return cells.join(found, [*group, "cx", "cy"], "left").withColumn("level", F.coalesce("level", F.lit(top)))


def _neighbour_cells(points: DataFrame, keep_cell: bool = False) -> DataFrame:
    """Nine rows per point: its cell of ``level`` and the cells around it, ``lx, ly``."""
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS]))
    out = points.withColumn("_d", d).withColumns({
        "lx": F.expr("shiftright(cx, level)") + F.col("_d.i"),
        "ly": F.expr("shiftright(cy, level)") + F.col("_d.j")}).drop("_d")
    return out if keep_cell else out.drop("cx", "cy")


def _reach(size: float) -> Column:
    """How far the 3 x 3 cells of ``level`` reach around any point of the middle cell."""
    return F.lit(float(size)) * F.expr("shiftleft(1L, level)")


def _level_for(distance_: Column, size: float, top: int) -> Column:
    """The lowest level that reaches ``distance_``; null asks for everything."""
    up = F.ceil(F.log2(F.greatest(distance_, F.lit(float(size))) / F.lit(float(size))) + 1e-9)
    return F.coalesce(F.least(F.lit(top), up.cast("int")), F.lit(top))


def _at_levels(df: DataFrame, top: int) -> DataFrame:
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns(
        {"lx": F.expr("shiftright(cx, level)"), "ly": F.expr("shiftright(cy, level)")}).drop("cx", "cy").distinct()


def nearest_polygon(points: DataFrame, segs: DataFrame, point_key: str, poly_key: str, size: float) -> DataFrame:
    """(point, polygon, distance): the nearest polygons of each point, 0 inside, ties kept.

    ``size`` is the finest cell, about one polygon wide or smaller."""
    inside = points_in_polygons(points, segs, point_key, poly_key, size).withColumn("distance", F.lit(0.0))
    at = points.select(point_key, F.col("x").alias("px"), F.col("y").alias("py"),
                       cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    top = _levels([(points, ["x"], ["y"]), (segs, ["x1", "x2"], ["y1", "y2"])], size)
    placed = _at_levels(segment_cells(segs.select(poly_key, "x1", "y1", "x2", "y2"), size), top)
    occupied = placed.groupBy("level", "lx", "ly").agg(F.count(F.lit(1)).alias("n"))
    levels = _first_level(at.select("cx", "cy").distinct(), occupied, [], top, 1)
    packed = blocks(placed, ["level", "lx", "ly"], [poly_key, "x1", "y1", "x2", "y2"],
                    [poly_key, "x1", "y1", "x2", "y2"])

    def search(pts: DataFrame) -> DataFrame:
        met = salted_join(_neighbour_cells(pts), packed, ["level", "lx", "ly"], [point_key])
        near = met.select(point_key, "px", "py", "level", F.transform("items", lambda s: F.struct(
            point_segment_distance(F.col("px"), F.col("py"), s["x1"], s["y1"], s["x2"], s["y2"]).alias("d"),
            s[poly_key].alias("p"))).alias("_c")).withColumn("_m", F.array_min("_c")["d"])
        ties = F.array_distinct(F.transform(F.filter("_c", lambda c: c["d"] == F.col("_m")), lambda c: c["p"]))
        return near.select(point_key, "px", "py", "level", "_m", ties.alias("_t"))

    # What the first cells give is final when it lies within their reach; it bounds the search otherwise.
    first = materialise(search(salted_join(at, levels, ["cx", "cy"], [point_key])).withColumn(
        "_b", F.min("_m").over(W.partitionBy(point_key))).where("_m = _b"), "near")
    final = (F.col("_b") <= _reach(size)) | (F.col("level") == top)
    rest = first.where(~final).select(point_key, "px", "py", _level_for(F.col("_b"), size, top).alias("level"),
                                      cell(F.col("px"), size).alias("cx"), cell(F.col("py"), size).alias("cy")).distinct()
    found = first.where(final).select(point_key, "_m", "_t").unionByName(search(rest).select(point_key, "_m", "_t"))
    edge = found.select(point_key, F.explode("_t").alias(poly_key), F.col("_m").alias("distance"))
    best = inside.select(point_key, poly_key, "distance").unionByName(edge)
    best = best.groupBy(point_key, poly_key).agg(F.min("distance").alias("distance"))
    return best.withColumn("_r", F.rank().over(W.partitionBy(point_key).orderBy("distance"))).where("_r = 1").drop("_r")


def roads_within(outlines: DataFrame, roads: DataFrame, city_key: str, road_key: str, metres: float, size: float) -> DataFrame:
    """Roads per city that come within ``metres`` of its outline or lie inside it; 0 when none."""
    seg = ["x1", "y1", "x2", "y2"]
    c = materialise(segment_cells(outlines.select(city_key, *seg), size), "outlines")
    r = segment_cells(roads.select(road_key, *seg), size, grow=metres).join(c.select("cx", "cy"), ["cx", "cy"], "left_semi")
    c_packed = blocks(c, [city_key, "cx", "cy"], seg, seg, "cs")
    r_packed = blocks(r, ["cx", "cy"], [road_key, *seg], [road_key, *seg], "rs")
    met = salted_join(r_packed, c_packed.drop("block", "n_blocks"), ["cx", "cy"], ["block"])
    close = F.filter("rs", lambda a: F.exists("cs", lambda b: segment_segment_distance(a, b) <= metres))
    near = met.select(city_key, F.explode(F.array_distinct(F.transform(close, lambda a: a[road_key]))).alias(road_key))
    starts = roads.select(F.struct(road_key, *seg).alias("_p"), road_key, F.col("x1").alias("x"), F.col("y1").alias("y"))
    inner = points_in_polygons(starts.select("_p", "x", "y").distinct(), outlines, "_p", city_key, size)
    held = inner.select(city_key, F.col(f"_p.{road_key}").alias(road_key)).distinct()
    pairs = near.unionByName(held).distinct()
    n = pairs.groupBy(city_key).agg(F.count(F.lit(1)).alias("roads"))
    return outlines.select(city_key).distinct().join(n, city_key, "left").na.fill(0, ["roads"])


def nearest_k(targets: DataFrame, donors: DataFrame, group: list[str], target_key: str, donor_key: str,
              k: int, size: float, fields: list[str]) -> DataFrame:
    """The k nearest donors (``x, y``) of each target inside its group, all of them when fewer:
    ``(group..., target, rank, distance, donor, fields...)``, ties by donor key."""
    d = donors.select(*group, donor_key, "x", "y", *fields).withColumns(
        {"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    t = targets.select(*group, target_key, F.col("x").alias("px"), F.col("y").alias("py")).withColumns(
        {"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})
    top = _levels([(targets, ["x"], ["y"]), (donors, ["x"], ["y"])], size)
    placed = _at_levels(d, top)
    occupied = placed.groupBy(*group, "level", "lx", "ly").agg(F.count(F.lit(1)).alias("n"))
    levels = _first_level(t.select(*group, "cx", "cy").distinct(), occupied, group, top, k)
    at = [*group, "level", "lx", "ly"]
    item = [donor_key, "x", "y", *fields]
    packed = blocks(placed, at, [donor_key], item)
    w = W.partitionBy(*group, target_key)

    def search(pts: DataFrame) -> DataFrame:
        met = salted_join(_neighbour_cells(pts), packed, at, [target_key])
        scored = F.transform("items", lambda s: F.struct(
            distance(s["x"], s["y"], F.col("px"), F.col("py")).alias("distance"), s[donor_key].alias(donor_key),
            *[s[f].alias(f) for f in ["x", "y", *fields]]))
        best = met.select(*group, target_key, "px", "py", "level", F.inline(F.slice(F.array_sort(scored), 1, k)))
        return best.withColumn("rank", F.row_number().over(w.orderBy("distance", donor_key))).where(F.col("rank") <= k)

    # The k found first are final when the last of them lies within reach; it bounds the search otherwise.
    start = salted_join(t, levels, [*group, "cx", "cy"], [target_key])
    first = materialise(search(start).withColumn("_b", F.max("distance").over(w)).withColumn("_n", F.count(F.lit(1)).over(w)), "near")
    final = ((F.col("_n") >= k) & (F.col("_b") <= _reach(size))) | (F.col("level") == top)
    bound = _level_for(F.when(F.col("_n") >= k, F.col("_b")), size, top)
    rest = first.where(~final).select(*group, target_key, "px", "py", bound.alias("level"),
                                      cell(F.col("px"), size).alias("cx"), cell(F.col("py"), size).alias("cy")).distinct()
    out = [*group, target_key, "rank", "distance", donor_key, "x", "y", *fields]
    return first.where(final).select(*out).unionByName(search(rest).select(*out))
