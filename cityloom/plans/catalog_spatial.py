"""Checked queries: projection, distances, spatial joins, variograms and kriging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ATTRACTIONS
from ..functions.geo import distance, utm_sql
from ..operators import kriging as K
from ..operators import spatial as S
from .catalog_sources import ATTRACTION_VALUES
from .registry import query
from .tables import utm, with_roles

_X, _Y = utm_sql("lng", "lat", 18)
_AX, _AY = utm_sql("alng", "alat", 18)


def squares(t, half: float = 0.4, scale: float = 1.0):
    """City outlines: a square around each city, as a segment table."""
    x, y = F.col("lng") * scale, F.col("lat") * scale
    sides = [(-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)]
    segs = F.array(*[F.struct((x + a * half).alias("x1"), (y + b * half).alias("y1"), (x + c * half).alias("x2"),
                              (y + d * half).alias("y2")) for a, b, c, d in sides])
    return t.cities.select("city_id", F.inline(segs))


_SQUARES = """sides(a,b,c,d) AS (VALUES (-1,-1,1,-1),(1,-1,1,1),(1,1,-1,1),(-1,1,-1,-1)),
sq AS (SELECT city_id, lng*{s}+a*{h} AS x1, lat*{s}+b*{h} AS y1, lng*{s}+c*{h} AS x2, lat*{s}+d*{h} AS y2 FROM cities, sides)"""
_SQ1 = _SQUARES.format(s="1.0::DOUBLE", h="0.4::DOUBLE")



def _nearest_sql(points: str) -> str:
    """Nearest square of each row of ``points(pid, px, py)``: all pairs, for small data only."""
    return f"""pp AS ({points}), dd AS (SELECT pid, city_id,
  sqrt(power(px-(x1+t*(x2-x1)),2)+power(py-(y1+t*(y2-y1)),2)) AS d, crosses FROM
  (SELECT *, greatest(0.0, least(1.0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t,
    CASE WHEN (y1>py)<>(y2>py) THEN (px < x1+(py-y1)/(y2-y1)*(x2-x1))::INT ELSE 0 END AS crosses FROM pp, sq)),
 pd AS (SELECT pid, city_id, CASE WHEN sum(crosses)%2=1 THEN 0.0 ELSE min(d) END AS distance FROM dd GROUP BY ALL),
 nearest AS (SELECT pid, city_id, distance FROM pd QUALIFY rank() OVER (PARTITION BY pid ORDER BY distance)=1)"""


@query("I1_make_point", with_roles("places") + " SELECT place_id, round(lng,6) AS x, round(lat,6) AS y FROM places")
def make_point(t):
    return t.places.select("place_id", F.round("lng", 6).alias("x"), F.round("lat", 6).alias("y"))


@query("I2_project_utm", with_roles("places") + f" SELECT place_id, round({_X},3) AS x, round({_Y},3) AS y FROM places")
def project(t):
    return utm(t.places).select("place_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("I3_planar_distance", with_roles("places", "cities") + f""", a AS (SELECT place_id, city_id, {_X} AS x, {_Y} AS y FROM places),
 b AS (SELECT city_id, {_X} AS x, {_Y} AS y FROM cities)
 SELECT place_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/1000,5) AS km FROM a JOIN b USING (city_id)""")
def planar_distance(t):
    own = utm(t.cities).select("city_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    p = utm(t.places).join(own, "city_id")
    return p.select("place_id", F.round(distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) / 1000, 5).alias("km"))


_PAIRS = with_roles("cities", "entry_points") + f""", c AS (SELECT city_id, {_X} AS cx, {_Y} AS cy FROM cities), p AS (SELECT point_id, weight, {_X} AS px, {_Y} AS py FROM entry_points),
 pairs AS (SELECT city_id, weight, sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy))/1000 AS km FROM c, p)"""


@query("C5_cross_pairs", _PAIRS + """ SELECT city_id, count(*) AS n_pairs, round(sum(km),3) AS sum_km, round(min(km),5) AS nearest_km, round(max(km),5) AS farthest_km FROM pairs GROUP BY 1""")
def cross_pairs(t):
    s = S.distance_sums(utm(t.cities), utm(t.entry_points), "city_id", "point_id")
    return s.select("city_id", F.col("n").alias("n_pairs"), F.round("sum_km", 3).alias("sum_km"),
                    F.round("min_km", 5).alias("nearest_km"), F.round("max_km", 5).alias("farthest_km"))


@query("D8_weighted_mean_distance", _PAIRS + " SELECT city_id, round(sum(km*weight)/sum(weight),5) AS distance_km FROM pairs GROUP BY 1")
def weighted_mean_distance(t):
    d = S.weighted_mean_distance(utm(t.cities), utm(t.entry_points), "city_id", "point_id", "weight")
    return d.withColumn("distance_km", F.round("distance_km", 5))


@query("D9_popularity_distance", with_roles("places") + f""", a(n, alat, alng, reviews, rating) AS (VALUES {ATTRACTION_VALUES}),
 c AS (SELECT place_id, {_X} AS cx, {_Y} AS cy FROM places), p AS (SELECT reviews, rating, {_AX} AS px, {_AY} AS py FROM a),
 pairs AS (SELECT place_id, reviews, rating, sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy))/1000 AS km FROM c, p),
 l AS (SELECT min(km) AS k0, max(km) AS k1, min(reviews) AS r0, max(reviews) AS r1, min(rating) AS s0, max(rating) AS s1 FROM pairs),
 z AS (SELECT place_id, (km-k0)/(k1-k0) AS k, (reviews-r0)/(r1-r0)::DOUBLE AS r, (rating-s0)/(s1-s0) AS s FROM pairs, l)
 SELECT place_id, round(sum(k+0.6*r+0.4*s)/(sum(r)+sum(s)),6) AS top_distance FROM z GROUP BY 1""")
def popularity_distance(t):
    return S.popularity_distance(utm(t.places), "place_id", ATTRACTIONS).withColumn("top_distance", F.round("top_distance", 6))


@query("L3_minmax", """SELECT c_custkey, round((c_acctbal-lo)/(hi-lo),8) AS balance, round((c_nationkey-n0)/(n1-n0)::DOUBLE,8) AS nation, 0.0 AS constant
 FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS n0, max(c_nationkey) AS n1 FROM customer)""")
def minmax(t):
    c = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", F.lit(7).alias("one"))
    out = S.minmax(c, {"balance": "c_acctbal", "nation": "c_nationkey", "constant": "one"})
    return out.select("c_custkey", F.round("balance", 8).alias("balance"), F.round("nation", 8).alias("nation"), "constant")


@query("C6_nearest_join", with_roles("cities", "places") + f", {_SQ1}, {_nearest_sql('SELECT place_id AS pid, lng AS px, lat AS py FROM places')} SELECT pid AS place_id, city_id, round(distance,6) AS distance FROM nearest")
def nearest_join(t):
    pts = t.places.select("place_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return S.nearest_polygon(pts, squares(t), "place_id", "city_id", 1.0).withColumn("distance", F.round("distance", 6))


def point_departments(t):
    """Each entry point with the department of its nearest city outline."""
    pts = t.entry_points.select("point_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    near = S.nearest_polygon(pts, squares(t), "point_id", "city_id", 1.0)
    return near.join(t.cities.select("city_id", "department"), "city_id").select("point_id", "department")


_DEP = f", {_SQ1}, {_nearest_sql('SELECT point_id AS pid, lng AS px, lat AS py FROM entry_points')}, dep AS (SELECT pid, department FROM nearest JOIN cities USING (city_id))"


@query("D10_access_importance", with_roles("cities", "entry_points") + _DEP + """, a AS (SELECT department, count(*) AS points, sum(weight) AS people FROM dep JOIN entry_points ON pid=point_id GROUP BY 1),
 l AS (SELECT min(points) AS p0, max(points) AS p1, min(people) AS q0, max(people) AS q1 FROM a),
 s AS (SELECT department, 0.3*(points-p0)/(p1-p0)+0.7*(people-q0)/(q1-q0) AS score FROM a, l)
 SELECT city_id, department, round(coalesce(score,0),6) AS access_importance FROM cities LEFT JOIN s USING (department)""")
def access_importance(t):
    pts = t.entry_points.select("point_id", "weight").join(point_departments(t), "point_id")
    score = S.access_importance(pts, "department", "weight").select("department", "access_importance")
    return (t.cities.select("city_id", "department").join(score, "department", "left").na.fill(0.0, ["access_importance"])
            .withColumn("access_importance", F.round("access_importance", 6)))


@query("D11_department_arrivals", with_roles("cities", "entry_points") + _DEP + """, f AS (SELECT department, year(l_shipdate) AS year, month(l_shipdate) AS month, sum(l_quantity) AS total FROM lineitem JOIN dep ON pid=l_suppkey GROUP BY ALL)
 SELECT city_id, department, y.year AS year, m.month AS month, coalesce(total,0) AS zone_entries FROM cities CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y CROSS JOIN (SELECT unnest(range(1,13)) AS month) m LEFT JOIN f USING (department, year, month)""")
def department_arrivals(t):
    period = [F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")]
    flows = t.lineitem.groupBy(F.col("l_suppkey").alias("point_id"), *period).agg(F.sum("l_quantity").alias("q"))
    by_dep = flows.join(point_departments(t), "point_id").groupBy("department", "year", "month").agg(F.sum("q").alias("zone_entries"))
    years = t.lineitem.agg(F.array_sort(F.collect_set(F.year("l_shipdate")))).scalar()
    cells = (t.cities.select("city_id", "department", F.explode(years).alias("year"))
             .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    return cells.join(by_dep, ["department", "year", "month"], "left").na.fill(0.0, ["zone_entries"])


def road_segments(t):
    """One road segment per event, in planar metres."""
    u, e = F.col("user_id"), F.col("event_id")
    x1 = ((u * 53) % 1300) * 1000.0 - 8000000.0 + F.col("value") * 100
    y1 = ((u * 37) % 1700) * 1000.0 - 400000.0
    return t.events.where("value is not null").select(
        e.alias("road_id"), x1.alias("x1"), y1.alias("y1"), (x1 + (e % 50) * 400.0).alias("x2"), (y1 + (e % 31 - 15) * 300.0).alias("y2"))


def _point_seg(px, py, a, b, c, d):
    t = f"coalesce(greatest(0.0, least(1.0, (({px}-{a})*({c}-{a})+({py}-{b})*({d}-{b}))/nullif(({c}-{a})*({c}-{a})+({d}-{b})*({d}-{b}),0))),0.0)"
    return f"sqrt(power({px}-({a}+{t}*({c}-{a})),2)+power({py}-({b}+{t}*({d}-{b})),2))"


def _side(ax, ay, bx, by, cx, cy):
    return f"(({bx}-{ax})*({cy}-{ay})-({by}-{ay})*({cx}-{ax}))"


_SEGSEG = (f"CASE WHEN {_side('x1','y1','x2','y2','u1','v1')}*{_side('x1','y1','x2','y2','u2','v2')}<0 AND "
           f"{_side('u1','v1','u2','v2','x1','y1')}*{_side('u1','v1','u2','v2','x2','y2')}<0 THEN 0.0 ELSE least("
           + ",".join(_point_seg(*a) for a in (("x1", "y1", "u1", "v1", "u2", "v2"), ("x2", "y2", "u1", "v1", "u2", "v2"),
                                               ("u1", "v1", "x1", "y1", "x2", "y2"), ("u2", "v2", "x1", "y1", "x2", "y2"))) + ") END")


@query("C7_within_distance_count", with_roles("cities") + ", " + _SQUARES.format(s="100000.0::DOUBLE", h="15000.0::DOUBLE") + f""",
 rd AS (SELECT road_id, u1, v1, u1+(road_id%50)*400.0::DOUBLE AS u2, v1+(road_id%31-15)*300.0::DOUBLE AS v2 FROM
  (SELECT event_id AS road_id, ((user_id*53)%1300)*1000.0::DOUBLE-8000000.0::DOUBLE+value*100 AS u1, ((user_id*37)%1700)*1000.0::DOUBLE-400000.0::DOUBLE AS v1 FROM events WHERE value IS NOT NULL)),
 hit AS (SELECT DISTINCT city_id, road_id FROM sq, rd WHERE {_SEGSEG} <= 10000
  UNION SELECT city_id, road_id FROM cities, rd WHERE abs(u1-lng*100000)<15000 AND abs(v1-lat*100000)<15000)
 SELECT c.city_id AS city_id, count(h.road_id) AS roads FROM cities c LEFT JOIN hit h ON c.city_id=h.city_id GROUP BY 1""")
def within_distance_count(t):
    return S.roads_within(squares(t, 15000.0, 100000.0), road_segments(t), "city_id", "road_id", 10000.0, 20000.0)


@query("C9_year_feature_join", with_roles("panel") + """, land AS (SELECT s_nationkey AS city_id, year(l_shipdate) AS year, sum(l_quantity) AS urban_area, count(*) AS pixels FROM lineitem JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL)
 SELECT city_id, year, month, visitors, urban_area, pixels FROM panel LEFT JOIN land USING (city_id, year)""")
def year_feature_join(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("city_id"))
    land = (t.lineitem.join(s, "l_suppkey").groupBy("city_id", F.year("l_shipdate").alias("year"))
            .agg(F.sum("l_quantity").alias("urban_area"), F.count(F.lit(1)).alias("pixels")))
    return t.panel.select("city_id", "year", "month", "visitors").join(land, ["city_id", "year"], "left")


def daily_stations(t):
    return t.readings.groupBy("station_id", "day", "x", "y").agg(F.avg("value").alias("value"))


_VARIO = with_roles("readings") + """, s AS (SELECT station_id, day, x, y, avg(value) AS v FROM readings WHERE value IS NOT NULL GROUP BY ALL),
 pr AS (SELECT a.day AS day, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, 0.5*(a.v-b.v)*(a.v-b.v) AS g FROM s a JOIN s b ON a.day=b.day AND a.station_id<b.station_id),
 l AS (SELECT day, min(d) AS lo, (max(d)-min(d))/6 AS step FROM pr GROUP BY 1),
 vg AS (SELECT day, CAST(least(5, floor((d-lo)/step)) AS INTEGER) AS lag, count(*) AS n_pairs, avg(d) AS distance, avg(g) AS semivariance FROM pr JOIN l USING (day) GROUP BY ALL)"""


@query("J1_empirical_variogram", _VARIO + " SELECT day, lag, n_pairs, round(distance,3) AS distance, round(semivariance,5) AS semivariance FROM vg")
def variogram(t):
    v = K.empirical_variogram(daily_stations(t), ["day"], "station_id", "value")
    return v.withColumns({"distance": F.round("distance", 3), "semivariance": F.round("semivariance", 5)})


@query("J2_spherical_fit", _VARIO + """, far AS (SELECT day, max(distance) AS f FROM vg GROUP BY 1),
 c AS (SELECT day, semivariance AS g, f*j/20 AS r, CASE WHEN distance<=f*j/20 THEN 1.5*(distance/(f*j/20))-0.5*power(distance/(f*j/20),3) ELSE 1.0 END AS s FROM vg JOIN far USING (day), (SELECT unnest(range(1,21)) AS j)),
 m AS (SELECT day, r, count(*)::DOUBLE AS n, sum(s) AS a, sum(s*s) AS b, sum(g) AS c, sum(s*g) AS d, sum(g*g) AS e FROM c GROUP BY ALL),
 k AS (SELECT *, CASE WHEN n*b-a*a>1e-12 THEN (n*d-a*c)/(n*b-a*a) END AS c1 FROM m), k2 AS (SELECT *, (c-c1*a)/n AS c0 FROM k),
 k3 AS (SELECT *, CASE WHEN c1 IS NULL OR c1<0 THEN 0.0 WHEN c0<0 THEN d/b ELSE c1 END AS p, CASE WHEN c1 IS NULL OR c1<0 THEN c/n WHEN c0<0 THEN 0.0 ELSE c0 END AS q FROM k2),
 k4 AS (SELECT *, e-2*q*c-2*p*d+n*q*q+2*p*q*a+p*p*b AS sse FROM k3)
 SELECT day, round(p,5) AS psill, round(r,3) AS range, round(q,5) AS nugget FROM k4 QUALIFY row_number() OVER (PARTITION BY day ORDER BY round(sse,6), r)=1""")
def spherical(t):
    v = K.empirical_variogram(daily_stations(t), ["day"], "station_id", "value")
    out = K.spherical_fit(v, ["day"])
    return out.select("day", F.round("psill", 5).alias("psill"), F.round("range", 3).alias("range"), F.round("nugget", 5).alias("nugget"))


def gappy_stations(t):
    """Every station on every day seen; days without a reading are null."""
    days = t.readings.agg(F.max("day")).first()[0]
    cells = t.readings.select("station_id", "x", "y").distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    return cells.join(daily_stations(t).select("station_id", "day", "value"), ["station_id", "day"], "left")


@query("J3_kriging_points")
def kriging_points(t):
    out = K.fill_by_kriging(gappy_stations(t), ["day"], "station_id", "value")
    return out.select("station_id", "day", F.round("value", 5).alias("value"))


@query("J4_kriging_surface")
def kriging_surface(t):
    k = F.col("user_id")
    obs = t.events.groupBy("event_type", k.alias("station_id"), (((k * 37) % 170) * 10000.0).alias("x"),
                           (((k * 53) % 130) * 10000.0 + (k % 7) * 1000.0).alias("y")).agg(F.avg("value").alias("value"))
    model = K.spherical_fit(K.empirical_variogram(obs, ["event_type"], "station_id", "value"), ["event_type"])
    grid = K.surface_targets(obs, ["event_type"], 100)
    est = K.krige(obs, grid, model, ["event_type"], "cell", "value")
    return est.select("event_type", "cell", F.round("estimate", 5).alias("estimate"))


@query("J3_kriging_at_stations", with_roles("readings") + """, s AS (SELECT station_id, day, x, y, avg(value) AS v FROM readings WHERE value IS NOT NULL GROUP BY ALL)
 SELECT station_id, day, round(v,6) AS observed, 0.0::DOUBLE AS error FROM (SELECT station_id, day, avg(v) OVER (PARTITION BY day, x, y) AS v FROM s)""")
def kriging_at_stations(t):
    """At a place with observations kriging gives their mean: the difference is none to six decimals."""
    seen = daily_stations(t).where("value IS NOT NULL")
    model = K.spherical_fit(K.empirical_variogram(seen, ["day"], "station_id", "value"), ["day"])
    out = K.krige(seen, seen, model, ["day"], "station_id", "value")
    places = seen.groupBy("day", "x", "y").agg(F.avg("value").alias("observed"))
    out = seen.select("station_id", "day", "x", "y").join(places, ["day", "x", "y"]).join(out, ["station_id", "day"])
    return out.select("station_id", "day", F.round("observed", 6).alias("observed"), F.abs(F.round(F.col("estimate") - F.col("observed"), 6)).alias("error"))


_FIELD = (9.0, 6.0, 0.5)  # sill, range in degrees, nugget


def _eliminated(n: int) -> str:
    """SQL of n steps of Gauss-Jordan elimination on m0(g, i, j, v), each on the next row."""
    return ",\n ".join(f"""m{k} AS (SELECT a.g, a.i, a.j, CASE WHEN a.i={k} THEN a.v/p.v ELSE a.v-c.v*r.v/p.v END AS v FROM m{k - 1} a JOIN m{k - 1} p ON p.g=a.g AND p.i={k} AND p.j={k}
  JOIN m{k - 1} c ON c.g=a.g AND c.i=a.i AND c.j={k} JOIN m{k - 1} r ON r.g=a.g AND r.i={k} AND r.j=a.j)""" for k in range(1, n + 1))


def _cov(d: str) -> str:
    sill, reach, nugget = _FIELD
    return f"CASE WHEN {d}=0 THEN {sill + nugget}::DOUBLE WHEN {d}<={reach} THEN {sill}::DOUBLE*(1-1.5*{d}/{reach}+0.5*power({d}/{reach},3)) ELSE 0.0 END"


@query("J4_kriging_places", with_roles("cities", "arrivals", "places") + f""", o AS (SELECT department AS g, lng AS x, lat AS y, count(*)::DOUBLE AS z FROM arrivals JOIN cities USING (city_id) GROUP BY ALL),
 st AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, y) AS i, (SELECT avg(z) FROM o) AS u FROM o),
 ab AS (SELECT a.g, a.i, b.i AS j, {_cov("sqrt(power(a.x-b.x,2)+power(a.y-b.y,2))")} AS v FROM st a JOIN st b USING (g)),
 m0 AS (SELECT g, i, j, v FROM ab UNION ALL SELECT g, i, 6, z/u FROM st UNION ALL SELECT g, i, 7, 1.0 FROM st),
 {_eliminated(5)}, sol AS (SELECT g, i, max(v) FILTER (j=6) AS a, max(v) FILTER (j=7) AS b FROM m5 WHERE j>5 GROUP BY g, i),
 mu AS (SELECT g, sum(a)/sum(b) AS mu FROM sol GROUP BY g),
 pl AS (SELECT place_id, lower(r_name) AS g, p.lng AS x, p.lat AS y FROM places p JOIN nation ON n_nationkey=city_id JOIN region ON n_regionkey=r_regionkey)
 SELECT place_id, round(any_value(mu.mu)+sum((a-mu.mu*b)*{_cov("sqrt(power(pl.x-st.x,2)+power(pl.y-st.y,2))")}),5) AS estimate
 FROM pl JOIN st USING (g) JOIN sol ON sol.g=st.g AND sol.i=st.i JOIN mu ON mu.g=st.g GROUP BY place_id""")
def kriging_places(t):
    """Arrivals of a department's cities, in units of the mean over all cities, at all places of the department, by a given model."""
    counts = t.arrivals.groupBy("city_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = t.cities.join(counts, "city_id").select(F.col("department").alias("g"), F.col("lng").alias("x"), F.col("lat").alias("y"), "n")
    seen = seen.withColumn("z", F.col("n") / seen.agg(F.avg("n")).scalar())
    sill, reach, nugget = _FIELD
    model = seen.select("g").distinct().select("g", F.lit(sill).alias("psill"), F.lit(reach).alias("range"), F.lit(nugget).alias("nugget"))
    asked = t.places.join(t.cities.select("city_id", "department"), "city_id").select(F.col("department").alias("g"), "place_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return K.krige(seen, asked, model, ["g"], "place_id", "z").select("place_id", F.round("estimate", 5).alias("estimate"))


@query("J4_kriging_constant_field", "SELECT event_type, unnest(range(0,400))::INT AS cell, 5.0::DOUBLE AS estimate FROM (SELECT DISTINCT event_type FROM events)")
def kriging_constant_field(t):
    """A field that is the same at all stations is the same everywhere."""
    k = F.col("user_id")
    obs = t.events.select("event_type", k.alias("station_id"), (((k * 37) % 170) * 10000.0).alias("x"), (((k * 53) % 130) * 10000.0 + (k % 7) * 1000.0).alias("y"), F.lit(5.0).alias("value")).distinct()
    model = K.spherical_fit(K.empirical_variogram(obs, ["event_type"], "station_id", "value"), ["event_type"])
    est = K.krige(obs, K.surface_targets(obs, ["event_type"], 20), model, ["event_type"], "cell", "value")
    return est.select("event_type", "cell", F.round("estimate", 5).alias("estimate"))
