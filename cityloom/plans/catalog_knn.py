"""Checked queries: nearest-neighbour imputation and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn as N
from ..operators.scale import hash_bucket
from .registry import query
from .tables import with_roles

NUMERIC = ["visitors", "gdp", "trip_spend", "daily_spend", "crimes", "thefts"]


def gappy_panel(t):
    """The panel with one cell in ten of two columns blanked by a hash of its key."""
    p = t.panel.join(t.cities.select("city_id", "department"), "city_id")
    p = p.withColumn("row_id", F.col("city_id") * 100000 + F.col("period"))
    return p.withColumn("crimes", F.when(hash_bucket(F.col("row_id"), 1, 10) > 0, F.col("crimes"))).withColumn(
        "thefts", F.when(hash_bucket(F.col("row_id"), 2, 10) > 0, F.col("thefts")))


_HASH = "(concat('0x', substr(md5(concat(row_id, ':{s}')),1,8))::BIGINT % 10)"
_GAPS = with_roles("cities", "panel") + f""", p0 AS (SELECT p.*, department, city_id*100000+period AS row_id FROM panel p JOIN cities USING (city_id)),
 g AS (SELECT * REPLACE (CASE WHEN {_HASH.format(s=1)}>0 THEN crimes END AS crimes, CASE WHEN {_HASH.format(s=2)}>0 THEN thefts END AS thefts) FROM p0),
 mo AS (SELECT {", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}),0),1) AS s_{c}" for c in NUMERIC)},
  count(DISTINCT city_id)+count(DISTINCT department)+count(DISTINCT period)+{len(NUMERIC)} AS total FROM g),
 z AS (SELECT row_id, city_id, department, period, crimes, thefts, total, {", ".join(f"({c}-m_{c})/s_{c} AS z_{c}" for c in NUMERIC)} FROM g, mo),
 pr AS (SELECT a.row_id AS q, b.row_id AS d, a.crimes AS qc, a.thefts AS qt, b.crimes AS crimes, b.thefts AS thefts,
  (2.0*((a.city_id<>b.city_id)::INT+(a.department<>b.department)::INT+(a.period<>b.period)::INT)+{"+".join(f"coalesce(power(a.z_{c}-b.z_{c},2),0)" for c in NUMERIC)})
  *a.total/(a.total-({"+".join(f"(a.z_{c} IS NULL OR b.z_{c} IS NULL)::INT" for c in NUMERIC)})) AS dist
  FROM z a JOIN z b ON (a.crimes IS NULL OR a.thefts IS NULL)),
 fc AS (SELECT q, avg(crimes) AS v FROM (SELECT * FROM pr WHERE qc IS NULL AND crimes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, d)<=5) GROUP BY 1),
 ft AS (SELECT q, avg(thefts) AS v FROM (SELECT * FROM pr WHERE qt IS NULL AND thefts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, d)<=5) GROUP BY 1)"""


@query("J5_knn_impute", _GAPS + """ SELECT row_id, round(coalesce(crimes, fc.v),6) AS crimes, round(coalesce(thefts, ft.v),6) AS thefts
 FROM g LEFT JOIN fc ON fc.q=row_id LEFT JOIN ft ON ft.q=row_id""")
def knn_impute(t):
    out = N.knn_impute(gappy_panel(t), "row_id", "city_id", ["city_id", "department", "period"], NUMERIC, ["crimes", "thefts"], 5)
    return out.select("row_id", F.round("crimes", 6).alias("crimes"), F.round("thefts", 6).alias("thefts"))


_VSPLIT = "(concat('0x', substr(md5(concat(vec_id, ':7')),1,8))::BIGINT % 100)"


@query("L15_knn_regressor", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS f, label, {_VSPLIT}<20 AS test FROM embeddings),
 pr AS (SELECT a.vec_id AS q, b.vec_id AS d, b.label AS y, a.label AS actual, list_sum(list_transform(list_zip(a.f,b.f), lambda p: abs(p[1]-p[2]))) AS dist FROM e a JOIN e b ON a.test AND NOT b.test),
 k AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(dist,9), d)<=3)
 SELECT q AS vec_id, actual AS label, round(CASE WHEN min(dist)=0 THEN avg(y) FILTER (dist=0) ELSE sum(y/nullif(dist,0))/sum(1/nullif(dist,0)) END,6) AS prediction FROM k GROUP BY ALL""")
def knn_regressor(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("f"), "label")
    test = hash_bucket(F.col("vec_id"), 7, 100) < 20
    train = e.where(~test).select(F.col("vec_id").alias("d"), "f", F.col("label").cast("double").alias("y"))
    out = N.knn_regress(e.where(test).select(F.col("vec_id").alias("q"), "f"), train, 3, "distance", "manhattan")
    return e.select("vec_id", "label").join(out.withColumnRenamed("q", "vec_id"), "vec_id").withColumn("prediction", F.round("prediction", 6))
