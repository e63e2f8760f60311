"""Checked queries: joins, aggregations, time series, sorts and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import describe as Q
from ..operators.scale import group_median
from .registry import query
from .tables import with_roles


@query("C1_left_equi", with_roles("cities", "panel") + """ SELECT p.city_id, p.year, p.month, visitors, department, i.n AS crimes_in_department
 FROM panel p LEFT JOIN cities USING (city_id) LEFT JOIN (SELECT department, year, month, sum(quantity) AS n FROM incidents JOIN cities USING (city_id) GROUP BY ALL) i
 USING (department, year, month)""")
def left_equi(t):
    dims = t.cities.select("city_id", "department")
    by_dep = (t.incidents.join(dims, "city_id").groupBy("department", "year", "month")
              .agg(F.sum("quantity").alias("crimes_in_department")))
    return (t.panel.select("city_id", "year", "month", "visitors").join(dims, "city_id", "left")
            .join(by_dep, ["department", "year", "month"], "left"))


_FX = """fx AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, median(l_discount) AS fx FROM lineitem GROUP BY ALL)"""


@query("C2_right_equi", with_roles("panel") + f", {_FX} SELECT city_id, fx.year AS year, fx.month AS month, visitors, round(fx,6) AS fx FROM panel p RIGHT JOIN fx USING (year, month)")
def right_equi(t):
    fx = P.resample_monthly_median(t.lineitem.select("l_shipdate", "l_discount"), "l_shipdate", "l_discount")
    return t.panel.select("city_id", "year", "month", "visitors").join(fx.select("year", "month", F.round("l_discount", 6).alias("fx")), ["year", "month"], "right")


@query("C3_full_outer", """SELECT coalesce(a.k,b.k) AS key, a.s AS supplied, b.c AS ordered FROM
 (SELECT l_suppkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1) a FULL JOIN
 (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1) b ON a.k=b.k""")
def full_outer(t):
    """Suppliers and customers by number: each side has numbers that the other lacks."""
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("supplied"))
    b = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("ordered"))
    return a.join(b, "key", "full")


@query("C4_inner_equi", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey=o_orderkey""")
def inner_equi(t):
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return l.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "l_quantity")


@query("C10_semi_anti", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F') AS kept FROM customer""")
def semi_anti(t):
    c = t.customer.select("c_custkey")
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return (c.join(o, "c_custkey", "left_semi").withColumn("kept", F.lit(True))
            .unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kept", F.lit(False))))


@query("D1_crime_rollup", """SELECT lower(replace(o_orderpriority,'-','')) AS city0, year(o_orderdate) AS year, month(o_orderdate) AS month, sum(o_custkey) AS homicides
 FROM orders GROUP BY ALL""".replace("lower(replace(o_orderpriority,'-','')) AS city0", "replace(lower(replace(o_orderpriority,'-','')),' ','') AS city"))
def crime_rollup(t):
    raw = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("FECHA HECHO"),
                          F.concat("o_orderpriority", F.lit(" (CT)")).alias("MUNICIPIO"), F.col("o_custkey").cast("string").alias("CANTIDAD"))
    footer = t.spark.createDataFrame([("Fuente", None, None)], "a string, b string, c string")
    return P.incident_rollup(raw.union(footer), "FECHA HECHO", "MUNICIPIO", "CANTIDAD", "homicides")


@query("D2_group_sum", "SELECT l_suppkey, l_returnflag, sum(l_quantity) AS qty, round(sum(l_extendedprice),2) AS amount FROM lineitem GROUP BY ALL")
def group_sum(t):
    return t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("D3_group_median", with_roles("arrivals") + " SELECT city_id, year, month, round(median(amount),6) AS amount FROM arrivals GROUP BY ALL")
def median_by_group(t):
    return group_median(t.arrivals, ["city_id", "year", "month"], "amount", "amount").withColumn("amount", F.round("amount", 6))


@query("D4_count_sum_multi", """SELECT s_nationkey, count(nullif(l_returnflag,'N')) AS establishments, sum(l_linenumber) AS rooms, sum(l_quantity) AS beds
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1""")
def count_sum_multi(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    part = (t.lineitem.groupBy("l_suppkey").agg(F.count(F.nullif(F.col("l_returnflag"), F.lit("N"))).alias("e"),
                                                F.sum("l_linenumber").alias("r"), F.sum("l_quantity").alias("b")))
    return part.join(s, "l_suppkey").groupBy("s_nationkey").agg(
        F.sum("e").alias("establishments"), F.sum("r").alias("rooms"), F.sum("b").alias("beds"))


@query("D5_named_multi_agg", """SELECT c_mktsegment, round(sum(c_acctbal*c_nationkey),2) AS weighted_sum, sum(c_nationkey) AS weight_sum,
 round(min(c_acctbal),2) AS lowest, round(max(c_acctbal),2) AS highest FROM customer GROUP BY 1""")
def named_multi_agg(t):
    return t.customer.groupBy("c_mktsegment").agg(
        F.round(F.sum(F.col("c_acctbal") * F.col("c_nationkey")), 2).alias("weighted_sum"), F.sum("c_nationkey").alias("weight_sum"),
        F.round(F.min("c_acctbal"), 2).alias("lowest"), F.round(F.max("c_acctbal"), 2).alias("highest"))


@query("D6_row_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def row_count(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("D7_resample_monthly_median", """SELECT last_day(l_shipdate) AS month_end, year(l_shipdate) AS year, month(l_shipdate) AS month,
 round(median(l_extendedprice),6) AS price FROM lineitem GROUP BY ALL""")
def monthly_median(t):
    daily = t.lineitem.select("l_shipdate", F.col("l_extendedprice").alias("price"))
    return P.resample_monthly_median(daily, "l_shipdate", "price").withColumn("price", F.round("price", 6))


@query("D12_global_stats", "SELECT round(avg(value),6) AS mean, min(value) AS min, max(value) AS max, round(median(value),6) AS median FROM events")
def stats(t):
    s = P.global_stats(t.events, "value")
    return s.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("D13_reconciliation_check", with_roles("arrivals") + """, y AS (SELECT city_id, year, sum(amount) AS gdp FROM arrivals GROUP BY ALL)
 SELECT city_id, year, round(gdp,2) AS gdp, round(gdp,2) AS parts_sum, true AS matches FROM y""")
def reconciliation_check(t):
    monthly = t.arrivals.groupBy("city_id", "year", "month").agg(F.sum("amount").alias("part"))
    yearly = t.arrivals.groupBy("city_id", "year").agg(F.sum("amount").alias("gdp"))
    out = P.reconcile(monthly, yearly, ["city_id", "year"], "part", "gdp")
    return out.withColumns({"gdp": F.round("gdp", 2), "parts_sum": F.round("parts_sum", 2)})


@query("E1_lag_features", with_roles("panel") + """ SELECT * FROM (SELECT city_id, period, visitors, lag(visitors,1) OVER w AS visitors_l1,
 lag(visitors,2) OVER w AS visitors_l2, lag(gdp,1) OVER w AS gdp_l1 FROM panel WINDOW w AS (PARTITION BY city_id ORDER BY period))
 WHERE visitors_l2 IS NOT NULL""")
def lags(t):
    out = P.lag_features(t.panel, ["city_id"], "period", {"visitors_l1": ("visitors", 1), "visitors_l2": ("visitors", 2), "gdp_l1": ("gdp", 1)})
    return out.select("city_id", "period", "visitors", "visitors_l1", "visitors_l2", "gdp_l1")


@query("E1b_pooled_lag_features", """SELECT * FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice,1) OVER w AS l1, lag(o_totalprice,2) OVER w AS l2
 FROM orders WINDOW w AS (ORDER BY date_trunc('month',o_orderdate), o_orderdate, o_orderkey)) WHERE l2 IS NOT NULL""")
def pooled_lags(t):
    o = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    out = P.pooled_lag_features(o, [F.col("o_orderdate"), F.col("o_orderkey")], {"l1": ("o_totalprice", 1), "l2": ("o_totalprice", 2)})
    return out.select("o_orderkey", "o_totalprice", "l1", "l2")


@query("E5_repeat_annual", with_roles("arrivals") + """ SELECT city_id, year, m.month, amount FROM (SELECT city_id, year, round(sum(amount),2) AS amount FROM arrivals GROUP BY ALL),
 (SELECT unnest(range(1,13)) AS month) m""")
def repeat_annual(t):
    annual = t.arrivals.groupBy("city_id", "year").agg(F.round(F.sum("amount"), 2).alias("amount"))
    return P.repeat_over_months(annual).select("city_id", "year", "month", "amount")


@query("E7_equal_width_time_bins", """WITH e AS (SELECT epoch_us(ts)::DOUBLE AS s, ts, value FROM events), l AS (SELECT min(s) AS lo, max(s) AS hi FROM e)
 SELECT CAST(greatest(0, least(6, ceil((s-lo)/((hi-lo)/7))-1)) AS INTEGER) AS bin, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(avg(value),6) AS mean_value
 FROM e, l GROUP BY 1""")
def equal_width_time_bins(t):
    return P.time_bins(t.events, "ts", "value", 7).withColumn("mean_value", F.round("mean_value", 6))


@query("F1_head", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 15")
def head(t):
    return (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
            .orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(15))


@query("F2_drop_last_group", """SELECT o_orderpriority AS entry_point, count(*) AS total FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1""")
def drop_last_group(t):
    return (t.orders.where("o_orderpriority <> '4-NOT SPECIFIED'").groupBy(F.col("o_orderpriority").alias("entry_point"))
            .agg(F.count(F.lit(1)).alias("total")))


@query("Q1_histogram", """WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
 SELECT CAST(least(49, floor((value-lo)/((hi-lo)/50))) AS INTEGER) AS bin, count(*) AS n FROM events, l WHERE value IS NOT NULL GROUP BY 1""")
def histogram(t):
    return Q.histogram(t.events, "value", 50)


@query("Q2_box_stats", """WITH q AS (SELECT event_type, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS q2, quantile_cont(value,0.75) AS q3 FROM events GROUP BY 1)
 SELECT e.event_type, round(q1,6) AS q1, round(q2,6) AS median, round(q3,6) AS q3,
 min(value) FILTER (value >= q1-1.5*(q3-q1)) AS low_whisker, max(value) FILTER (value <= q3+1.5*(q3-q1)) AS high_whisker,
 count(*) FILTER (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1)) AS n_outliers FROM events e JOIN q ON e.event_type=q.event_type GROUP BY ALL""")
def box_stats(t):
    out = Q.box_stats(t.events, ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("Q3_city_bars", with_roles("panel") + """ SELECT city_id, round(median(gdp),4) AS gdp, round(median(visitors),4) AS visitors, round(median(crimes)*100,4) AS crime_bar FROM panel GROUP BY 1""")
def city_bars(t):
    out = Q.city_bars(t.panel, "city_id", ["gdp", "visitors", "crimes"])
    return out.select("city_id", F.round("gdp", 4).alias("gdp"), F.round("visitors", 4).alias("visitors"),
                      F.round(F.col("crimes") * 100, 4).alias("crime_bar"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("Q4_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1:]))
def correlation_matrix(t):
    return Q.correlations(t.lineitem, _NUM).withColumn("r", F.round("r", 6))
