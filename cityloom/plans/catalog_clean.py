"""Checked queries: projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import CITY_ALIASES, DEFLATION_PCT, MONTHS_EN, MONTHS_ES
from ..operators import cleaning, panel
from .registry import query
from .tables import with_roles

_NAME_SQL = r"""regexp_replace(regexp_replace(strip_accents(replace(lower({c}),' ','')),'[^\pL\pM\pN\p{{Pc}}\s]','','g'),'ct$','')"""
_ALIAS_SQL = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CITY_ALIASES.items()) + " ELSE {c} END"
_EN = "[" + ",".join(f"'{m}'" for m in MONTHS_EN) + "]"
_ES = "[" + ",".join(f"'{m}'" for m in MONTHS_ES) + "]"


@query("B1_normalize_name", f"""WITH n AS (SELECT doc_id, {_NAME_SQL.format(c='text')} AS c FROM documents)
SELECT doc_id, {_ALIAS_SQL.format(c='c')} AS city FROM n
UNION ALL SELECT -1-s_suppkey, CASE s_suppkey%4 WHEN 0 THEN 'bogota' WHEN 1 THEN 'tumaco' WHEN 2 THEN 'fortul' ELSE 'penol' END FROM supplier""")
def normalize_name(t):
    docs = t.documents.select("doc_id", "text")
    kind = F.col("s_suppkey") % 4
    dirty = (F.when(kind == 0, " Bogotá, D.C. ").when(kind == 1, "San Andrés de Tumaco")
             .when(kind == 2, "Fortul CT").otherwise("Peñol"))
    return text.normalize_name(docs.union(t.supplier.select(-1 - F.col("s_suppkey"), dirty)), "text", "city")


@query("B2_strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(t):
    return t.documents.select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("B3_alias_fix", """SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'construction' WHEN 'machinery' THEN 'equipment'
  ELSE lower(c_mktsegment) END AS segment FROM customer""")
def alias_fix(t):
    dim = t.spark.createDataFrame([("building", "construction"), ("machinery", "equipment")], "alias string, canonical string")
    return text.fix_aliases(t.customer.select("c_custkey", F.lower("c_mktsegment").alias("segment")), "segment", dim)


@query("B4_month_map", f"""SELECT o_orderkey, month(o_orderdate) AS month, ({_EN})[month(o_orderdate)] AS name_en,
  ({_ES})[month(o_orderdate)] AS name_es, ({_EN})[month(o_orderdate)] AS translated, month(o_orderdate) AS back,
  NULL::VARCHAR AS unmapped FROM orders""")
def month_map(t):
    es = F.element_at(text.literal_map(dict(enumerate(MONTHS_ES, 1))), F.col("month"))
    return (t.orders.select("o_orderkey", F.month("o_orderdate").alias("month"))
            .withColumn("name_en", text.month_name(F.col("month"))).withColumn("name_es", es)
            .withColumn("translated", text.month_to_english(F.col("name_es")))
            .withColumn("back", text.month_number(F.col("translated")))
            .withColumn("unmapped", text.month_to_english(F.upper("name_es"))))


def _gappy(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                             F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
                             F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"))


_GAPPY = """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, nullif(l_discount,0.0) AS discount,
  nullif(l_tax,0.0) AS tax FROM lineitem) """


@query("B5_drop_incomplete", _GAPPY + """SELECT 'any' AS rule, count(*) AS n, sum(l_quantity) AS qty FROM g
  WHERE discount IS NOT NULL AND tax IS NOT NULL UNION ALL
  SELECT 'discount', count(*), sum(l_quantity) FROM g WHERE discount IS NOT NULL""")
def drop_incomplete(t):
    def tot(df, rule):
        return df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return tot(cleaning.drop_incomplete(_gappy(t)), "any").unionByName(
        tot(cleaning.drop_incomplete(_gappy(t), ["discount"]), "discount"))


@query("B6_filter_eq", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def filter_eq(t):
    return t.orders.where("o_orderstatus <> 'F' and o_orderdate >= timestamp_ntz'1998-01-01' "
                          "and o_orderdate < timestamp_ntz'1999-01-01'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("B7_keep_known_cities", """SELECT c_custkey, lower(c_mktsegment) AS city FROM customer WHERE lower(c_mktsegment) IN
  (SELECT lower(c_mktsegment) FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT lower(c_mktsegment) FROM customer WHERE c_nationkey < 3)
  OR lower(c_mktsegment) IN ('bogota','tumaco')""")
def keep_known_cities(t):
    c = t.customer.select("c_custkey", F.lower("c_mktsegment").alias("city"), "c_acctbal", "c_nationkey")
    known = cleaning.known_cities(c.where("c_acctbal > 9900"), c.where("c_nationkey < 3"))
    return cleaning.keep_known_cities(c.select("c_custkey", "city"), known)


@query("B8_null_audit", _GAPPY + """SELECT 'discount' AS column_name, count(*) FILTER (discount IS NULL) AS n_null FROM g
  UNION ALL SELECT 'tax', count(*) FILTER (tax IS NULL) FROM g
  UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity IS NULL) FROM g
  UNION ALL SELECT '(any)', count(*) FILTER (discount IS NULL OR tax IS NULL) FROM g""")
def null_audit(t):
    g = _gappy(t).withColumn("(any)", F.when(~cleaning.any_null(["discount", "tax"]), F.lit(1)))
    return cleaning.null_audit(g, ["discount", "tax", "l_quantity", "(any)"])


@query("B9_parse_decimal_comma", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS value FROM customer""")
def decimal_comma(t):
    raw = F.when(F.col("c_acctbal") < 0, "n.d.").otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return t.customer.select("c_custkey", text.parse_decimal_comma(raw).alias("value"))


@query("B10_parse_dates", f"""SELECT event_id, year(ts) AS year, month(ts) AS month, ({_EN})[month(ts)] AS month_name,
  date_trunc('month', ts)::DATE AS first_day, NULL::TIMESTAMP AS unreadable FROM events""")
def parse_dates(t):
    ts = F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = t.events.select("event_id", ts.alias("when"), F.try_to_timestamp(F.concat(F.lit("sin fecha "), "event_type")).alias("unreadable"))
    return rows.select("event_id", F.year("when").alias("year"), F.month("when").alias("month"),
                       F.date_format("when", "MMMM").alias("month_name"),
                       text.parse_period(text.period_key(F.month("when"), F.year("when"))).alias("first_day"), "unreadable")


@query("B11_parse_point", with_roles("places") + " SELECT place_id, round(lat,6) AS lat, round(lng,6) AS lng FROM places")
def parse_point(t):
    raw = t.places.select("place_id", F.concat(F.lit("("), "lat", F.lit(", "), "lng", F.lit(")")).alias("p"))
    lat, lng = text.parse_point(F.col("p"))
    return raw.select("place_id", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query("B12_rename_align", with_roles("panel") + " SELECT city_id AS \"Ciudad\", month AS \"Mes\", visitors AS \"Nmero Extranjeros\", gdp AS \"Pib Ponderado\" FROM panel")
def rename_align(t):
    names = {"Ciudad": "city_id", "Mes": "month", "Nmero Extranjeros": "visitors", "Pib Ponderado": "gdp"}
    even = F.col("year") % 2 == 0
    other = t.panel.where(~even).withColumnsRenamed({"visitors": "n_visitors"}).select("gdp", "n_visitors", "month", "city_id")
    return cleaning.stack([cleaning.align_columns(t.panel.where(even), names), cleaning.align_columns(other, {**names, "Nmero Extranjeros": "n_visitors"})])


@query("B13_fill_zero", _GAPPY + """SELECT l_partkey, sum(coalesce(discount,0)+coalesce(tax,0))::DECIMAL(18,2)::DOUBLE AS filled,
  count(discount) AS present FROM g GROUP BY 1""")
def fill_zero(t):
    g = _gappy(t)
    filled = g.withColumn("present", F.col("discount")).na.fill(0.0, ["discount", "tax"])
    return filled.groupBy("l_partkey").agg(F.round(F.sum(F.col("discount") + F.col("tax")), 2).alias("filled"),
                                           F.count("present").alias("present"))


@query("B14_cast", """SELECT CAST(c_custkey AS VARCHAR) AS key_text, CAST(trunc(c_acctbal) AS INTEGER) AS whole,
  CAST(c_nationkey AS DOUBLE) AS nation FROM customer""")
def cast(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("key_text"), F.col("c_acctbal").cast("int").alias("whole"),
                             F.col("c_nationkey").cast("double").alias("nation"))


@query("B15_period_key", "SELECT o_orderkey, month(o_orderdate) || '-' || year(o_orderdate) AS period FROM orders")
def period_key(t):
    return t.orders.select("o_orderkey", text.period_key(F.month("o_orderdate"), F.year("o_orderdate")).alias("period"))


@query("B16_distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(t):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("B17_arithmetic_features", with_roles("panel") + """, pop AS (SELECT c_nationkey AS city_id, count(*)*1000 AS population FROM customer GROUP BY 1)
SELECT city_id, year, month, round(gdp*(crimes/100),4) AS weighted_gdp, round(gdp/nullif(population,0),12) AS poverty_proxy,
  round(abs(trip_spend-daily_spend)/1000,6) AS span_km FROM panel JOIN pop USING (city_id)""")
def arithmetic_features(t):
    pop = t.customer.groupBy(F.col("c_nationkey").alias("city_id")).agg((F.count(F.lit(1)) * 1000).alias("population"))
    p = t.panel.join(pop, "city_id")
    return p.select("city_id", "year", "month", F.round(F.col("gdp") * (F.col("crimes") / 100), 4).alias("weighted_gdp"),
                    F.round(F.try_divide("gdp", "population"), 12).alias("poverty_proxy"),
                    F.round(F.abs(F.col("trip_spend") - F.col("daily_spend")) / 1000, 6).alias("span_km"))


@query("B18_deflate_prices", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"round(l_extendedprice*{m}/(1+{r!r}/100),6) AS {n}" for (n, r), m in zip(DEFLATION_PCT.items(), ("1", "l_discount", "l_tax", "2", "3"))) + " FROM lineitem")
def deflate_prices(t):
    e = F.col("l_extendedprice")
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (e * 1).alias("average"), (e * F.col("l_discount")).alias("lodging"),
                             (e * F.col("l_tax")).alias("transport"), (e * 2).alias("food"), (e * 3).alias("other"))
    out = cleaning.deflate(base, {n: n for n in DEFLATION_PCT})
    return out.withColumns({n: F.round(n, 6) for n in DEFLATION_PCT})


@query("G1_union_all", with_roles("panel") + " SELECT city_id, year, month, visitors FROM panel")
def union_all(t):
    p = t.panel.select("city_id", "year", "month", "visitors")
    return cleaning.stack([p.where(F.col("year") < 1998), p.where(F.col("year") >= 1998)])


@query("G2_intersect", """SELECT l_partkey FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount=0""")
def intersect(t):
    l = t.lineitem
    return l.where("l_returnflag = 'R'").select("l_partkey").intersect(l.where("l_discount = 0").select("l_partkey"))


@query("G3_split_missing", _GAPPY + """SELECT l_partkey, count(*) FILTER (discount IS NOT NULL AND tax IS NOT NULL) AS complete,
  count(*) FILTER (discount IS NULL OR tax IS NULL) AS missing FROM g GROUP BY 1""")
def split_missing(t):
    whole, gaps = cleaning.split_missing(_gappy(t), ["discount", "tax"])
    both = cleaning.stack([whole.select("l_partkey", F.lit(1).alias("c"), F.lit(0).alias("m")),
                           gaps.select("l_partkey", F.lit(0).alias("c"), F.lit(1).alias("m"))])
    return both.groupBy("l_partkey").agg(F.sum("c").alias("complete"), F.sum("m").alias("missing"))


@query("C8_panel_scaffold", with_roles("arrivals", "cities") + """, f AS (SELECT city_id, year, month, sum(amount) AS s, median(amount) AS m FROM arrivals GROUP BY ALL),
 k AS (SELECT DISTINCT city_id, year FROM arrivals)
SELECT city_id, year, mm.month AS month, round(coalesce(s,0),2) AS total, round(m,4) AS middle FROM k CROSS JOIN (SELECT unnest(range(1,13)) AS month) mm LEFT JOIN f USING (city_id, year, month)""")
def panel_scaffold(t):
    keys = ["city_id", "year"]
    total = panel.complete_months(t.arrivals, keys, "month", "amount", "sum")
    middle = panel.complete_months(t.arrivals, keys, "month", "amount", "median")
    return total.select(*keys, "month", F.round("amount", 2).alias("total")).join(
        middle.select(*keys, "month", F.round("amount", 4).alias("middle")), [*keys, "month"])
