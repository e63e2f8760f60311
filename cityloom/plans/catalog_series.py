"""Checked queries: seasonal patterns, smoothing, and annual to monthly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import PATTERN_NOISE
from ..functions.series import neighbourhoods, tricube
from ..operators import panel as P
from ..operators import smoothing as S
from .registry import query
from .tables import with_roles

N, FRAC = 12, 0.4


def _fit_sql(y: str, w: str | None) -> str:
    """SQL for the twelve fitted values of one pass over list ``y`` with weight list ``w``."""
    cols = []
    for i, (first, last, radius) in enumerate(neighbourhoods(N, FRAC)):
        near = [(j, tricube(abs(j - i), radius)) for j in range(first, last + 1) if tricube(abs(j - i), radius) > 0]
        wt = [f"({k!r}::DOUBLE{'' if w is None else f'*{w}[{j + 1}]'})" for j, k in near]
        sw = "(" + "+".join(wt) + ")"
        mx = "((" + "+".join(f"{a}*{j}" for a, (j, _) in zip(wt, near)) + f")/nullif({sw},0))"
        my = "((" + "+".join(f"{a}*{y}[{j + 1}]" for a, (j, _) in zip(wt, near)) + f")/nullif({sw},0))"
        sxx = "(" + "+".join(f"{a}*({j}-{mx})*({j}-{mx})" for a, (j, _) in zip(wt, near)) + ")"
        sxy = "(" + "+".join(f"{a}*({j}-{mx})*{y}[{j + 1}]" for a, (j, _) in zip(wt, near)) + ")"
        cols.append(f"coalesce({my}+CASE WHEN {sxx}>1e-12 THEN {sxy}/{sxx} ELSE 0 END*({i}-{mx}),{y}[{i + 1}])")
    return "[" + ",".join(cols) + "]"


def lowess_sql(source: str, y: str, robust: int) -> str:
    """CTEs ``pass0..`` over ``source``; the last one carries the fit in ``f``."""
    ctes = [f"pass0 AS (SELECT *, {_fit_sql(y, None)} AS f FROM {source})"]
    for it in range(robust):
        ctes.append(f"res{it} AS (SELECT *, [abs({y}[1]-f[1])" + "".join(f",abs({y}[{i}]-f[{i}])" for i in range(2, N + 1)) + f"] AS r FROM pass{it})")
        ctes.append(f"med{it} AS (SELECT *, (list_sort(r)[6]+list_sort(r)[7])/2.0 AS md FROM res{it})")
        ctes.append(f"wts{it} AS (SELECT * EXCLUDE (f), [" + ",".join(
            f"power(1-power(CASE WHEN md>0 THEN least(1.0,r[{i}]/(6.0*md)) WHEN r[{i}]>0 THEN 1.0 ELSE 0.0 END,2),2)" for i in range(1, N + 1))
            + f"] AS w FROM med{it})")
        ctes.append(f"pass{it + 1} AS (SELECT * EXCLUDE (r, md, w), {_fit_sql(y, 'w')} AS f FROM wts{it})")
    return ",\n".join(ctes)


_ARR = """arr AS (SELECT city_id, year, [coalesce(sum(amount) FILTER (month=1),0)""" + "".join(
    f",coalesce(sum(amount) FILTER (month={m}),0)" for m in range(2, 13)) + """] AS y0 FROM arrivals GROUP BY ALL),
 sh AS (SELECT city_id, year, list_transform(y0, lambda v: v/list_sum(y0)) AS y FROM arr)"""


def monthly_shares(t):
    from ..functions.series import shares
    return S.month_arrays(t.arrivals, ["city_id", "year"], "month", "amount").withColumn("y", shares(F.col("trend")))


@query("E3_lowess", with_roles("arrivals") + f", {_ARR}, {lowess_sql('sh', 'y', 3)} SELECT city_id, year, m.month AS month, round(f[m.month],8)+0.0 AS smooth FROM pass3, (SELECT unnest(range(1,13)) AS month) m")
def lowess(t):
    out = S.lowess(monthly_shares(t), "y", "smooth", robust=3)
    return S.explode_array(out, ["city_id", "year"], "smooth", "smooth").withColumn("smooth", F.round("smooth", 8) + 0.0)


@query("E3b_local_linear", with_roles("arrivals") + f", {_ARR}, {lowess_sql('sh', 'y', 0)} SELECT city_id, year, m.month AS month, round(f[m.month],8)+0.0 AS smooth FROM pass0, (SELECT unnest(range(1,13)) AS month) m")
def local_linear(t):
    out = S.lowess(monthly_shares(t), "y", "smooth", robust=0)
    return S.explode_array(out, ["city_id", "year"], "smooth", "smooth").withColumn("smooth", F.round("smooth", 8) + 0.0)


def _pattern_sql(source: str) -> str:
    """Seasonal pattern of list column ``y0`` in ``source``; ends in CTE ``pat(keys, w)``."""
    noise = "[" + ",".join(f"{x!r}::DOUBLE" for x in PATTERN_NOISE) + "]"
    return f"""n1 AS (SELECT * EXCLUDE (y0), [{",".join(f"greatest(0.01, y0[{i}]/list_sum(y0)+({noise})[{i}])" for i in range(1, 13))}] AS q FROM {source}),
 n2 AS (SELECT * EXCLUDE (q), list_transform(q, lambda v: v/list_sum(q)) AS y FROM n1), {lowess_sql('n2', 'y', 3)},
 pat AS (SELECT * EXCLUDE (y, f), list_transform(f, lambda v: v/list_sum(f)) AS w FROM pass3)"""


@query("E2_seasonal_pattern", with_roles("arrivals") + f", {_ARR}, {_pattern_sql('arr')} SELECT city_id, year, m.month AS month, round(w[m.month],8)+0.0 AS weight FROM pat, (SELECT unnest(range(1,13)) AS month) m")
def seasonal_pattern(t):
    out = S.seasonal_pattern(t.arrivals, ["city_id", "year"], "month", "amount")
    return out.withColumn("weight", F.round("weight", 8) + 0.0)


_YEAR_ARR = """ya AS (SELECT year, [coalesce(sum(quantity) FILTER (month=1),0)""" + "".join(
    f",coalesce(sum(quantity) FILTER (month={m}),0)" for m in range(2, 13)) + """] AS y0 FROM incidents GROUP BY ALL)"""
_GDP = """dep AS (SELECT department, year, sum(amount) AS gdp FROM arrivals JOIN cities USING (city_id) GROUP BY ALL),
 mon AS (SELECT department, year, m.month AS month, gdp*w[m.month] AS gdp FROM dep JOIN pat USING (year), (SELECT unnest(range(1,13)) AS month) m)"""


def department_months(t):
    """Annual GDP of each department spread over months by the pattern of its year."""
    annual = (t.arrivals.groupBy("city_id", "year").agg(F.sum("amount").alias("gdp"))
              .join(t.cities.select("city_id", "department"), "city_id").groupBy("department", "year").agg(F.sum("gdp").alias("gdp")))
    pattern = S.seasonal_pattern(t.incidents, ["year"], "month", "quantity")
    return P.spread_over_months(annual, pattern, ["year"], ["gdp"])


@query("E4_annual_to_monthly", with_roles("cities", "arrivals", "incidents") + f", {_YEAR_ARR}, {_pattern_sql('ya')}, {_GDP} SELECT department, year, month, round(gdp,2) AS gdp FROM mon")
def annual_to_monthly(t):
    return department_months(t).select("department", "year", "month", F.round("gdp", 2).alias("gdp"))


@query("E6_municipal_gdp", with_roles("cities", "arrivals", "incidents") + f""", {_YEAR_ARR}, {_pattern_sql('ya')}, {_GDP},
 bal AS (SELECT city_id, department, sum(c_acctbal) AS b FROM cities JOIN customer ON c_nationkey=city_id GROUP BY 1, 2),
 share AS (SELECT city_id, department, 100*b/sum(b) OVER (PARTITION BY department) AS pct FROM bal)
 SELECT city_id, year, month, round(pct/100*gdp,2) AS weighted_gdp FROM share JOIN mon USING (department)""")
def municipal_gdp(t):
    bal = t.customer.groupBy(F.col("c_nationkey").alias("city_id")).agg(F.sum("c_acctbal").alias("b"))
    city = t.cities.select("city_id", "department").join(bal, "city_id")
    whole = city.groupBy("department").agg(F.sum("b").alias("all"))
    share = city.join(whole, "department").select("city_id", "department", (100 * F.col("b") / F.col("all")).alias("pct"))
    out = P.repeat_over_months(share).join(department_months(t), ["department", "month"])
    return out.select("city_id", "year", "month", F.round(F.col("pct") / 100 * F.col("gdp"), 2).alias("weighted_gdp"))
