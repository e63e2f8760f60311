"""Checked queries: modelling. Models learn the city-month panel."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import econometrics as E
from ..operators import explain as X
from ..operators import forest, penalised
from ..operators import modelling as M
from ..operators import support
from .registry import query
from .tables import with_roles

FEATURES = ["gdp", "trip_spend", "daily_spend", "crimes", "thefts", "month"]


def model_rows(t):
    p = t.facts
    return p.withColumn("row_id", F.col("city_id") * 100000 + F.col("period")).withColumns(
        {c: F.col(c).cast("double") for c in FEATURES})


_ROWS = with_roles("panel") + ", r AS (SELECT *, city_id*100000+period AS row_id FROM panel)"
_SPLIT = "(concat('0x', substr(md5(concat(row_id, ':42')),1,8))::BIGINT % 100)"


def split(t):
    return M.train_test_split(model_rows(t), F.col("row_id"))


@query("L1_train_test_split", _ROWS + f" SELECT row_id, {_SPLIT} < 20 AS is_test FROM r")
def train_test_split(t):
    train, test = split(t)
    return train.select("row_id", F.lit(False).alias("is_test")).unionByName(test.select("row_id", F.lit(True).alias("is_test")))


@query("L2_standardize", _ROWS + f", tr AS (SELECT * FROM r WHERE {_SPLIT}>=20), mo AS (SELECT avg(gdp) AS gm, stddev_pop(gdp) AS gs, avg(crimes) AS cm, stddev_pop(crimes) AS cs FROM tr) "
       "SELECT row_id, round((gdp-gm)/gs,6) AS gdp, round((crimes-cm)/cs,6) AS crimes FROM r, mo")
def standardize(t):
    rows = model_rows(t)
    train, _ = M.train_test_split(rows, F.col("row_id"))
    out = M.standardize(rows, M.moments(train, ["gdp", "crimes"]))
    return out.select("row_id", F.round("gdp", 6).alias("gdp"), F.round("crimes", 6).alias("crimes"))


@query("L4_polynomial_features", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x1, round(l_quantity*l_quantity,8) AS x2, l_discount AS x3,
 round(l_quantity*l_discount,8) AS x4, round(l_discount*l_discount,8) AS x5 FROM lineitem""")
def polynomial_features(t):
    out = M.polynomial_features(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], 2)
    v = vector_to_array("poly")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(F.get(v, F.lit(i)), 8).alias(f"x{i + 1}") for i in range(5)])


@query("L5_feature_union", _ROWS + f", tr AS (SELECT * FROM r WHERE {_SPLIT}>=20), mo AS (SELECT avg(gdp) AS gm, stddev_pop(gdp) AS gs, avg(crimes) AS cm, stddev_pop(crimes) AS cs FROM tr) "
       "SELECT row_id, round((gdp-gm)/gs,6) AS f0, round((crimes-cm)/cs,6) AS f1, round(gdp,4) AS f2, round(crimes,4) AS f3 FROM r, mo")
def feature_union(t):
    rows = model_rows(t)
    train, _ = M.train_test_split(rows, F.col("row_id"))
    v = vector_to_array("features")
    out = M.ScaledUnion(["gdp", "crimes"]).fit(train).transform(rows)
    return out.select("row_id", *[F.round(F.get(v, F.lit(i)), 6 if i < 2 else 4).alias(f"f{i}") for i in range(4)])


@query("L6_one_hot", """WITH c AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment)-1 AS slot FROM (SELECT DISTINCT c_mktsegment FROM customer))
 SELECT c_custkey, slot::BIGINT AS slot, 1.0 AS value FROM customer JOIN c USING (c_mktsegment)""")
def one_hot(t):
    out = M.one_hot(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    hot = out.select("c_custkey", F.posexplode(vector_to_array("c_mktsegment_hot")).alias("slot", "value"))
    return hot.where("value > 0").withColumn("slot", F.col("slot").cast("bigint"))


def known_prediction(df):
    """A fixed linear predictor: its effect on any report can be written down in SQL."""
    return df.withColumn("prediction", 2.0 + F.col("gdp") * 0.000004 + F.col("crimes") * 0.01 - F.col("thefts") * 0.05)


_KNOWN = "2.0::DOUBLE+gdp*0.000004::DOUBLE+crimes*0.01::DOUBLE-thefts*0.05::DOUBLE"


@query("L8_regression_metrics", _ROWS + f", e AS (SELECT year, visitors AS y, visitors-({_KNOWN}) AS e FROM r) SELECT year, round(1-avg(e*e)/var_pop(y),6) AS r2, round(avg(abs(e)),6) AS mae, round(avg(e*e),6) AS mse, round(sqrt(avg(e*e)),6) AS rmse FROM e GROUP BY 1")
def regression_metrics(t):
    m = M.regression_metrics(known_prediction(model_rows(t)), "visitors", "prediction", ["year"])
    return m.withColumns({c: F.round(c, 6) for c in ("r2", "mae", "mse", "rmse")})


@query("L9_residual_table", _ROWS + f" SELECT row_id, visitors AS actual, round({_KNOWN},6) AS predicted, round(visitors-({_KNOWN}),6) AS error FROM r")
def residual_table(t):
    r = M.residuals(known_prediction(model_rows(t)), "visitors", "prediction", ["row_id"])
    return r.withColumns({c: F.round(c, 6) for c in ("predicted", "error")})


@query("P4_predicted_vs_actual", _ROWS + f" SELECT row_id, visitors AS actual, round({_KNOWN},6) AS predicted FROM r WHERE {_SPLIT}<20")
def predicted_vs_actual(t):
    _, test = split(t)
    return X.predicted_vs_actual(known_prediction(test), ["row_id"], "visitors").withColumn("predicted", F.round("predicted", 6))


@query("L23_leaderboard_fitted")
def leaderboard_fitted(t):
    """Hold-out scores of fitted models, best first."""
    names = ["linear", "ridge", "lasso", "elastic_net", "decision_tree", "boosted_trees_explained"]
    return M.leaderboard([(n, holdout(t, n)) for n in names])


@query("L23_leaderboard", _ROWS + f""", p AS (SELECT 'known' AS model, visitors AS y, {_KNOWN} AS q FROM r UNION ALL SELECT 'gdp only', visitors, gdp*0.000004::DOUBLE FROM r UNION ALL SELECT 'thefts', visitors, thefts FROM r)
 SELECT model, round(1-avg((y-q)*(y-q))/var_pop(y),6) AS r2, round(avg(abs(y-q)),6) AS mae, round(avg((y-q)*(y-q)),6) AS mse, round(sqrt(avg((y-q)*(y-q))),6) AS rmse FROM p GROUP BY 1""")
def leaderboard(t):
    r = model_rows(t)
    models = [("known", known_prediction(r)), ("gdp only", r.withColumn("prediction", F.col("gdp") * 0.000004)),
              ("thefts", r.withColumn("prediction", F.col("thefts")))]
    board = M.leaderboard([(n, M.regression_metrics(p, "visitors", "prediction")) for n, p in models])
    return board.withColumns({c: F.round(c, 6) for c in ("r2", "mae", "mse", "rmse")})


@query("F5_rank_models", _ROWS + f""", p AS (SELECT year, visitors AS y, {_KNOWN} AS q FROM r), s AS (SELECT year, 1-avg((y-q)*(y-q))/var_pop(y) AS r2 FROM p GROUP BY 1)
 SELECT year, round(r2,6) AS r2 FROM s ORDER BY r2 DESC""")
def rank_models(t):
    m = M.regression_metrics(known_prediction(model_rows(t)), "visitors", "prediction", ["year"])
    return m.select("year", F.round("r2", 6).alias("r2")).orderBy(F.desc("r2"), "year")


@query("L10_linear_regression_one", _ROWS + f""", f AS (SELECT regr_slope(visitors,gdp) AS b, regr_intercept(visitors,gdp) AS a FROM r WHERE {_SPLIT}>=20)
 SELECT row_id, round(a+b*gdp,4) AS prediction FROM r, f WHERE {_SPLIT}<20""")
def linear_one(t):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    train, test = split(t)
    va = VectorAssembler(inputCols=["gdp"], outputCol="features")
    model = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0).fit(va.transform(train).withColumn("label", F.col("visitors")))
    return model.transform(va.transform(test)).select("row_id", F.round("prediction", 4).alias("prediction"))


# -- one regressor, where the fitted values have a closed form ----------------------------------

_ONE = _ROWS + f""", tr AS (SELECT * FROM r WHERE {_SPLIT}>=20), mo AS (SELECT avg(gdp) AS gm, stddev_pop(gdp) AS gs, avg(visitors) AS vm, stddev_samp(visitors) AS vs FROM tr),
 g AS (SELECT count(*) AS n, sum(power((gdp-gm)/gs,2)) AS sxx, sum((gdp-gm)/gs*(visitors-vm)) AS sxy FROM tr, mo)"""


def _one(t, kind: str, **params):
    train, test = split(t)
    mean, dev = train.agg(F.avg("visitors"), F.stddev_samp("visitors")).first()
    scaled = train.withColumn("label", (F.col("visitors") - mean) / dev)
    model = penalised.fit(scaled, ["gdp"], "label", kind, raw=False, scale_target=False, **params)
    return model.predict(test).select("row_id", F.round(F.col("prediction") * dev + mean, 2).alias("prediction"))


@query("L13_ridge_one", _ONE + f" SELECT row_id, round(vm+sxy/(sxx+500.0::DOUBLE)*(gdp-gm)/gs,2) AS prediction FROM r, mo, g WHERE {_SPLIT}<20")
def ridge_one(t):
    return _one(t, "ridge", alpha=500.0)


@query("L12_lasso_one", _ONE + f" SELECT row_id, round(vm+sign(sxy)*greatest(abs(sxy)/n-0.2::DOUBLE*vs,0)/(sxx/n)*(gdp-gm)/gs,2) AS prediction FROM r, mo, g WHERE {_SPLIT}<20")
def lasso_one(t):
    return _one(t, "lasso", alpha=0.2)


@query("L14_elastic_net_one", _ONE + f" SELECT row_id, round(vm+sign(sxy)*greatest(abs(sxy)/n-0.1::DOUBLE*vs,0)/(sxx/n+0.1::DOUBLE)*(gdp-gm)/gs,2) AS prediction FROM r, mo, g WHERE {_SPLIT}<20")
def elastic_net_one(t):
    return _one(t, "elastic_net", alpha=0.2, l1_ratio=0.5)


_STUMP = _ROWS + f""", tr AS (SELECT * FROM r WHERE {_SPLIT}>=20), cuts AS (SELECT unnest(range(1,12)) AS m),
 s AS (SELECT m, avg(visitors) FILTER (month<=m) AS lo, avg(visitors) FILTER (month>m) AS hi, count(*) FILTER (month<=m)*power(avg(visitors) FILTER (month<=m),2)+count(*) FILTER (month>m)*power(avg(visitors) FILTER (month>m),2) AS gain FROM tr, cuts GROUP BY 1),
 b AS (SELECT m, lo, hi FROM s QUALIFY row_number() OVER (ORDER BY round(gain,6) DESC, m)=1) SELECT row_id, round(CASE WHEN month<=m THEN lo ELSE hi END,6) AS prediction FROM r, b WHERE {_SPLIT}<20"""


def _tree(t, columns, how):
    train, test = split(t)
    return forest.fit(train, columns, "visitors", how).predict(test).select("row_id", F.round("prediction", 6).alias("prediction"))


@query("L16_decision_stump", _STUMP)
def decision_stump(t):
    return _tree(t, ["month"], forest.growth("decision_tree", depth=1))


@query("L17_forest_of_one_stump", _STUMP)
def forest_of_one_stump(t):
    return _tree(t, ["month"], forest.growth("random_forest", depth=1, trees=1, bootstrap=False))


def _depth_two(penalty: float, rate: float) -> str:
    """SQL of one tree of depth 2 on month and year: the best cut of all rows, then of each side; a leaf is its sum over its rows and the penalty."""
    gain = f"power(sum(g) FILTER (x<=c),2)/(count(*) FILTER (x<=c)+{penalty})+power(sum(g) FILTER (x>c),2)/(count(*) FILTER (x>c)+{penalty})-power(sum(g),2)/(count(*)+{penalty})"
    return _ROWS + f""", mo AS (SELECT avg(visitors) AS vm, stddev_pop(visitors) AS vs FROM r WHERE {_SPLIT}>=20),
 tr AS (SELECT row_id, month, year, (visitors-vm)/vs AS g FROM r, mo WHERE {_SPLIT}>=20),
 xs AS (SELECT row_id, g, 0 AS f, month AS x FROM tr UNION ALL SELECT row_id, g, 1, year FROM tr), cs AS (SELECT DISTINCT f, x AS c FROM xs),
 top AS (SELECT f, c FROM xs JOIN cs USING (f) GROUP BY f, c HAVING count(*) FILTER (x>c)>0 ORDER BY round({gain},9) DESC, f, c LIMIT 1),
 side AS (SELECT r.row_id, CASE WHEN top.f=0 THEN month ELSE year END>top.c AS s FROM r, top),
 low AS (SELECT s, f, c, row_number() OVER (PARTITION BY s ORDER BY round({gain},9) DESC, f, c) AS k
  FROM (SELECT * FROM xs JOIN side USING (row_id)) JOIN cs USING (f) GROUP BY s, f, c HAVING count(*) FILTER (x>c)>0 AND count(*) FILTER (x<=c)>0 QUALIFY k=1),
 leaf AS (SELECT r.row_id, r.visitors, s, CASE WHEN f=0 THEN month ELSE year END>c AS e FROM r JOIN side USING (row_id) JOIN low USING (s)),
 val AS (SELECT s, e, vm+vs*{rate}::DOUBLE*sum(g)/(count(*)+{penalty}) AS p FROM leaf JOIN tr USING (row_id), mo GROUP BY s, e, vm, vs)
 SELECT row_id, round(p,6) AS prediction FROM leaf JOIN val USING (s, e) WHERE {_SPLIT}<20"""


@query("L16_decision_tree_depth_two", _depth_two(0.0, 1.0))
def decision_tree_depth_two(t):
    return _tree(t, ["month", "year"], forest.growth("decision_tree", depth=2))


@query("L19_one_round_depth_two", _depth_two(1.0, 0.3))
def one_round_depth_two(t):
    """One round of second-order boosting: leaf values with the penalty of 1, a step of 0.3."""
    return _tree(t, ["month", "year"], forest.growth("boosted_trees", trees=1, depth=2))


@query("L18_two_rounds", _STUMP.split("SELECT row_id, round(CASE")[0] + f""", mu AS (SELECT avg(visitors) AS m0 FROM tr),
 t1 AS (SELECT r.*, visitors-m0-0.1::DOUBLE*(CASE WHEN month<=b.m THEN lo ELSE hi END-m0) AS res, m0+0.1::DOUBLE*(CASE WHEN month<=b.m THEN lo ELSE hi END-m0) AS p1 FROM r, b, mu),
 s2 AS (SELECT cuts.m, avg(res) FILTER (month<=cuts.m) AS lo, avg(res) FILTER (month>cuts.m) AS hi,
  count(*) FILTER (month<=cuts.m)*power(avg(res) FILTER (month<=cuts.m),2)+count(*) FILTER (month>cuts.m)*power(avg(res) FILTER (month>cuts.m),2) AS gain FROM t1, cuts WHERE {_SPLIT}>=20 GROUP BY 1),
 b2 AS (SELECT m, lo, hi FROM s2 QUALIFY row_number() OVER (ORDER BY round(gain,6) DESC, m)=1)
 SELECT row_id, round(p1+0.1::DOUBLE*CASE WHEN month<=b2.m THEN b2.lo ELSE b2.hi END,6) AS prediction FROM t1, b2 WHERE {_SPLIT}<20""")
def two_rounds(t):
    """Gradient boosting, two rounds of stumps."""
    return _tree(t, ["month"], forest.growth("gradient_boosting", trees=2, depth=1))


def holdout(t, name: str, columns=FEATURES, scale_target=True):
    """Hold-out scores of one model of the final list, errors in deviations of the target."""
    kind, degree, params = M.FINAL_MODELS[name]
    train, test = split(t)
    model = M.fit(train, columns, "visitors", kind, degree, scale_target, **params)
    unit = M.moments(train, ["visitors"])["visitors"][1] if scale_target else 1.0
    return M.regression_metrics(model.predict(test), "visitors", "prediction", unit=unit).withColumn("model", F.lit(name))


@query("L7_kfold_scores")
def kfold_scores(t):
    return M.kfold_scores(split(t)[0], F.col("row_id"), FEATURES, "visitors", "linear")


def _register(op: str, name: str, columns=FEATURES, scale_target=True):
    @query(op)
    def run(t):
        return holdout(t, name, columns, scale_target)


_register("L10_linear_regression", "linear")
_register("L11_polynomial_regression", "polynomial")
_register("L11_polynomial_regression_cubic", "polynomial_cubic")
_register("L12_lasso", "lasso")
_register("L13_ridge", "ridge")
_register("L14_elastic_net", "elastic_net")
_register("L16_decision_tree", "decision_tree")
_register("L17_random_forest", "random_forest")
_register("L18_gradient_boosting", "gradient_boosting")
_register("L19_boosted_trees_full", "boosted_trees")
_register("L19_boosted_trees_regularised", "boosted_trees_explained", FEATURES, False)
_register("L19_boosted_trees_compact", "boosted_trees_compact", ["gdp", "trip_spend", "crimes"])


@query("L20_linear_svr")
def linear_svr(t):
    train, test = split(t)
    model = M.linear_svr(train, FEATURES, "visitors", epsilon=0.05)
    return M.regression_metrics(M.svr_predict(model, test), "visitors", "prediction", unit=model["y"][1])


@query("L20_kernel_svr")
def kernel_svr(t):
    train, test = split(t)
    model = support.fit(train, F.col("row_id"), FEATURES, "visitors", kernel="rbf", c=10.0, epsilon=0.05)
    return M.regression_metrics(model.predict(test), "visitors", "prediction", unit=model.target[1])


def _register_search(op: str, kind: str, columns=FEATURES):
    @query(op)
    def run(t):
        return M.random_search(model_rows(t), F.col("row_id"), columns, "visitors", kind)


_register_search("L21_random_search", "ridge")
for _kind in ("lasso", "elastic_net", "knn", "decision_tree", "random_forest", "gradient_boosting", "boosted_trees", "svr"):
    _register_search(f"L21_random_search_{_kind}", _kind)
_register_search("L21_random_search_boosted_trees_compact", "boosted_trees_compact", ["gdp", "trip_spend", "crimes"])


@query("L22_randomized_search_cv")
def randomized_search_cv(t):
    return M.randomized_search_cv(split(t)[0], FEATURES, "visitors", F.col("row_id"), "ridge", draws=5)


@query("L22_randomized_search_cv_boosted_trees")
def randomized_search_cv_boosted(t):
    return M.randomized_search_cv(split(t)[0], FEATURES, "visitors", F.col("row_id"), "boosted_trees", draws=5)


@query("L22_randomized_search_cv_svr")
def randomized_search_cv_svr(t):
    return M.randomized_search_cv(split(t)[0], FEATURES, "visitors", F.col("row_id"), "svr_kernel", draws=5)


# -- econometrics -----------------------------------------------------------------------------

SIX = ["crimes", "trip_spend", "thefts", "daily_spend", "month", "gdp"]


def lagged(t):
    from ..operators.panel import lag_features

    return lag_features(t.facts, ["city_id"], "period", {"visitors_l1": ("visitors", 1), "visitors_l2": ("visitors", 2), "gdp_l1": ("gdp", 1)})


_LAG = with_roles("panel") + """, lg AS (SELECT * FROM (SELECT *, lag(visitors,1) OVER w AS visitors_l1, lag(visitors,2) OVER w AS visitors_l2, lag(gdp,1) OVER w AS gdp_l1
 FROM panel WINDOW w AS (PARTITION BY city_id ORDER BY period)) WHERE visitors_l2 IS NOT NULL)"""


def _gram_sql(table: str, cols: list[str]) -> str:
    names = [c if c != "const" else "1.0" for c in cols]
    return " UNION ALL ".join(f"SELECT '{cols[i]}' AS a, '{cols[j]}' AS b, round(sum({names[i]}*{names[j]}::DOUBLE)/count(*),2) AS value FROM {table}"
                              for i in range(len(cols)) for j in range(i, len(cols)))


def _scaled_gram(rows, y, xs, constant):
    n = rows.count()
    return E.gram(rows, y, xs, constant).withColumn("value", F.round(F.col("value") / n, 2))


@query("M1_ols_lagged", f"{_LAG} " + _gram_sql("lg", ["visitors_l1", "visitors_l2", "gdp_l1", "visitors"]))
def ols_lagged_gram(t):
    return _scaled_gram(lagged(t), "visitors", ["visitors_l1", "visitors_l2", "gdp_l1"], False)


_CRAMER = f"""{_LAG}, g AS (SELECT sum(visitors_l1*visitors_l1)::DOUBLE AS a, sum(visitors_l1*visitors_l2)::DOUBLE AS b, sum(visitors_l1*gdp_l1) AS c, sum(visitors_l2*visitors_l2)::DOUBLE AS d,
 sum(visitors_l2*gdp_l1) AS e, sum(gdp_l1*gdp_l1) AS f, sum(visitors_l1*visitors)::DOUBLE AS u, sum(visitors_l2*visitors)::DOUBLE AS v, sum(gdp_l1*visitors) AS w FROM lg),
 k AS (SELECT *, a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS det FROM g)
 SELECT 'visitors_l1' AS term, round((u*(d*f-e*e)-b*(v*f-e*w)+c*(v*e-d*w))/det,6) AS coef FROM k
 UNION ALL SELECT 'visitors_l2', round((a*(v*f-e*w)-u*(b*f-c*e)+c*(b*w-c*v))/det,6) FROM k
 UNION ALL SELECT 'gdp_l1_million', round(1000000*(a*(d*w-e*v)-b*(b*w-c*v)+u*(b*e-c*d))/det,4) FROM k"""


@query("M1_ols_lagged_cramer", _CRAMER)
def ols_lagged_cramer(t):
    c = E.OLS(lagged(t), "visitors", ["visitors_l1", "visitors_l2", "gdp_l1"], constant=False).coefficients()
    million = F.col("term") == "gdp_l1"
    return c.select(F.when(million, "gdp_l1_million").otherwise(F.col("term")).alias("term"),
                    F.when(million, F.round(F.col("coef") * 1000000, 4)).otherwise(F.round("coef", 6)).alias("coef"))


@query("M3_ols_normal_equations", " UNION ALL ".join(f"SELECT '{x}' AS term, 0.0::DOUBLE AS moment" for x in ["const", *SIX]) + " ORDER BY 1")
def ols_normal_equations(t):
    """Residuals of the full model are orthogonal to every regressor (correlations, rounded; the constant by the mean)."""
    rows = E.OLS(t.facts, "visitors", SIX).residuals()
    found = rows.agg(F.array(F.struct(F.lit("const").alias("term"), F.avg("residual").alias("m")),
                             *[F.struct(F.lit(x).alias("term"), F.corr("residual", x).alias("m")) for x in SIX]).alias("a"))
    return found.select(F.inline("a")).select("term", F.abs(F.round("m", 5)).alias("moment"))


@query("M1_ols_lagged_coefficients")
def ols_lagged(t):
    return E.OLS(lagged(t), "visitors", ["visitors_l1", "visitors_l2", "gdp_l1"], constant=False).coefficients()


@query("M2_ols_simple", with_roles("panel") + " SELECT 'const' AS term, round(regr_intercept(visitors,gdp),6) AS coef, round(regr_r2(visitors,gdp),6) AS r2 FROM panel UNION ALL SELECT 'gdp_thousand', round(1000*regr_slope(visitors,gdp),6), round(regr_r2(visitors,gdp),6) FROM panel")
def ols_simple(t):
    m = E.OLS(t.facts.withColumn("gdp_thousand", F.col("gdp") / 1000), "visitors", ["gdp_thousand"])
    return m.coefficients().select("term", F.round("coef", 6).alias("coef"), F.lit(round(m.r2, 6)).alias("r2"))


@query("M3_ols_multi", with_roles("panel") + " " + _gram_sql("panel", ["const", *SIX, "visitors"]))
def ols_multi_gram(t):
    return _scaled_gram(t.panel, "visitors", SIX, True)


@query("M3_ols_multi_coefficients")
def ols_multi(t):
    return E.OLS(t.facts, "visitors", SIX).coefficients()


@query("M4_ols_diagnostics", with_roles("panel") + """, f AS (SELECT regr_slope(visitors,gdp) AS b, regr_intercept(visitors,gdp) AS a FROM panel),
 e AS (SELECT city_id, period, visitors-(a+b*gdp) AS e FROM panel, f), d AS (SELECT e, e-lag(e) OVER (ORDER BY city_id, period) AS de FROM e),
 c AS (SELECT e, e-avg(e) OVER () AS u, de FROM d), m AS (SELECT count(*) AS n, avg(u*u) AS m2, avg(u*u*u) AS m3, avg(u*u*u*u) AS m4, sum(de*de)/sum(e*e) AS dw FROM c),
 s AS (SELECT n, m3/power(m2,1.5) AS sk, m4/(m2*m2) AS ku, dw FROM m)
 SELECT n, round(sk,5) AS skew, round(ku,5) AS kurtosis, round(n/6.0*(sk*sk+(ku-3)*(ku-3)/4),4) AS jarque_bera, round(dw,5) AS durbin_watson FROM s""")
def ols_diagnostics(t):
    s = E.OLS(t.facts, "visitors", ["gdp"]).summary([F.col("city_id"), F.col("period")])
    return s.select("n", F.round("skew", 5).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"),
                    F.round("jarque_bera", 4).alias("jarque_bera"), F.round("durbin_watson", 5).alias("durbin_watson"))


@query("M4_ols_summary")
def ols_summary(t):
    return E.OLS(t.facts, "visitors", SIX).summary([F.col("city_id"), F.col("period")])


def random_effects_frame(t):
    r = E.random_effects(t.facts, "city_id", "visitors", SIX)
    rows = [(n, float(c), float(s), float(c / s)) for n, c, s in zip(r["terms"], r["coef"], r["se"])]
    return t.spark.createDataFrame(rows, "term string, coef double, se double, t double").select(
        "*", *[F.lit(r[k]).alias(k) for k in ("sigma2_e", "sigma2_u", "r2_overall", "r2_between", "r2_within")])


@query("M5_random_effects")
def random_effects(t):
    return random_effects_frame(t)


@query("M5_random_effects_one", with_roles("panel") + """, p AS (SELECT city_id, visitors::DOUBLE AS y, gdp/1000 AS x FROM panel WHERE visitors IS NOT NULL AND gdp IS NOT NULL),
 e AS (SELECT city_id, count(*)::DOUBLE AS t, avg(y) AS my, avg(x) AS mx, count(*)*covar_pop(x,y) AS wxy, count(*)*var_pop(x) AS wxx, count(*)*var_pop(y) AS wyy FROM p GROUP BY 1),
 v AS (SELECT sum(t) AS n, count(*) AS m, (sum(wyy)-sum(wxy)*sum(wxy)/sum(wxx))/(sum(t)-count(*)-1) AS s2e, count(*)*(var_pop(my)-covar_pop(mx,my)*covar_pop(mx,my)/var_pop(mx))/(count(*)-2) AS s2b, count(*)/sum(1/t) AS tbar FROM e),
 u AS (SELECT n, s2e, greatest(0.0, s2b-s2e/tbar) AS s2u FROM v), a AS (SELECT e.*, t*s2e/(t*s2u+s2e) AS a FROM e, u),
 g AS (SELECT sum(a) AS s0, sum(a*mx) AS sx, sum(a*my) AS sy, sum(wxx)+sum(a*mx*mx) AS sxx, sum(wxy)+sum(a*mx*my) AS sxy, sum(wyy)+sum(a*my*my) AS syy FROM a),
 b AS (SELECT *, (sxy-sx*sy/s0)/(sxx-sx*sx/s0) AS b FROM g), c AS (SELECT *, (sy-b*sx)/s0 AS c FROM b),
 r AS (SELECT c.*, u.*, sqrt((syy-c*sy-b*sxy)/(n-2)) AS s FROM c, u)
 SELECT 'const' AS term, round(c,4) AS coef, round(s*sqrt(sxx/(s0*sxx-sx*sx)),4) AS se, round(s2e,4) AS sigma2_e, round(s2u,4) AS sigma2_u FROM r
 UNION ALL SELECT 'gdp_thousand', round(b,4), round(s*sqrt(s0/(s0*sxx-sx*sx)),4), round(s2e,4), round(s2u,4) FROM r""")
def random_effects_one(t):
    r = E.random_effects(t.facts.withColumn("gdp_thousand", F.col("gdp") / 1000), "city_id", "visitors", ["gdp_thousand"])
    rows = [(n, float(c), float(s), r["sigma2_e"], r["sigma2_u"]) for n, c, s in zip(r["terms"], r["coef"], r["se"])]
    frame = t.spark.createDataFrame(rows, "term string, coef double, se double, sigma2_e double, sigma2_u double")
    return frame.select("term", *[F.round(c, 4).alias(c) for c in frame.columns[1:]])


@query("M6_model_vs_econometrics")
def model_vs_econometrics(t):
    p = t.facts
    rows = [("ols, lags", float(E.OLS(lagged(t), "visitors", ["visitors_l1", "visitors_l2", "gdp_l1"], False).r2)),
            ("ols, gdp", float(E.OLS(p, "visitors", ["gdp"]).r2)), ("ols, six regressors", float(E.OLS(p, "visitors", SIX).r2)),
            ("random effects, overall", float(E.random_effects(p, "city_id", "visitors", SIX)["r2_overall"]))]
    econ = t.spark.createDataFrame(rows, "model string, r2 double")
    trees = holdout(t, "decision_tree").unionByName(holdout(t, "linear")).select("model", "r2")
    return econ.unionByName(trees).orderBy(F.desc("r2"))


# -- explanation ------------------------------------------------------------------------------

_PF = ["gdp", "crimes", "thefts"]


def _num(text: str) -> str:
    return f"concat('0x', substr(md5(concat({text}, ':42')),1,15))::BIGINT"


@query("P1_permutation_importance", _ROWS + f""", ix AS (SELECT *, row_number() OVER (ORDER BY concat('0x', substr(md5(concat(row_id, ':42')),1,8))::BIGINT % 1024, row_id)-1 AS idx FROM r),
 n AS (SELECT count(*) AS n FROM r), k AS (SELECT i, j, n, {_num("i || ':' || j")} % (n-1) + 1 AS a FROM (SELECT unnest(range(0,300)) AS i), (SELECT unnest(range(0,60)) AS j), n),
 ab AS (SELECT i, a, n, {_num("i || ':b'")} % n AS b FROM k WHERE gcd(a, n)=1 QUALIFY row_number() OVER (PARTITION BY i ORDER BY j)=1),
 mx AS (SELECT i, x.visitors AS y, CASE WHEN i//100=0 THEN d.gdp ELSE x.gdp END AS gdp, CASE WHEN i//100=1 THEN d.crimes ELSE x.crimes END AS crimes,
  CASE WHEN i//100=2 THEN d.thefts ELSE x.thefts END AS thefts FROM ab JOIN ix x ON true JOIN ix d ON d.idx=(a*x.idx+b)%n),
 sc AS (SELECT i, 1-avg(power(y-({_KNOWN}),2))/var_pop(y) AS r2 FROM mx GROUP BY 1), base AS (SELECT 1-avg(power(visitors-({_KNOWN}),2))/var_pop(visitors) AS r0 FROM r)
 SELECT ['gdp','crimes','thefts'][i//100+1] AS feature, i%100 AS repeat, round(r0-r2,6) AS loss FROM sc, base""")
def permutation_importance(t):
    out = X.permutation_importance(model_rows(t), "row_id", _PF, "visitors", known_prediction, repeats=100)
    return out.withColumn("loss", F.round("loss", 6))


def tree_model(t):
    train, test = split(t)
    kind, degree, params = M.FINAL_MODELS["boosted_trees_explained"]
    return M.fit(train, FEATURES, "visitors", kind, degree, False, **params), train, test


@query("P1_permutation_importance_trees")
def permutation_importance_trees(t):
    model, _, test = tree_model(t)
    return X.importance_boxes(X.permutation_importance(test, "row_id", FEATURES, "visitors", model.predict, repeats=100))


@query("P2_lime_local")
def lime_local(t):
    """Surrogates for the busiest city-month and the quietest one of every city."""
    model, train, _ = tree_model(t)
    ends = train.groupBy("city_id").agg(F.min_by("row_id", F.struct("visitors", "row_id")).alias("lo"), F.max_by("row_id", F.struct("visitors", "row_id")).alias("hi"))
    rows = train.join(ends.select(F.explode(F.array("lo", "hi")).alias("row_id")).distinct(), "row_id", "left_semi")
    return X.lime(rows.select("row_id", *FEATURES), "row_id", FEATURES, X.quartile_bins(train, FEATURES), model.predict, samples=5000)


_GRIDS = {"gdp": (1.0, 4000000.0, 100), "crimes": (0.0, 500.0, 70), "thefts": (0.0, 20.0, 50)}


@query("P3_partial_dependence", _ROWS + ", g AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round({lo!r}::DOUBLE+({hi!r}::DOUBLE-{lo!r}::DOUBLE)*i/{n - 1},6) AS v FROM (SELECT unnest(range(0,{n})) AS i)" for c, (lo, hi, n) in _GRIDS.items())
       + ") SELECT feature, v AS value, round(2.0+avg(CASE WHEN feature='gdp' THEN v ELSE gdp END)*0.000004::DOUBLE+avg(CASE WHEN feature='crimes' THEN v ELSE crimes END)*0.01"
         "-avg(CASE WHEN feature='thefts' THEN v ELSE thefts END)*0.05,5) AS mean_prediction FROM g, r GROUP BY ALL")
def partial_dependence(t):
    out = X.partial_dependence(model_rows(t), _PF, _GRIDS, known_prediction)
    return out.select("feature", F.round("value", 6).alias("value"), F.round("mean_prediction", 5).alias("mean_prediction"))


@query("P3_partial_dependence_trees")
def partial_dependence_trees(t):
    model, _, test = tree_model(t)
    return X.partial_dependence(test, FEATURES, _GRIDS, model.predict)
