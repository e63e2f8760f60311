"""Splits, scaling, feature sets, regressors, scores and hyper-parameter search."""

from __future__ import annotations

import random
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest, knn, penalised, support
from .scale import hash_bucket, materialise


def train_test_split(df: DataFrame, key: Column, test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split that depends only on the row key and the seed."""
    b = hash_bucket(key, seed, 100)
    return df.where(b >= test_percent), df.where(b < test_percent)


def fold_of(key: Column, folds: int = 5, seed: int = 7) -> Column:
    return hash_bucket(key, seed, folds).cast("int")


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per column; a constant column gets 1."""
    row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return {c: (row[f"{c}_m"], row[f"{c}_s"] or 1.0) for c in columns}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


class ScaledUnion:
    """Scaled columns next to raw polynomial columns: ``features`` from ``columns``."""

    def __init__(self, columns: list[str], degree: int = 1):
        self.columns, self.degree = columns, degree

    def fit(self, train: DataFrame) -> "ScaledUnion":
        self.stats = moments(train, self.columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = standardize(df, self.stats, "_z_")
        out = VectorAssembler(inputCols=self.columns, outputCol="_raw").transform(out)
        if self.degree > 1:
            out = PolynomialExpansion(degree=self.degree, inputCol="_raw", outputCol="_poly").transform(out)
        else:
            out = out.withColumnRenamed("_raw", "_poly")
        union = VectorAssembler(inputCols=[*[f"_z_{c}" for c in self.columns], "_poly"], outputCol="features")
        return union.transform(out).drop("_raw", "_poly", *[f"_z_{c}" for c in self.columns])


def polynomial_features(df: DataFrame, columns: list[str], degree: int, out: str = "poly") -> DataFrame:
    """All monomials up to ``degree``, without a constant."""
    raw = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="_raw", outputCol=out).transform(raw).drop("_raw")


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """An indicator vector per column, one slot for every category."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_index" for c in columns], stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_hot" for c in columns], dropLast=False)
    return Pipeline(stages=[index, encode]).fit(df).transform(df)


TREES = ("decision_tree", "random_forest", "gradient_boosting", "boosted_trees")
PENALISED = ("ridge", "lasso", "elastic_net")


# Chosen parameters of each model; the last two are the explained and the compact one.
FINAL_MODELS = {
    "linear": ("linear", 1, {}),
    "polynomial": ("polynomial", 2, {}),
    "polynomial_cubic": ("polynomial", 3, {}),
    "ridge": ("ridge", 1, {"alpha": 2.0}),
    "lasso": ("lasso", 2, {"alpha": 3.0}),
    "elastic_net": ("elastic_net", 2, {"alpha": 10.0, "l1_ratio": 0.020408}),
    "decision_tree": ("decision_tree", 1, {"depth": 13, "leaf": 5}),
    "random_forest": ("random_forest", 1, {"trees": 38, "depth": 45, "leaf": 5}),
    "gradient_boosting": ("gradient_boosting", 1, {"trees": 58, "depth": 9}),
    "boosted_trees": ("boosted_trees", 1, {"trees": 266, "depth": 17, "gamma": 0.21052631578947367}),
    "boosted_trees_explained": ("boosted_trees", 1, {"trees": 41, "depth": 5}),
    "boosted_trees_compact": ("boosted_trees", 1, {"trees": 159, "depth": 3, "gamma": 0.0}),
}


class FittedModel:
    """Features, target scale and model together; ``predict`` adds ``prediction`` to any rows."""

    def __init__(self, union: ScaledUnion, model, target: tuple[float, float] | None):
        self.union, self.model, self.target = union, model, target

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.union.transform(df)).drop("features")
        if self.target:
            m, s = self.target
            out = out.withColumn("prediction", F.col("prediction") * s + m)
        return out


def fit(train: DataFrame, columns: list[str], target: str, kind: str, degree: int = 1, scale_target: bool = True, **params):
    """Fit one model; with ``scale_target`` it learns in units of the training target's deviation. Penalties are in units of
    the mean squared loss, except ridge; trees do not depend on the degree, since they see an order of values only."""
    if kind in TREES:
        return forest.fit(train, columns, target, forest.growth(kind, **params), scale_target=scale_target)
    if kind in PENALISED:
        return penalised.fit(train, columns, target, kind, degree, scale_target, **params)
    if kind not in ("linear", "polynomial"):
        raise ValueError(f"unknown model {kind}")
    union = ScaledUnion(columns, degree).fit(train)
    scale = moments(train, [target])[target] if scale_target else None
    label = (F.col(target) - scale[0]) / scale[1] if scale else F.col(target)
    rows = union.transform(train).select("features", label.cast("double").alias("label")).persist()
    try:
        model = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0).fit(rows)
    finally:
        rows.unpersist()
    return FittedModel(union, model, scale)


def regression_metrics(df: DataFrame, y: str, pred: str, keys: list[str] | None = None, unit: float = 1.0) -> DataFrame:
    """(keys..., r2, mae, mse, rmse) in one pass; ``unit`` divides the errors (1 sigma, say)."""
    e = (F.col(y) - F.col(pred)) / F.lit(float(unit))
    agg = df.groupBy(*(keys or [])).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.col(y) / F.lit(float(unit))).alias("_v"))
    return agg.select(*(keys or []), (1 - F.try_divide("mse", "_v")).alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def residuals(df: DataFrame, y: str, pred: str, key: list[str]) -> DataFrame:
    return df.select(*key, F.col(y).alias("actual"), F.col(pred).alias("predicted"), (F.col(y) - F.col(pred)).alias("error"))


def kfold_scores(df: DataFrame, key: Column, columns: list[str], target: str, kind: str, degree: int = 1, folds: int = 5, **params) -> DataFrame:
    """(fold, r2, mae, mse, rmse): each fold is fitted once and scored once."""
    rows = df.withColumn("fold", fold_of(key, folds)).persist()
    try:
        scored = []
        for f in range(folds):
            train = rows.where(F.col("fold") != f)
            unit = moments(train, [target])[target][1]
            model = fit(train, columns, target, kind, degree, **params)
            scored.append(regression_metrics(model.predict(rows.where(F.col("fold") == f)), target, "prediction", ["fold"], unit))
        return reduce(DataFrame.unionByName, scored)
    finally:
        rows.unpersist()


def leaderboard(scores: list[tuple[str, DataFrame]]) -> DataFrame:
    """(model, r2, mae, mse, rmse), best first."""
    rows = [s.select(F.lit(n).alias("model"), "r2", "mae", "mse", "rmse") for n, s in scores]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("r2"), "model")


# Ranges the random searches draw from, the degree of their features, the draws, and the scores at
# which they stop. ``minkowski`` is the Euclidean distance (its default power is 2).
SEARCH_SPACE = {
    "lasso": {"alpha": list(range(1, 122))},
    "ridge": {"alpha": list(range(1, 122)), "degree": [1, 2]},
    "elastic_net": {"alpha": list(range(1, 150)), "l1_ratio": np.linspace(0, 1, 50).tolist()},
    "knn": {"weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan", "minkowski"], "k": list(range(2, 30))},
    "decision_tree": {"depth": list(range(2, 55)), "split": list(range(2, 15)), "leaf": list(range(2, 15))},
    "random_forest": {"depth": list(range(2, 55)), "split": list(range(2, 15)), "leaf": list(range(2, 15)), "trees": list(range(2, 100))},
    "gradient_boosting": {"depth": list(range(2, 25)), "trees": list(range(2, 100))},
    "boosted_trees": {"depth": list(range(2, 25)), "trees": list(range(2, 300)), "gamma": np.linspace(0, 0.5, 20).tolist()},
    "boosted_trees_compact": {"depth": list(range(2, 25)), "trees": list(range(2, 500)), "gamma": [0, 0.1, 0.2, 0.3, 0.4]},
    "svr": {"kernel": ["linear"], "epsilon": np.linspace(0.001, 1, 20).tolist()},
    "svr_kernel": {"c": lambda rng: rng.uniform(0.1, 1000.1), "epsilon": lambda rng: rng.uniform(0.01, 1.01), "kernel": ["linear", "rbf", "poly"],
                   "gamma": lambda rng: rng.choice(["scale", "auto", *[rng.uniform(0.001, 1.001) for _ in range(10)]])},
}
SEARCH_DEGREE = {"lasso": 2, "elastic_net": 2}
SEARCH_DRAWS = {"lasso": 50, "ridge": 50, "elastic_net": 20, "knn": 70, "decision_tree": 100, "random_forest": 70, "gradient_boosting": 70, "boosted_trees": 70,
                "boosted_trees_compact": 70, "svr": 70, "svr_kernel": 5}
STOP_AT = {"boosted_trees": (0.98, 0.98), "boosted_trees_compact": (0.98, 0.98), "svr": (0.98, 0.98), "svr_kernel": (0.98, 0.98)}


def split_folds(key: Column, folds: int, seed: int) -> Column:
    """The fold of a training row; TEST for the rows of the hold-out split."""
    return F.when(hash_bucket(key, seed, 100) < 20, F.lit(forest.TEST)).otherwise(fold_of(key, folds))


def score_draws(df: DataFrame, key: Column, fold: Column, columns: list[str], target: str, kind: str, drawn: list[dict], folds: int) -> list[tuple[float, float]]:
    """(mean r2 over the folds, r2 on the TEST rows) of every draw; all draws and folds share their passes over the rows."""
    kind = kind.removesuffix("_compact")
    if kind in TREES:
        models = [replace(forest.growth(kind, **p), fold=f) for p in drawn for f in (forest.ALL, *range(folds))]
        found = forest.scores(df, key, fold, columns, target, models)
        found = [found[i:i + folds + 1] for i in range(0, len(found), folds + 1)]
    elif kind in PENALISED:
        rows = materialise(df.select(fold.alias("fold"), *dict.fromkeys([*columns, target])), "search")
        degrees = sorted({p["degree"] for p in drawn})
        sums = {d: penalised.fold_sums(rows, F.col("fold"), columns, target, d) for d in degrees}
        found = [[penalised.solve(sums[p["degree"]], kind, p["alpha"], p.get("l1_ratio"), f).r2(forest.TEST if f is None else f)
                  for f in (None, *range(folds))] for p in drawn]
    elif kind == "knn":
        board = knn.neighbour_scores(df, key, fold, columns, target, max(p["k"] for p in drawn), folds)
        found = [[board["euclidean" if p["metric"] == "minkowski" else p["metric"], p["weights"], p["k"], f] for f in (forest.TEST, *range(folds))] for p in drawn]
    elif kind in ("svr", "svr_kernel"):
        found = support.fit_many(df, key, fold, columns, target, support.search_specs(drawn, folds), supports=False)[1]
        found = [found[i:i + folds + 1] for i in range(0, len(found), folds + 1)]
    else:
        raise ValueError(f"no search over {kind}")
    return [(float(np.mean(r[1:])), float(r[0])) for r in found]


def draw(kind: str, draws: int | None, seed: int, space: dict | None = None) -> list[dict]:
    rng, space = random.Random(seed), space or SEARCH_SPACE[kind]
    return [{"degree": SEARCH_DEGREE.get(kind, 1)} | {k: v(rng) if callable(v) else rng.choice(v) for k, v in space.items()} for _ in range(draws or SEARCH_DRAWS[kind])]


def random_search(df: DataFrame, key: Column, columns: list[str], target: str, kind: str, draws: int | None = None, seed: int = 42,
                  space: dict | None = None, folds: int = 5, accept_if_both_improve: bool = True, new_split: bool = False) -> DataFrame:
    """(draw, parameters, cv_r2, test_r2, accepted): seeded draws (``SEARCH_DRAWS`` unless given), scored by
    cross-validation.

    A draw is accepted when its CV score improves and, with ``accept_if_both_improve``, its test
    score too; the search ends at the stop scores. One split serves all draws unless asked."""
    drawn = draw(kind, draws, seed, space)
    if new_split:
        found = [score_draws(df, key, split_folds(key, folds, seed + i), columns, target, kind, [p], folds)[0] for i, p in enumerate(drawn)]
    else:
        found = score_draws(df, key, split_folds(key, folds, seed), columns, target, kind, drawn, folds)
    stop_cv, stop_test = STOP_AT.get(kind, (0.97, 0.98))
    best_cv = best_test = 0.0
    rows = []
    for i, (params, (cv, test_r2)) in enumerate(zip(drawn, found)):
        ok = cv > best_cv and (test_r2 > best_test or not accept_if_both_improve)
        if ok:
            best_cv, best_test = cv, test_r2
        rows.append((i, ", ".join(f"{k}={v}" for k, v in params.items()), cv, test_r2, ok))
        if best_cv >= stop_cv and best_test >= stop_test:
            break
    return df.sparkSession.createDataFrame(rows, "draw int, parameters string, cv_r2 double, test_r2 double, accepted boolean")


def randomized_search_cv(df: DataFrame, columns: list[str], target: str, key: Column, kind: str = "ridge", draws: int = 5,
                         folds: int = 5, seed: int = 42) -> DataFrame:
    """(draw, parameters, mean_r2): drawn parameters scored side by side on fixed folds; every fold is scaled by the others' moments."""
    drawn = draw(kind, draws, seed)
    found = score_draws(df, key, fold_of(key, folds), columns, target, kind, drawn, folds)
    out = [(i, ", ".join(f"{k}={v}" for k, v in d.items() if k != "degree"), cv) for i, (d, (cv, _)) in enumerate(zip(drawn, found))]
    return df.sparkSession.createDataFrame(out, "draw int, parameters string, mean_r2 double")


def linear_svr(train: DataFrame, columns: list[str], target: str, epsilon: float = 0.1, c: float = 1.0, tolerance: float = 1e-3,
               most: int = 1000) -> dict:
    """Epsilon-insensitive linear fit on standardized columns by averaged subgradient steps; each
    pass is one aggregate whose result has one number per weight.

    Ends when three passes in a row move the averaged weights by less than ``tolerance`` of their
    length; ``most`` passes without that are an error."""
    x_stats, (ym, ys) = moments(train, columns), moments(train, [target])[target]
    z = standardize(train, x_stats, "_z_").withColumn("_y", (F.col(target) - ym) / ys)
    names = [f"_z_{n}" for n in columns]
    data = z.select("_y", *names).persist()
    try:
        n = data.count()
        v, mean, calm = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0
        for i in range(most):
            e = F.col("_y") - reduce(lambda a, k: a + float(v[k]) * F.col(names[k]), range(len(names)), F.lit(float(v[-1])))
            side = F.when(e > epsilon, 1.0).when(e < -epsilon, -1.0).otherwise(0.0)
            g = data.select(side.alias("_s"), *names).agg(*[F.sum(F.col("_s") * F.col(k)) for k in names], F.sum("_s")).first()
            grad = np.append(v[:-1] / (c * n), 0.0) - np.array(g, dtype=float) / n
            v = v - 0.5 / (1 + i) ** 0.5 * grad
            moved = 4 / (i + 4) * (v - mean)  # later passes weigh more
            mean = mean + moved
            calm = calm + 1 if np.linalg.norm(moved) <= tolerance * max(np.linalg.norm(mean), 1e-9) else 0
            if calm == 3:
                return {"weights": mean[:-1], "intercept": mean[-1], "x": x_stats, "y": (ym, ys)}
    finally:
        data.unpersist()
    raise RuntimeError(f"no settled weights after {most} passes")


def svr_predict(model: dict, df: DataFrame) -> DataFrame:
    ym, ys = model["y"]
    z = F.lit(float(model["intercept"]))
    for (c, (m, s)), w in zip(model["x"].items(), model["weights"]):
        z = z + float(w) * (F.col(c) - m) / s
    return df.withColumn("prediction", z * ys + ym)
