"""Shared learners against plain ones: many trees at a time, penalised models from sums, neighbours of all numbers."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.operators import forest, knn, penalised
from cityloom.operators import modelling as M

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def key(spark):
    return F.col("id")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(300):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(6)), rng.random()
        out.append((i, a, b, c, 3 * math.sin(a) + b * c + rng.gauss(0, 0.2)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5).cache()


HOWS = [forest.growth("decision_tree", depth=4, leaf=3, split=9), forest.growth("random_forest", depth=3, trees=3, leaf=2), forest.growth("gradient_boosting", depth=2, trees=3),
        forest.growth("boosted_trees", depth=3, trees=3, gamma=0.4), forest.growth("boosted_trees", depth=2, trees=2)]


def test_passes_over_the_table_give_the_local_trees(spark, df, key, monkeypatch):
    fold = M.split_folds(key, 3, 42)
    models = [replace(h, fold=f) for h in HOWS for f in (forest.ALL, 1)]
    local = forest.scores(df, key, fold, COLUMNS, "y", models)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 10)
    monkeypatch.setattr(forest, "WAVE", 11)
    monkeypatch.setattr(forest, "CELLS", 50 * 3 * 256)
    assert forest.scores(df, key, fold, COLUMNS, "y", models) == pytest.approx(local, abs=1e-9)
    how = HOWS[3]
    far = {r["id"]: r["prediction"] for r in forest.fit(df, COLUMNS, "y", how).predict(df).collect()}
    monkeypatch.undo()
    near = {r["id"]: r["prediction"] for r in forest.fit(df, COLUMNS, "y", how).predict(df).collect()}
    assert far == pytest.approx(near, abs=1e-9)


@pytest.mark.parametrize("kind", ["decision_tree", "gradient_boosting", "boosted_trees", "ridge", "lasso", "elastic_net", "knn"])
def test_search_is_the_fits_one_by_one(df, key, kind):
    space = {"decision_tree": {"depth": [2, 3, 7], "split": [2, 9], "leaf": [1, 4]}, "gradient_boosting": {"depth": [2, 3], "trees": [3, 8]},
             "boosted_trees": {"depth": [2, 4], "trees": [3, 6], "gamma": [0, 0.5]}, "knn": {"weights": ["uniform", "distance"], "metric": ["manhattan", "minkowski"], "k": [2, 5]},
             "ridge": {"alpha": [1, 50], "degree": [1, 2]}, "lasso": {"alpha": [0.01, 0.3]}, "elastic_net": {"alpha": [0.01, 0.3], "l1_ratio": [0.2, 0.9]}}[kind]
    got = M.random_search(df, key, COLUMNS, "y", kind, draws=4, space=space, folds=3).collect()
    best_cv = best_test = 0.0
    train, test = M.train_test_split(df, key, seed=42)
    for r, params in zip(got, M.draw(kind, 4, 42, space), strict=True):
        assert r["parameters"] == ", ".join(f"{k}={v}" for k, v in params.items())
        if kind != "knn":
            model = M.fit(train, COLUMNS, "y", kind, **params)
            assert M.regression_metrics(model.predict(test), "y", "prediction").first()["r2"] == pytest.approx(r["test_r2"], abs=1e-7)
            if kind in M.PENALISED:
                folds = M.kfold_scores(train, key, COLUMNS, "y", kind, folds=3, **params).agg(F.avg("r2")).first()[0]
                assert folds == pytest.approx(r["cv_r2"], abs=1e-7)
        assert r["accepted"] == (r["cv_r2"] > best_cv and r["test_r2"] > best_test)
        if r["accepted"]:
            best_cv, best_test = r["cv_r2"], r["test_r2"]


def test_search_stops_at_its_scores(df, key, monkeypatch):
    monkeypatch.setitem(M.STOP_AT, "ridge", (0.1, 0.1))
    assert M.random_search(df, key, COLUMNS, "y", "ridge", draws=6, folds=3).count() == 1
    assert M.random_search(df, key, COLUMNS, "y", "ridge", draws=3, folds=3, new_split=True, space={"alpha": [2], "degree": [1]}).count() <= 3


def test_a_tree_is_the_best_one(rows):
    """Depth 1 against all cuts; leaves of a penalised round against their closed form."""
    x = np.array([r[1:4] for r in rows])
    y = np.array([r[4] for r in rows])
    y = (y - y.mean()) / y.std()
    edges = [np.unique(v) for v in x.T]
    edges = [e if len(e) < 200 else np.unique(np.quantile(e, np.arange(1, 64) / 64)) for e in edges]
    bins = forest.binned(list(x.T), edges)
    for penalty in (0.0, 5.0):
        tree = forest.grow(bins, y, np.ones(len(y)), forest.Growth(depth=1, leaf=4, penalty=penalty))
        gains = {(f, c): sum(y[s].sum() ** 2 / (s.sum() + penalty) for s in (bins[:, f] <= c, bins[:, f] > c))
                 for f in range(3) for c in range(64) if min((bins[:, f] <= c).sum(), (bins[:, f] > c).sum()) >= 4}
        assert (tree.feature[0], tree.cut[0]) == max(gains, key=lambda k: (round(gains[k], 9), -k[0], -k[1]))
        low = bins[:, tree.feature[0]] <= tree.cut[0]
        assert tree.value[1:3] == pytest.approx([y[s].sum() / (s.sum() + penalty) for s in (low, ~low)])


def test_pruned_cuts_are_those_under_gamma(rows):
    x = np.array([r[1:4] for r in rows])
    y = np.array([r[4] for r in rows])
    bins = forest.binned(list(x.T), [np.unique(np.quantile(v, np.arange(1, 64) / 64)) for v in x.T])
    whole, cut = (forest.grow(bins, y - y.mean(), np.ones(len(y)), forest.Growth(depth=6, penalty=1.0, gamma=g)) for g in (0.0, 3.0))
    whole.prune(3.0)
    assert whole.value[whole.route(bins)] == pytest.approx(cut.value[cut.route(bins)])


@pytest.mark.parametrize(("kind", "p"), [("lasso", {"alpha": 0.05}), ("elastic_net", {"alpha": 0.1, "l1_ratio": 0.3}), ("ridge", {"alpha": 20})])
def test_penalised_models_meet_their_conditions(spark, rows, df, kind, p):
    """Gradients of the loss at the coefficients, on features scaled here."""
    model = penalised.fit(df, COLUMNS, "y", kind, raw=False, **p)
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    pred = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
    e = t - (np.array([pred[i] for i in range(len(y))]) - y.mean()) / y.std()
    b = np.linalg.lstsq(z, t - e, rcond=None)[0]
    slope = z.T @ e / len(y)
    if kind == "ridge":
        assert slope == pytest.approx(p["alpha"] / len(y) * b, abs=1e-10)
    else:
        l1, l2 = p["alpha"] * p.get("l1_ratio", 1), p["alpha"] * (1 - p.get("l1_ratio", 1))
        on = np.abs(b) > 1e-9
        assert slope[on] == pytest.approx((l1 * np.sign(b) + l2 * b)[on], abs=1e-9) and (np.abs(slope[~on]) <= l1 + 1e-9).all()


def test_neighbours_of_all_numbers(df, key, rows):
    fold = M.split_folds(key, 2, 42)
    of = {r["id"]: r["f"] for r in df.select("id", fold.alias("f")).collect()}
    board = knn.neighbour_scores(df, key, fold, COLUMNS, "y", 4, 2)
    f = np.array([of[r[0]] for r in rows])
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    for want in (-2, 0, 1):
        d, q = np.flatnonzero((f >= 0) & (f != want)), np.flatnonzero(f == want)
        both = np.concatenate([(x - x[d].mean(0)) / x[d].std(0), x], 1)
        for metric in ("euclidean", "manhattan"):
            gap = both[q, None] - both[None, d]
            dist = np.sqrt((gap ** 2).sum(2)) if metric == "euclidean" else np.abs(gap).sum(2)
            near = np.argsort(dist, 1, kind="stable")
            for k in (1, 2, 4):
                ys, ds = y[d][near[:, :k]], np.take_along_axis(dist, near[:, :k], 1)
                for name, pred in (("uniform", ys.mean(1)), ("distance", (ys / ds).sum(1) / (1 / ds).sum(1))):
                    assert board[metric, name, k, want] == pytest.approx(1 - ((y[q] - pred) ** 2).mean() / y[q].var(), abs=1e-9)
