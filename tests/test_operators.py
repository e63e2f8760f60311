import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.operators import cleaning, describe, econometrics, explain, knn, kriging, modelling, panel, raster, scale, smoothing, spatial


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_deflate(spark):
    out = cleaning.deflate(spark.createDataFrame([(103.80,)], "a double"), {"a": "average"})
    assert out.first()[0] == pytest.approx(100.0)


def test_complete_months(spark):
    df = spark.createDataFrame([("a", 2, 3.0), ("a", 2, 5.0)], "city string, month int, v double")
    total = dict(r[1:] for r in rows(panel.complete_months(df, ["city"], "month", "v", "sum")))
    middle = dict(r[1:] for r in rows(panel.complete_months(df, ["city"], "month", "v", "median")))
    assert len(total) == len(middle) == 12
    assert total[2] == 8.0 and total[1] == 0.0 and middle[2] == 4.0 and middle[1] is None


def test_monthly_median(spark):
    df = spark.createDataFrame([("2018-02-%02d" % (i + 1), float(v)) for i, v in enumerate([1, 2, 2, 3, 4, 10])], "d string, v double")
    out = panel.resample_monthly_median(df.withColumn("d", F.to_date("d")), "d", "v").first()
    assert (str(out[0]), out[1], out[2], out[3]) == ("2018-02-28", 2018, 2, 2.5)


@pytest.mark.parametrize("n", [1, 2, 5, 30_000])
def test_exact_quantiles_against_numpy(spark, n):
    v = np.random.RandomState(n).lognormal(0, 3, n)
    v[: n // 3] = v[0]
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("one", 7.0), ("one", None)], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.92, 1.0]
    out = {r[0]: r[1:] for r in rows(scale.exact_quantiles(df, ["k"], "v", probs, list("abcde")))}
    assert np.allclose(out["hot"], np.quantile(v, probs), rtol=1e-12) and out["one"] == (7.0,) * 5


def test_dense_index_is_a_bijection_for_any_partitioning(spark):
    df = spark.range(1000).withColumn("b", F.col("id") % 7)
    got = []
    for parts in (1, 2, 8):
        out = scale.dense_index(df.repartition(parts), [F.col("b"), F.col("id")])
        got.append(rows(out.select("id", "idx"), "id"))
        assert sorted(i for _, i in got[-1]) == list(range(1000))
    assert got[0] == got[1] == got[2]


def test_pooled_lags_cross_borders(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 30.0)], "c string, m int, v double")
    out = panel.pooled_lag_features(df, [F.col("c"), F.col("m")], {"l1": ("v", 1)})
    assert rows(out.select("v", "l1"), "v") == [(20.0, 10.0), (30.0, 20.0)]


def test_seasonal_pattern_sums_to_one_and_spreads_the_total(spark):
    df = spark.createDataFrame([(1, m, float(m)) for m in range(1, 13)], "s int, month int, v double")
    pat = smoothing.seasonal_pattern(df, ["s"], "month", "v")
    assert pat.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    flat = spark.createDataFrame([(1, m, 1 / 12) for m in range(1, 13)], "s int, month int, weight double")
    out = panel.spread_over_months(spark.createDataFrame([(1, 120.0)], "s int, gdp double"), flat, ["s"], ["gdp"])
    assert [round(r["gdp"], 9) for r in out.collect()] == [10.0] * 12


def test_weighted_distance(spark):
    c = spark.createDataFrame([("a", 0.0, 0.0)], "city string, x double, y double")
    p = spark.createDataFrame([(1, 10000.0, 0.0, 100.0), (2, 0.0, 40000.0, 300.0)], "pid int, x double, y double, w double")
    assert spatial.weighted_mean_distance(c, p, "city", "pid", "w").first()[1] == pytest.approx(32.5)


def test_access_importance(spark):
    p = spark.createDataFrame([("A", 50.0), ("A", 50.0), ("B", 300.0)], "d string, n double")
    out = {r["d"]: round(r["access_importance"], 9) for r in spatial.access_importance(p, "d", "n").collect()}
    assert out == {"A": 0.3, "B": 0.7}


def ring(poly, pts):
    return [(poly, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]


SEG = "poly string, x1 double, y1 double, x2 double, y2 double"


def brute_inside(px, py, segs):
    hits = sum((y1 > py) != (y2 > py) and px < x1 + (py - y1) / (y2 - y1) * (x2 - x1) for _, x1, y1, x2, y2 in segs)
    return hits % 2 == 1


def brute_seg(px, py, x1, y1, x2, y2):
    sq = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / sq)) if sq else 0.0
    return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))


def test_nearest_polygon_against_all_pairs(spark):
    rng = np.random.RandomState(3)
    segs = ring("hole", [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]) + ring("hole", [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)])
    segs += ring("two", [(20.0, 20.0), (21.0, 20.0), (21.0, 22.0)]) + ring("two", [(40.0, 1.0), (44.0, 1.0), (44.0, 2.0)])
    for i in range(12):
        x, y = rng.uniform(-50, 90, 2)
        segs += ring(f"p{i}", [(float(x + dx), float(y + dy)) for dx, dy in ((0, 0), (1.5, 0.2), (1.0, 2.0))])
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-60, 100, (150, 2)))] + [(900, 3.0, 3.0), (901, 1.0, 1.0)]
    got = spatial.nearest_polygon(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(segs, SEG), "id", "poly", 1.0)
    got = {r["id"]: (r["poly"], r["distance"]) for r in got.collect()}
    polys = sorted({s[0] for s in segs})
    for i, x, y in pts:
        best = min(((0.0 if brute_inside(x, y, own := [s for s in segs if s[0] == p]) else min(brute_seg(x, y, *s[1:]) for s in own)), p) for p in polys)
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0], abs=1e-9)
    assert got[900][1] == pytest.approx(1.0) and got[901] == ("hole", 0.0)


def test_roads_within(spark):
    city = ring("c", [(0.0, 0.0), (50000.0, 0.0), (50000.0, 50000.0), (0.0, 50000.0)]) + ring("far", [(9e6, 9e6), (9.1e6, 9e6), (9.1e6, 9.1e6)])
    road = [(1, 59900.0, 0.0, 59900.0, 900.0), (2, 60100.0, 0.0, 60100.0, 900.0), (3, -1e6, 100.0, 1e6, 100.0), (4, 25000.0, 25000.0, 25010.0, 25000.0)]
    out = spatial.roads_within(spark.createDataFrame(city, SEG), spark.createDataFrame(road, "r int, x1 double, y1 double, x2 double, y2 double"), "poly", "r", 10000.0, 20000.0)
    assert rows(out, "poly") == [("c", 3), ("far", 0)]


def test_nearest_k_against_all_pairs(spark):
    rng = np.random.RandomState(5)
    d = [(g, i, float(x), float(y)) for g in ("a", "b") for i, (x, y) in enumerate(np.vstack([rng.uniform(0, 1000, (60, 2)), rng.normal(500, 1, (40, 2))]))]
    t = [(g, 1000 + i, float(x), float(y)) for g in ("a", "b") for i, (x, y) in enumerate(rng.uniform(-500, 1500, (25, 2)))]
    S = "g string, id int, x double, y double"
    out = spatial.nearest_k(spark.createDataFrame(t, S).withColumnRenamed("id", "t"), spark.createDataFrame(d, S), ["g"], "t", "id", 7, 10.0, [])
    got = {}
    for r in out.collect():
        got.setdefault((r["g"], r["t"]), []).append((r["rank"], r["id"]))
    for g, i, x, y in t:
        want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for gg, j, a, b in d if gg == g)[:7]
        assert [j for _, j in sorted(got[(g, i)])] == [j for _, j in want]


def test_kriging_invariants(spark):
    rng = np.random.RandomState(1)
    pts = [("g", i, float(x), float(y), float(x / 1e5 + rng.normal())) for i, (x, y) in enumerate(rng.uniform(0, 1e6, (40, 2)))]
    obs = spark.createDataFrame(pts, "g string, id int, x double, y double, v double")
    model = kriging.spherical_fit(kriging.empirical_variogram(obs, ["g"], "id", "v"), ["g"])
    at = kriging.krige(obs, obs.withColumnRenamed("id", "t"), model, ["g"], "t", "v")
    want = {p[1]: p[4] for p in pts}
    for r in at.collect():
        assert r["estimate"] == pytest.approx(want[r["t"]], abs=1e-6)
    flat = obs.withColumn("v", F.when(F.col("id") > 4, F.lit(3.5)))
    full = kriging.fill_by_kriging(flat, ["g"], "id", "v")
    assert {round(r["v"], 6) for r in full.collect()} == {3.5} and full.count() == 40


def test_filled_rows_do_not_recompute_their_input(spark):
    """What is filled is read many times: it is worked out once and written."""
    rows = spark.createDataFrame([(1, i, float(i % 4), float(i // 4), None if i == 5 else float(i)) for i in range(12)], "g int, id int, x double, y double, v double")
    out = kriging.fill_by_kriging(rows, ["g"], "id", "v")
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("v is null").count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_variogram_meets_places_not_rows(spark, monkeypatch, block):
    """Sums over all pairs of rows; 60 rows at 7 places are packed as 7."""
    monkeypatch.setattr(scale, "BLOCK_ROWS", block)
    packed, pair_blocks = [], kriging._pair_blocks

    def counted(blocks, group):
        packed.append(blocks.agg(F.sum(F.size("items"))).first()[0])
        return pair_blocks(blocks, group)

    monkeypatch.setattr(kriging, "_pair_blocks", counted)
    rng = np.random.RandomState(5)
    at = rng.uniform(0, 100, (7, 2))
    data = [("g", i, *map(float, at[i % 7]), float(rng.normal(50, 3))) for i in range(60)]
    obs = spark.createDataFrame([*data, ("g", 60, 1.0, 1.0, None), ("one", 0, 1.0, 1.0, 4.0)], "g string, id int, x double, y double, v double")
    got = {r["lag"]: (r["n_pairs"], r["distance"], r["semivariance"]) for r in kriging.empirical_variogram(obs, ["g"], "id", "v").collect()}
    p = [(math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), (a[4] - b[4]) ** 2 / 2) for i, a in enumerate(data) for b in data[:i]]
    step, want = max(d for d, _ in p) / 6, {}
    for d, g in p:
        want.setdefault(min(5, int(d / step)), []).append((d, g))
    assert packed == [8] and got.keys() == want.keys()
    for lag, found in want.items():
        assert got[lag] == (len(found), pytest.approx(np.mean([d for d, _ in found])), pytest.approx(np.mean([g for _, g in found])))


def test_kriging_targets_at_one_place_are_worked_out_once(spark, monkeypatch):
    asked, products = [], kriging._near
    monkeypatch.setattr(kriging, "_near", lambda a, b, *c: asked.append(a.agg(F.sum(F.size("x"))).first()[0]) or products(a, b, *c))
    obs = spark.createDataFrame([("g", float(i), float(i * i), float(i % 3)) for i in range(9)], "g string, x double, y double, v double")
    t = spark.createDataFrame([("g", i, float(i % 2), 0.5) for i in range(50)], "g string, t int, x double, y double")
    m = spark.createDataFrame([("g", 2.0, 30.0, 0.5)], "g string, psill double, range double, nugget double")
    got = {r["t"]: r["estimate"] for r in kriging.krige(obs, t, m, ["g"], "t", "v").collect()}
    assert asked == [9, 2] and len(got) == 50 and len(set(got.values())) == 2


@pytest.mark.parametrize("n, rows", [(12, 512), (10, 6)])
def test_kriging_against_dense_solve(spark, monkeypatch, n, rows):
    """All stations count, in one block or in many; two stations at one place count by their mean."""
    monkeypatch.setattr(kriging, "BLOCK_POINTS", rows)
    rng = np.random.RandomState(2)
    p = rng.uniform(0, 1000, (n, 2)); v = rng.normal(size=n)
    data = [("g", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(p, v))]
    data = [*data[:-1], (*data[-1][:4], data[-1][4] - 1), (*data[-1][:4], data[-1][4] + 1), ("g", -1, 5.0, 5.0, None), ("one", 0, 3.0, 3.0, 7.5)]
    obs = spark.createDataFrame(data, "g string, id int, x double, y double, v double")
    t = spark.createDataFrame([("g", 0, 321.0, 123.0), ("one", 1, 9.0, 9.0), ("none", 2, 0.0, 0.0)], "g string, t int, x double, y double")
    m = spark.createDataFrame([("g", 2.0, 600.0, 0.3)], "g string, psill double, range double, nugget double")
    got = {r["t"]: r["estimate"] for r in kriging.krige(obs, t, m, ["g"], "t", "v").collect()}
    gamma = lambda d: np.where(d == 0, 0, np.where(d <= 600, 0.3 + 2 * (1.5 * d / 600 - 0.5 * (d / 600) ** 3), 2.3))
    a = np.zeros((n + 1, n + 1)); a[:n, :n] = -gamma(np.linalg.norm(p[:, None] - p[None], axis=2)); a[n, :n] = a[:n, n] = 1
    b = np.append(-gamma(np.linalg.norm(p - [321.0, 123.0], axis=1)), 1)
    assert got == {0: pytest.approx(np.linalg.solve(a, b)[:n] @ v, abs=1e-7), 1: 7.5}


def test_kriging_leaves_out_block_pairs_beyond_the_range(spark, monkeypatch):
    """Stations in tiles of 16, some of them clustered: weights of a dense solve from a small share of the block pairs."""
    monkeypatch.setattr(kriging, "BLOCK_POINTS", 16)
    monkeypatch.setattr(kriging, "BLOCK_TARGETS", 8)
    listed, near = [], kriging._near

    def counted(asked, held, group, reach):
        out = near(asked, held, group, reach)
        listed.append((out.count(), asked.count() * held.count()))
        return out

    monkeypatch.setattr(kriging, "_near", counted)
    rng = np.random.RandomState(3)
    p = np.vstack([rng.uniform(0, 1000, (260, 2)), rng.uniform(500, 560, (40, 2))])
    v = rng.normal(size=len(p))
    obs = spark.createDataFrame([("g", float(a), float(b), float(c)) for (a, b), c in zip(p, v)], "g string, x double, y double, v double")
    m = spark.createDataFrame([("g", 2.0, 90.0, 0.5)], "g string, psill double, range double, nugget double")
    q = np.vstack([rng.uniform(0, 1000, (50, 2)), [[5000.0, 5000.0]]])
    t = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(q)], "g string, t int, x double, y double")
    got = {r["t"]: r["estimate"] for r in kriging.krige(obs, t, m, ["g"], "t", "v").collect()}

    def cov(d):
        return np.where(d <= 90, 2 * (1 - 1.5 * d / 90 + 0.5 * (d / 90) ** 3), 0) + np.where(d == 0, 0.5, 0)

    c = cov(np.linalg.norm(p[:, None] - p[None], axis=2))
    a, b = np.linalg.solve(c, np.column_stack([v, np.ones(len(v))])).T
    mu = a.sum() / b.sum()
    want = mu + cov(np.linalg.norm(q[:, None] - p[None], axis=2)) @ (a - mu * b)
    assert [got[i] for i in range(len(q))] == pytest.approx(want, abs=1e-6)
    assert listed[0][0] < 0.3 * listed[0][1] and listed[1][0] < listed[1][1]


def test_otsu_hand_case(spark):
    h = spark.createDataFrame([(1, 2018, i, n, float(i)) for i, n in enumerate([4, 1, 1, 4])], "city_id int, year int, bin int, n bigint, bin_mean double")
    assert raster.otsu_threshold(h).first()["threshold"] == 1.0
    single = spark.createDataFrame([(1, 2018, 3, 9, 0.5)], h.schema)
    assert raster.otsu_threshold(single).first()["threshold"] is None


def test_indices_hand_case(spark):
    c = spark.createDataFrame([(1, 2018, 0, 0, 0.05, 0.1, 0.1, 0.5, 0.2, 0.2)], "city_id int, year int, px int, py int, b2 double, b3 double, b4 double, b8 double, b11 double, b12 double")
    r = raster.spectral_indices(c).first()
    assert r["ndvi"] == pytest.approx(0.6667, abs=1e-4) and r["evi"] == pytest.approx(0.5797, abs=1e-4)


def test_areas(spark):
    f = spark.range(10_000).select(F.lit(1).alias("city_id"), F.lit(2018).alias("year"), F.lit(True).alias("urban"), F.lit(False).alias("green"), F.lit(None).cast("boolean").alias("water"))
    assert tuple(raster.areas_km2(f).first())[2:] == (1.0, 0.0, 0.0)


def test_minmax_constant_is_zero(spark):
    out = spatial.minmax(spark.createDataFrame([(5.0,), (5.0,)], "v double"), {"z": "v"})
    assert [r["z"] for r in out.collect()] == [0.0, 0.0]


@pytest.mark.parametrize("metric", ["manhattan", "euclidean"])
def test_nearest_rows_against_all_pairs(spark, metric):
    rng = np.random.RandomState(0)
    d = rng.normal(size=(300, 5)); d[:100] = d[0]
    q = np.vstack([rng.normal(size=(40, 5)) * 3, d[:1]])
    donors = spark.createDataFrame([(i, [float(x) for x in f], float(i)) for i, f in enumerate(d)], "d bigint, f array<double>, y double")
    queries = spark.createDataFrame([(i, [float(x) for x in f]) for i, f in enumerate(q)], "q bigint, f array<double>")
    got = {}
    for r in knn.nearest_rows(queries, donors, 4, metric).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["d"]))
    for i, f in enumerate(q):
        dist = np.abs(d - f).sum(1) if metric == "manhattan" else np.sqrt(((d - f) ** 2).sum(1))
        assert [x for _, x in sorted(got[i])] == list(np.lexsort((np.arange(300), dist))[:4])


def test_nearest_rows_writes_no_row_per_cell(spark):
    """In many dimensions no cell can be ruled out; what is written still follows the rows, not rows times cells."""
    rng = np.random.RandomState(1)
    d, q = rng.normal(size=(2500, 32)), rng.normal(size=(600, 32))
    donors = spark.createDataFrame([(i, [float(x) for x in f], float(i)) for i, f in enumerate(d)], "d bigint, f array<double>, y double")
    queries = spark.createDataFrame([(i, [float(x) for x in f]) for i, f in enumerate(q)], "q bigint, f array<double>")
    before = len(scale.WRITTEN)
    got = {(r["q"], r["rank"]): r["d"] for r in knn.nearest_rows(queries, donors, 3).collect()}
    for i in range(0, 600, 7):
        assert [got[i, r] for r in (1, 2, 3)] == list(np.argsort(np.abs(d - q[i]).sum(1), kind="stable")[:3])
    written = sum(spark.read.parquet(p).count() for p in scale.WRITTEN[before:])
    assert written < 4 * (len(d) + len(q))


def test_exact_match_wins(spark):
    donors = spark.createDataFrame([(1, [0.0], 5.0), (2, [1.0], 9.0)], "d bigint, f array<double>, y double")
    q = spark.createDataFrame([(7, [0.0])], "q bigint, f array<double>")
    assert knn.knn_regress(q, donors, 2).first()["prediction"] == 5.0


def test_impute_uses_what_there_is(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", 1.0, 10.0), (3, "b", 2.0, 20.0), (4, "b", None, None)], "k bigint, city string, u double, v double")
    out = {r["k"]: r["v"] for r in knn.knn_impute(df, "k", "city", ["city"], ["u", "v"], ["v"]).collect()}
    assert out == {1: 15.0, 2: 10.0, 3: 20.0, 4: 15.0}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    r = modelling.regression_metrics(df, "y", "p").first()
    assert [round(x, 4) for x in r] == [0.5, 0.3333, 0.3333, 0.5774]


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.RandomState(9)
    x = rng.normal(size=(400, 3))
    y = 2 + x @ [1.5, -2.0, 0.0] + rng.normal(scale=0.1, size=400)
    return spark.createDataFrame([(i, i % 20, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k bigint, city bigint, a double, b double, c double, y double").cache()


def test_split_does_not_depend_on_partitions(linear):
    one = rows(modelling.train_test_split(linear.repartition(1), F.col("k"))[1].select("k"), "k")
    assert one == rows(modelling.train_test_split(linear.repartition(8), F.col("k"))[1].select("k"), "k") and 40 < len(one) < 120


@pytest.mark.parametrize("kind,degree", [("linear", 1), ("ridge", 1), ("polynomial", 2), ("decision_tree", 1)])
def test_models_beat_the_mean(linear, kind, degree):
    train, test = modelling.train_test_split(linear, F.col("k"))
    m = modelling.fit(train, ["a", "b", "c"], "y", kind, degree)
    assert modelling.regression_metrics(m.predict(test), "y", "prediction").first()["r2"] > 0.7


def test_svr(linear):
    m = modelling.linear_svr(linear, ["a", "b", "c"], "y", epsilon=0.01)
    assert modelling.regression_metrics(modelling.svr_predict(m, linear), "y", "prediction").first()["r2"] > 0.9


def test_ols_against_numpy(linear):
    p = linear.toPandas()
    x = np.column_stack([np.ones(len(p)), p[["a", "b", "c"]]])
    beta, *_ = np.linalg.lstsq(x, p["y"], rcond=None)
    e = p["y"] - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(p) - 4))
    m = econometrics.OLS(linear, "y", ["a", "b", "c"])
    assert np.allclose(m.coef, beta) and np.allclose(m.se, se)
    s = m.summary([F.col("k")]).first()
    assert s["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    assert s["kurtosis"] == pytest.approx(((e - e.mean()) ** 4).mean() / e.var(ddof=0) ** 2)


def test_durbin_watson_hand_case(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, -1, 1, -1])], "k int, e double")
    assert econometrics.durbin_watson(df, "e", [F.col("k")]).first()[0] == 3.0


def test_t_probability():
    assert econometrics.t_two_sided(0.0, 10) == pytest.approx(1.0)
    assert econometrics.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert econometrics.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-10)


def test_random_effects_recovers_slopes(spark):
    rng = np.random.RandomState(4)
    data = [(c, t, float(x), float(1 + 2 * x + u + rng.normal(scale=0.3))) for c, u in enumerate(rng.normal(scale=2, size=30)) for t, x in enumerate(rng.normal(size=12))]
    r = econometrics.random_effects(spark.createDataFrame(data, "c int, t int, x double, y double"), "c", "y", ["x"])
    assert r["coef"][r["terms"].index("x")] == pytest.approx(2.0, abs=0.1) and r["sigma2_e"] == pytest.approx(0.09, abs=0.02)
    assert 2 < r["sigma2_u"] < 8 and r["r2_within"] > 0.9


def test_random_effects_equal_a_plain_fit(spark):
    """Unequal entities, one of a single row, a null and a regressor that is constant in some; rows are transformed one by one here."""
    rng = np.random.RandomState(9)
    data = [(c, float(a), float(b), float(3 + 2 * a - b + u + rng.normal(scale=0.5))) for c, u in enumerate(rng.normal(scale=1.5, size=12))
            for a, b in rng.normal(5, 2, (1 + c % 5 * 3, 2))]
    got = econometrics.random_effects(spark.createDataFrame([*data, (0, None, 1.0, 9.0)], "c int, a double, b double, y double"), "c", "y", ["a", "b"])
    c = np.array([r[0] for r in data])
    v = np.array([r[1:] for r in data])
    t = np.array([np.sum(c == i) for i in range(12)])
    m = np.array([v[c == i].mean(0) for i in range(12)])
    w = v - m[c]
    n, k = len(v), 2
    slope = np.linalg.lstsq(w[:, :2], w[:, 2], rcond=None)[0]
    s2e = np.sum((w[:, 2] - w[:, :2] @ slope) ** 2) / (n - 12 - k)
    mx = np.column_stack([np.ones(12), m[:, :2]])
    sse_b = np.sum((m[:, 2] - mx @ np.linalg.lstsq(mx, m[:, 2], rcond=None)[0]) ** 2)
    s2u = max(0.0, sse_b / (12 - k - 1) - s2e * np.mean(1 / t))
    theta = 1 - np.sqrt(s2e / (t * s2u + s2e))
    q = np.column_stack([1 - theta[c], v - theta[c][:, None] * m[c]])
    beta = np.linalg.lstsq(q[:, :3], q[:, 3], rcond=None)[0]
    res = q[:, 3] - q[:, :3] @ beta
    se = np.sqrt(np.diag(np.linalg.inv(q[:, :3].T @ q[:, :3])) * (res @ res) / (n - k - 1))
    assert got["terms"] == ["const", "a", "b"] and got["coef"] == pytest.approx(beta) and got["se"] == pytest.approx(se)
    assert (got["sigma2_e"], got["sigma2_u"]) == (pytest.approx(s2e), pytest.approx(s2u))
    e = v[:, 2] - beta[0] - v[:, :2] @ beta[1:]
    eb = m[:, 2] - mx @ beta
    ew = w[:, 2] - w[:, :2] @ beta[1:]
    assert got["r2_overall"] == pytest.approx(1 - e @ e / np.sum((v[:, 2] - v[:, 2].mean()) ** 2))
    assert got["r2_between"] == pytest.approx(1 - eb @ eb / np.sum((m[:, 2] - m[:, 2].mean()) ** 2))
    assert got["r2_within"] == pytest.approx(1 - ew @ ew / np.sum(w[:, 2] ** 2))


def test_partial_dependence_is_the_analytic_line(linear):
    pred = lambda df: df.withColumn("prediction", 1 + 3 * F.col("a") - F.col("b"))
    out = rows(explain.partial_dependence(linear, ["a", "b"], {"a": (0.0, 2.0, 3)}, pred), "value")
    mean_b = linear.agg(F.avg("b")).first()[0]
    assert [round(v, 9) for _, _, v in out] == [round(1 + 3 * g - mean_b, 9) for g in (0, 1, 2)]


def test_permutation_importance_ranks_features(linear):
    pred = lambda df: df.withColumn("prediction", 2 + 1.5 * F.col("a") - 2 * F.col("b"))
    box = {r["feature"]: r["median"] for r in explain.importance_boxes(explain.permutation_importance(linear, "k", ["a", "b", "c"], "y", pred, repeats=10)).collect()}
    assert box["b"] > box["a"] > 0.3 and abs(box["c"]) < 1e-9


def test_lime_signs(linear):
    pred = lambda df: df.withColumn("prediction", 5 * F.col("a"))
    top = linear.orderBy(F.desc("a")).limit(1)
    w = {r["feature"]: r["weight"] for r in explain.lime(top, "k", ["a", "b"], explain.quartile_bins(linear, ["a", "b"]), pred, samples=1000).collect()}
    assert w["a"] > 1 and abs(w["b"]) < 1


def test_box_and_histogram(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 100]], "k string, v double")
    b = describe.box_stats(df, ["k"], "v").first()
    assert (b["median"], b["high_whisker"], b["n_outliers"]) == (3.0, 4.0, 1)
    assert sum(n for _, n in rows(describe.histogram(df, "v", 50))) == 5


def test_affine_maps_are_permutations():
    for n in (1, 2, 12, 97):
        for a, b in explain.affine_shuffles(n, 20, 1):
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_kriging_in_one_task_is_kriging_by_jobs(spark, monkeypatch):
    """A group of bounded size takes its steps in one task, whatever it keeps of its covariances; larger ones take theirs as jobs."""
    monkeypatch.setattr(kriging, "BLOCK_POINTS", 8)
    rng = np.random.RandomState(8)
    p = rng.uniform(0, 100, (20, 2))
    data = [(g, float(a), float(b), float(rng.normal(5))) for g, n in (("far", 20), ("near", 12), ("flat", 3)) for a, b in p[:n]]
    points = spark.createDataFrame(data, "g string, x double, y double, v double")
    model = spark.createDataFrame([("far", 2.0, 30.0, 0.4), ("near", 2.0, 80.0, 0.0), ("flat", 0.0, 0.0, 0.0)], "g string, psill double, range double, nugget double")

    def weights():
        rows = kriging.dual_weights(points, model, ["g"]).collect()
        return {(r["g"], *at): (w, r["mu"]) for r in rows for *at, w in zip(r["x"], r["y"], r["w"])}

    steps, stepped = [], kriging._stepped_weights
    monkeypatch.setattr(kriging, "_stepped_weights", lambda packed, *a: steps.append({r["g"] for r in packed.select("g").distinct().collect()}) or stepped(packed, *a))
    local = weights()
    assert steps == [] and len(local) == 35
    monkeypatch.setattr(kriging, "KEPT_BYTES", 1000)
    monkeypatch.setattr(kriging, "LOCAL_POINTS", 15)
    some = weights()
    assert steps == [{"far"}] and some.keys() == local.keys()
    for k, found in local.items():
        assert some[k] == pytest.approx(found, abs=1e-7)
    assert [v for k, v in local.items() if k[0] == "flat"] == [(0.0, pytest.approx(np.mean([d[3] for d in data if d[0] == "flat"])))] * 3
