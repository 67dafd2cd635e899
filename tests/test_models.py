import numpy as np
import pytest

from terrafold import registry
from terrafold.operators import models as MO
from terrafold.operators import search as Q
from terrafold.runner import Runner, Stage


def test_grid_sizes():
    sizes = {k: int(np.prod([len(v) for v in axes.values()])) for k, axes in MO.GRIDS.items()}
    assert sizes == {"dt": 40, "et": 54, "hgb": 48, "lr": 50, "mlp": 45, "nb": 30, "rf": 54, "xgb": 48} and sum(sizes.values()) == 369


@pytest.mark.parametrize("kind", list(MO.GRIDS))
def test_every_family_learns(kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 4))
    x[rng.random(x.shape) < 0.03] = np.nan
    y = (np.nan_to_num(x[:, 0]) + 0.3 * rng.normal(size=1200) > 0).astype(float)
    setting = {n: v[-1] if n not in ("class_weight", "priors", "var_smoothing", "min_samples_leaf", "n_estimators", "max_iter") else v[min(1, len(v) - 1)] for n, v in MO.GRIDS[kind].items()}
    if kind == "lr":
        setting["max_iter"] = 100
    p = MO.fit_predict(kind, setting, 3, x[:800], y[:800], x[800:])
    assert ((p > 0.5) == (y[800:] == 1)).mean() > 0.8 and p.min() >= 0 and p.max() <= 1


def test_gradient_of_the_soft_correlation():
    rng = np.random.default_rng(2)
    z, w, t = (rng.random((20, 15)) < 0.6).astype(float), rng.random(15), rng.normal(size=20)
    r, g = Q.soft_correlation(z, w, t)
    for i in range(15):
        d = np.zeros(15)
        d[i] = 1e-6
        assert g[i] == pytest.approx((Q.soft_correlation(z, w + d, t)[0] - Q.soft_correlation(z, w - d, t)[0]) / 2e-6, abs=1e-6)
    assert Q.top(np.zeros(10), 3).tolist() == [1] * 3 + [0] * 7


def test_search_finds_points_against_skill(spark):
    rng = np.random.default_rng(3)
    skill = np.linspace(0.55, 0.95, 40)
    hit = (rng.random((40, 120)) < np.where(np.arange(120) < 30, 1.5 - skill[:, None], skill[:, None])).astype(int)
    correct = spark.createDataFrame([(m, p, int(hit[m, p])) for m in range(40) for p in range(120)], "model int, point long, hit int")
    acc = spark.createDataFrame([(m, float(skill[m])) for m in range(40)], "model int, acc double")
    from terrafold.operators.sampling import split

    got = Q.search(spark, [("oodselect_S20", "oodselect", 0.0, 20)], correct, acc, spark.createDataFrame([], "a long, b long"), split(40), trials=16, max_steps=300, patience=100).first()
    assert got["r_val"] < -0.3 and sum(p < 30 for p in got["points"]) >= 14


def test_plan():
    assert Q.unit_name("oodselect", 0, 500) == "oodselect_S500" and Q.unit_name("gtv", 0.01, 500) == "gtv_mu0.01_S500"
    assert len(Q.plan()) == 55


def test_stages_resume_and_name_what_is_missing(spark, tmp_path):
    ran = []

    def stage(name):
        return lambda s, t: (ran.append(name), s.range(3))[1]

    run = Runner(spark, f"file://{tmp_path}/r", [Stage("b", stage("b"), ("a",), 5), Stage("a", stage("a"), (), 3)])
    assert run.plan(workers=2) == {"stages": ["a", "b"], "seconds": 5}
    with pytest.raises(RuntimeError, match="needs the stage a"):
        run(only="b")
    assert run()["complete"] and run()["timings"] == {} and ran == ["a", "b"]
    run(only="b", force=True)
    assert ran == ["a", "b", "b"]


def test_every_query_has_a_name_once():
    found = registry.queries()
    assert len(found) > 120 and set(registry.oracle_sql()) <= set(found)


def test_registered_queries_cover_the_grid_and_the_plan(spark, monkeypatch):
    import inspect

    from terrafold.operators import models, search
    from terrafold.plans import population

    class Seen(Exception):
        pass

    seen = {}

    def caught(name, f):
        def run(*args, **kwargs):
            seen[name] = inspect.signature(f).bind(*args, **kwargs)
            seen[name].apply_defaults()
            raise Seen

        return run

    monkeypatch.setattr(models, "population", caught("population", models.population))
    monkeypatch.setattr(search, "search", caught("search", search.search))
    for query in (population.population, population.subset_search):
        with pytest.raises(Seen):
            query(spark, "/root/testdata/sf0.001")
    specs = next(v for k, v in seen["population"].arguments.items() if k in ("specs", "grid", "settings"))
    assert specs.count() == 369 and specs.select("grid_idx").distinct().count() == 369
    got = seen["search"].arguments
    assert got["units"] == search.plan() and len(got["units"]) == 55
    assert (got["trials"], got["max_steps"], got["patience"]) == (100, 50_000, 500)


def test_arrays_reach_the_driver_packed(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from terrafold.operators import storage

    def refused(self):
        raise AssertionError("rows as objects at the driver")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", refused)
    monkeypatch.setattr(DataFrame, "toPandas", refused)
    df = spark.createDataFrame([(i, None if i == 3 else i / 2) for i in range(1000)], "k long, v double").repartition(3)
    t = storage.arrays(df, {"k": "int64", "v": "float64"})
    assert sorted(t["k"].tolist()) == list(range(1000)) and np.isnan(t["v"]).sum() == 1 and np.nansum(t["v"]) == 999 * 500 / 2 - 1.5
    assert len(storage.arrays(df.limit(0), {"k": "int64"})["k"]) == 0
    pts = spark.createDataFrame([(i, float(i % 7), float(i), int(i % 7 > 3)) for i in range(200)], "pid long, f double, g double, label int")
    specs = MO.grid(spark).filter("kind = 'nb'").limit(2)
    assert MO.population(specs, pts, pts, ["f", "g"], "pid", least=50).count() == 400
    correct = spark.createDataFrame([(m, p, (m * p) % 3 % 2) for m in range(20) for p in range(30)], "model int, point long, hit int")
    acc = spark.createDataFrame([(m, 0.5 + m / 60) for m in range(20)], "model int, acc double")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(5, 77)], "a long, b long")
    parts = {"train": list(range(12)), "val": list(range(12, 16)), "test": list(range(16, 20))}
    got = Q.search(spark, [("laplacian_mu1_S5", "laplacian", 1.0, 5)], correct, acc, pairs, parts, trials=2, max_steps=5)
    assert len(got.first()["points"]) == 5


def test_population_scores_in_its_tasks(spark):
    from pyspark.sql import functions as F

    from terrafold.operators import metrics as M

    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(i, float(rng.normal()), float(i % 5), int(rng.random() < 0.4), i % 2 if i else 7) for i in range(300)], "pid long, f double, g double, label int, ood int")
    specs = MO.grid(spark).filter("grid_idx IN (0, 9, 60, 200, 260, 290)")
    got = MO.population(specs, pts, pts, ["f", "g"], "pid", least=50, by="ood")
    s = MO.population(specs, pts, pts, ["f", "g"], "pid", least=50).join(pts.select("pid", "ood", F.col("label").alias("y")), "pid").withColumn("s", M.true_class_score(F.col("p"), F.col("y")))
    by = ["grid_idx", "ood"]
    want = M.pooled(s, by).join(M.auroc(s, by), by).select(*by, "n", "n_correct", "tp", "fp", "auc")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2]) and got.count() == 18


def test_rates_of_missing_values_are_those_of_nulls(spark):
    from pyspark.sql import functions as F

    from terrafold.operators import metrics as M

    rows = [(None, 1), (0.5, 0), (0.5, 1), (0.75, None), (None, 0), (0.25, 1), (0.875, 1), (0.25, 0)]
    s = spark.createDataFrame(rows, "p double, y int").withColumns({"k": F.lit(1), "s": M.true_class_score(F.col("p"), F.col("y"))})
    want = M.pooled(s, ["k"]).join(M.auroc(s, ["k"]), "k").select("n", "n_correct", "tp", "fp", "auc").first()
    p, y = np.array(rows, float).T
    assert M.rates_of(p, y) == want.asDict() and np.isnan(M.rates_of(p[:1], y[:1])["auc"])


def test_the_population_query_sends_no_predictions_to_the_driver(spark):
    from terrafold.plans import population

    plan = population.population(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and not plan.partition("BroadcastExchange")[2].count("MapInPandas")


@pytest.mark.parametrize("points", [40, 900])
def test_neighbour_sums_are_those_of_all_pairs(points):
    rng = np.random.default_rng(6)
    pairs = np.unique(np.sort(rng.integers(1, points, (points * 9, 2)), 1), axis=0)
    pairs = np.concatenate((pairs[pairs[:, 0] < pairs[:, 1]], [(0, i) for i in range(1, points - 3)])).astype(np.int32)  # point 0 is a hub
    w = np.round(rng.random(points), 2)
    near, d = Q.Neighbours(pairs, points), w[pairs[:, 0]] - w[pairs[:, 1]]
    assert len(near.rest) and bool(near.rounds) == (points > Q.LEAST_ROUND)
    for got, each in ((near.gaps(w), d), (near.signs(w), np.sign(d))):
        want = np.bincount(pairs[:, 0], each, points) - np.bincount(pairs[:, 1], each, points)
        assert np.abs(got - want).max() < 1e-10
    assert (near.signs(w) == want).all()


def test_few_ones_multiply_as_the_matrix_does():
    rng = np.random.default_rng(7)
    z, w = (rng.random((12, 50)) < 0.1).astype(np.uint8), rng.random(50)
    z[3] = 0
    few = Q.compact(z)
    assert isinstance(few, Q.Ones) and isinstance(Q.compact(1 - z), np.ndarray)
    assert few @ w == pytest.approx(z @ w) and few.T @ w[:12] == pytest.approx(z.T @ w[:12])
    assert np.abs(Q.compact(z[:0]) @ w).sum() == 0
    target = rng.normal(size=12)
    (r, g), (r1, g1) = Q.soft_correlation(few, w, target), Q.soft_correlation(z.astype(float), w, target)
    assert r == pytest.approx(r1) and g == pytest.approx(g1)
