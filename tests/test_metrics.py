import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import distributions as D
from terrafold.operators import metrics as M


def frame(spark, z, y):
    return spark.createDataFrame([(m, i, float(s), int(y[i])) for m, row in enumerate(z) for i, s in enumerate(row)], "model int, pid int, s double, y int")


def test_accuracy_and_f1(spark):
    z, y = [[1, 1, 0, 1], [0, 1, 1, 1]], [1, 1, 0, 0]
    got = M.pooled(frame(spark, z, y), ["model"]).orderBy("model").collect()
    assert [r["acc"] for r in got] == [0.75, 0.75]
    assert got[0]["f1"] == pytest.approx(0.8) and got[1]["f1"] == pytest.approx(2 / 3)


def test_ties_at_a_half_are_the_negative_class(spark):
    df = frame(spark, [[0.5, 0.5, 0.7, 0.3]], [0, 1, 1, 0])
    assert [r[0] for r in df.orderBy("pid").select(M.correct(F.col("s"), F.col("y"))).collect()] == [True, False, True, False]


def test_auroc_with_ties_and_missing_class(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.3, 1)], "g string, p double, y int")
    assert dict((r["g"], r["auc"]) for r in M.auroc(df, ["g"]).collect()) == {"a": 0.875, "b": None}


def test_simpson(spark):
    rows = []
    for tile, half, n, ok in (("A", "id", 10, 10), ("A", "ood", 30, 30), ("F", "id", 30, 15), ("F", "ood", 10, 5)):
        rows += [(tile, half, 0, 0.9 if i % n < ok and (ok == n or i % 4 < 2) else 0.1, i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "tile string, half string, model int, s double, y int").withColumn("p", M.probability(F.col("s"), F.col("y")))
    pooled = {r["half"]: r["acc"] for r in M.pooled(df, ["half"]).collect()}
    assert abs(pooled["id"] - pooled["ood"]) > 0.1
    assert all(abs(r["acc_delta"]) < 0.06 for r in M.tile_delta(M.per_tile(df)).collect())


def test_one_class_tile(spark):
    rows = [(t, h, 0, 0.9, (i % 2) if not (t == "B" and h == "ood") else 1) for t in "AB" for h in ("id", "ood") for i in range(4)]
    df = spark.createDataFrame(rows, "tile string, half string, model int, s double, y int").withColumn("p", M.probability(F.col("s"), F.col("y")))
    got = M.per_tile(df).agg(F.count("acc_delta"), F.count("f1_delta"), F.count("auc_delta")).first()
    assert tuple(got) == (2, 2, 1)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r["k"]: round(r["p_holm"], 9) for r in M.holm(df, "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_fisher(spark):
    low, high = D.fisher_interval(F.lit(0.5), F.lit(58))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert r["a"] == pytest.approx(math.tanh(math.atanh(0.5) - 1.959963984540054 / math.sqrt(55)))
    assert r["b"] == pytest.approx(math.tanh(math.atanh(0.5) + 1.959963984540054 / math.sqrt(55)))
    low, _ = D.fisher_interval(F.lit(0.5), F.lit(3))
    assert spark.range(1).select(low).first()[0] is None


def test_probit(spark):
    from statistics import NormalDist

    ps = [1e-9, 1e-6, 1e-4, 0.02, 0.3, 0.5, 0.74, 0.99, 1 - 1e-6, 1.0]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(D.probit(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(min(max(p, 1e-6), 1 - 1e-6)) for p in ps], abs=1e-12)


def test_t_and_wilcoxon():
    assert D.t_quantile(0.975, 4) == pytest.approx(2.7764451051978, abs=1e-9)
    assert D.t_quantile(0.975, 30) == pytest.approx(2.0422724563012, abs=1e-9)
    assert D.wilcoxon([(i, True) for i in (1.0, 2.0, 3.0, 4.0, 5.0)]) == pytest.approx(2 / 32)
    assert D.wilcoxon([(1.0, True), (2.0, False)]) == 1.0
    assert 0 < D.wilcoxon([(float(i), i % 3 > 0) for i in range(1, 80)]) < 0.05


def test_epsilon_correlation(spark):
    x = np.arange(5.0)
    df = spark.createDataFrame([(float(a), float(2 * a)) for a in x], "a double, b double")
    want = np.mean((x - 2) * (2 * x - 4)) / math.sqrt((x.var() + 1e-6) * (4 * x.var() + 1e-6))
    assert M.epsilon_correlation(df, [], "a", "b").first()["r"] == pytest.approx(want)


def test_curves_are_compared_where_both_reach(spark):
    rng = np.random.default_rng(4)
    for k in range(3):
        a, b = np.sort(rng.choice(900, 8, False)) / 1000, np.sort(rng.choice(900, 5, False) + 50) / 1000
        u, v = rng.random(8), rng.random(5)
        grid = np.linspace(max(a[0], b[0]), min(a[-1], b[-1]), 101)
        d = np.interp(grid, a, u) - np.interp(grid, b, v)
        rows = [("p", float(x), float(y)) for x, y in zip(a, u)] + [("q", float(x), float(y)) for x, y in zip(b, v)] + [("p", None, 1.0), ("q", 0.5, None)]
        got = M.matched(spark.createDataFrame(rows, "s string, x double, y double"), "s", "x", "y", "p", "q").first()
        assert np.allclose([got["mean"], got["least"], got["greatest"], got["share"]], [d.mean(), d.min(), d.max(), (d < 0).mean()])
        assert got["stronger"] == ("p" if (d < 0).mean() >= 0.8 else "q" if (d < 0).mean() <= 0.2 else None)
    apart = spark.createDataFrame([("p", 0.1, 1.0), ("p", 0.2, 1.0), ("q", 0.3, 1.0), ("q", 0.4, 1.0)], "s string, x double, y double")
    assert M.matched(apart, "s", "x", "y", "p", "q").first()["mean"] is None
    assert M.matched(apart.limit(0), "s", "x", "y", "p", "q").first()["stronger"] is None


def test_repeated_and_degenerate_models(spark):
    bits = {1: "0110", 2: "0110", 3: "1111", 4: "1111", 5: "0111", 6: "0110"}
    rows = [("id" if i < 2 else "ood", m, i, 0.9 if c == "1" else 0.1, 1) for m, b in bits.items() for i, c in enumerate(b)]
    got = {r["model"]: (r["degenerate"], r["duplicate_of"]) for r in M.states(spark.createDataFrame(rows, "half string, model int, pid long, s double, y int"), "pid").collect()}
    assert got == {1: (False, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (False, None), 6: (False, 1)}
