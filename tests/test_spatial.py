import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import scalar as S
from terrafold.operators import graph as K
from terrafold.operators import blocks, hulls, matching, relational, sampling
from terrafold.operators import spatial as SP
from terrafold.operators import variogram as V


def edges(*points):
    return [(*a, *b) for a, b in zip(points, [*points[1:], points[0]])]


def box(x0, y0, x1, y1):
    return edges((x0, y0), (x1, y0), (x1, y1), (x0, y1))


#: Polygons in metres from the origin of a made-up county.
ZONES = {"A1": (0, 0, 9000, 1000), "A2": (0, 3000, 1000, 4000), "AE1": (20000, 0, 24000, 1000), "AE2": (20000, 3000, 21000, 5000), "D1": (3000, 6000, 8000, 8000), "W1": (10000, 2000, 12000, 3000)}
POINTS = {"kept": (4000, 2500), "near": (4000, 1200), "far": (15000, 11000), "zone_d": (5000, 6500), "open_water": (11000, 2500), "pond": (12500, 3800), "outside": (28000, 2000)}


def zones(spark):
    return spark.createDataFrame([(k, box(*b), *b) for k, b in ZONES.items()], f"poly string, edges {G.EDGES}, x0 long, y0 long, x1 long, y1 long")


def points(spark):
    return spark.createDataFrame([(k, *p) for k, p in POINTS.items()], "pid string, x long, y long")


def test_band_filter_names_the_first_failure(spark):
    p, z = points(spark), zones(spark)
    segs = z.filter("poly LIKE 'A%'").select(F.posexplode("edges").alias("i", "e"), "poly").select(F.concat("poly", F.lit("/"), "i").alias("segment"), "e.*")
    d = SP.nearest_segment(p, segs, "pid", 500).select("pid", F.sqrt("d2").alias("d"))
    inside = SP.first_polygon(p, z, "pid", 2000, [F.col("poly")]).select("pid", "poly")
    t = p.join(d, "pid").join(inside, "pid")
    rules = {
        "too_near": F.col("d") < 500,
        "too_far": F.col("d") > 7000,
        "unassessed": F.coalesce(F.col("poly") == "D1", F.lit(False)),
        "open_water": F.coalesce(F.col("poly") == "W1", F.lit(False)),
        "not_on_land": (F.col("x").between(12000, 13500)) & F.col("y").between(3500, 4500),
        "outside_state": F.col("x") > 27000,
    }
    got = {r[0]: r[1] for r in t.select("pid", S.first_of(rules)).collect()}
    assert got == {"kept": "kept", "near": "too_near", "far": "too_far", "zone_d": "unassessed", "open_water": "open_water", "pond": "not_on_land", "outside": "outside_state"}


def test_polygons_against_a_plain_test(spark):
    rng = np.random.default_rng(1)
    rings = {i: [(int(a), int(b)) for a, b in rng.integers(-60, 60, (6, 2))] for i in range(12)}
    ps = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(-70, 70, (400, 2)))]
    poly = spark.createDataFrame([(i, edges(*r), min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for i, r in rings.items()], f"poly int, edges {G.EDGES}, x0 long, y0 long, x1 long, y1 long")
    got = sorted(tuple(r) for r in SP.points_in_polygons(spark.createDataFrame(ps, "pid int, x long, y long"), poly, 16).select("pid", "poly").collect())

    def inside(x, y, ring):
        odd = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (b <= y) != (d <= y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
        return odd

    assert got == sorted((i, k) for i, x, y in ps for k, r in rings.items() if inside(x, y, r))


def test_a_corner_is_in_both_squares_at_the_boundary(spark):
    z = spark.createDataFrame([(20, box(0, 0, 10, 10), 0, 0, 10, 10), (10, box(10, 0, 20, 10), 10, 0, 20, 10)], f"poly int, edges {G.EDGES}, x0 long, y0 long, x1 long, y1 long")
    p = spark.createDataFrame([(1, 10, 5)], "pid int, x long, y long")
    assert sorted(r["poly"] for r in SP.points_in_polygons(p, z, 8, boundary=True).collect()) == [10, 20]


def test_neighbours_are_exact_at_any_density(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate((rng.integers(0, 50, (150, 2)), rng.integers(0, 100_000, (60, 2)), [[5, 5], [5, 5], [5, 5]]))
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(xy)], "pid int, x long, y long")
    got = {}
    for r in SP.knn(df, df, 4, "pid").orderBy("pid", "rank").collect():
        got.setdefault(r["pid"], []).append(r["neighbour"])
    for i, p in enumerate(xy):
        d = ((xy - p) ** 2).sum(1)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(len(xy)), d)) if j != i][:4]
    few = df.limit(3)
    assert SP.knn(few, few, 10, "pid").count() == 6 and SP.knn(df.limit(0), df, 3, "pid").count() == 0


def test_bounded_nearest(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 0, 900)], "pid int, x long, y long")
    s = spark.createDataFrame([("a", 3, 4, 3, 4), ("b", -5, 100, 5, 100)], "segment string, x1 long, y1 long, x2 long, y2 long")
    assert {r["pid"]: r["d2"] for r in SP.nearest_segment(p, s, "pid", 10, radius=50).collect()} == {1: 25.0, 2: None}
    assert {r["pid"]: r["d2"] for r in SP.nearest_segment(p, s, "pid", 10).collect()} == {1: 25.0, 2: 640000.0}
    assert {r["segment"] for r in SP.nearest_segment(p, s.limit(0), "pid", 10).collect()} == {None}


def test_nearest_segment_takes_rows_by_length_and_in_parts(spark, monkeypatch):
    line = spark.createDataFrame([(1, 0, 0, 10000, 10000), (2, 0, 5, 0, 9000), (3, 7, 7, 7, 7)], "segment int, x1 long, y1 long, x2 long, y2 long")
    rows = {r[0]: r[1] for r in SP.line_cells(line, 100, 10).groupBy("segment").count().collect()}
    # The diagonal's box has 101 * 101 cells
    assert rows[1] < 500 and rows[2] == 2 * 92 and rows[3] == 4
    rng = np.random.default_rng(8)
    segs = [(i, *map(int, rng.integers(-300, 300, 4))) for i in range(60)] + [(i, a, b, a, b) for i, (a, b) in enumerate(rng.integers(-300, 300, (10, 2)).tolist(), 60)]
    segs += [(i + 100, *s[1:]) for i, s in enumerate(segs[:20])] + [(200, 2000, -300, 2000, 300)]
    ps = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(-500, 500, (300, 2)))] + [(400, 9000, 9000), (401, None, 3), (402, 0, None)]

    def d2(x, y, x1, y1, x2, y2):
        dx, dy = float(x2 - x1), float(y2 - y1)
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / n)) if n else 0.0
        return (x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2

    want = {i: (None, None) if x is None or y is None else min((d2(x, y, *s[1:]), s[0]) for s in segs) for i, x, y in ps}
    p, s = spark.createDataFrame(ps, "pid int, x long, y long"), spark.createDataFrame(segs, "segment long, x1 long, y1 long, x2 long, y2 long")
    for part in (50_000, 60):
        monkeypatch.setattr(SP, "PART", part)
        monkeypatch.setattr(SP, "SLICE", 5 * part)
        got = SP.nearest_segment(p, s, "pid").collect()
        assert len(got) == len(ps) and {r["pid"]: (r["d2"], r["segment"]) for r in got} == want


def test_thinning_is_the_sweep(spark):
    rng = np.random.default_rng(3)
    xy, u = rng.integers(0, 2000, (500, 2)), rng.permutation(500)
    df = spark.createDataFrame([(i, int(a), int(b), int(u[i])) for i, (a, b) in enumerate(xy)], "pid int, x long, y long, u int")
    kept = []
    for i in np.argsort(u):
        if all(((xy[i] - xy[j]) ** 2).sum() >= 100**2 for j in kept):
            kept.append(i)
    assert sorted(r["pid"] for r in sampling.thin(df, "pid", 100, "u").collect()) == sorted(int(i) for i in kept)
    assert sampling.thin(df.limit(1), "pid", 100, "u").count() == 1


def test_chains_and_isolated_points(spark):
    chains = [range(0, 60), range(100, 125), range(200, 212)]
    e = [(i, i + 1) for c in chains for i in list(c)[:-1]]
    nodes = spark.createDataFrame([(i,) for c in [*chains, range(300, 305)] for i in c], "node long")
    parts = K.ranked(K.components(nodes, spark.createDataFrame(e, "a long, b long")))
    sizes = [r[1] for r in parts.select("component", "size").distinct().orderBy("component").collect()]
    assert sizes == [60, 25, 12, 1, 1, 1, 1, 1]
    assert [r["root"] for r in parts.filter("size = 1").orderBy("component").collect()] == [300, 301, 302, 303, 304]
    big = K.ranked(K.components(nodes, spark.createDataFrame(e, "a long, b long")), least=20)
    assert big.count() == 85


def test_purity_and_forms(spark):
    d = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (2, 3), (2, 0)], "a long, b long")
    s = spark.createDataFrame([(0,), (1,)], "node long")
    assert K.purity(d, s).first()[0] == pytest.approx(0.5)
    assert K.purity(d, s.limit(0)).first()[0] is None
    z = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 0.5), (3, 0.5)], "node long, z double")
    row = K.quadratic(K.symmetric(d), z).first()
    assert (row["laplacian"], row["variation"]) == (1 + 0.25 + 0.25, 2.0)


def pool_frame(spark, rows):
    return spark.createDataFrame([(i, c, t, ex, [float(v) for v in z]) for i, c, t, ex, z in rows], "id long, class int, tile int, excluded array<int>, z array<double>")


def test_matches_respect_tiles_classes_and_ties(spark):
    pool = pool_frame(spark, [(1, 42, 1, [], [0.1]), (2, 42, 2, [], [0.5]), (3, 90, 3, [], [0.05]), (4, 42, 4, [], [0.5])])
    q = pool_frame(spark, [(100, 42, 9, [0, 1], [0.0])])
    got = [(r["neighbour"], r["rank"]) for r in matching.nearest(q, pool, 5).orderBy("rank").collect()]
    assert got == [(2, 1), (4, 2)]


def test_caliper_is_the_percentile_of_all_queries(spark):
    d = [1e-3 * i * i for i in range(100)]
    first = spark.createDataFrame([(i, 1, v) for i, v in enumerate(d)], "id long, rank int, d double")
    assert matching.caliper(first, 100) == pytest.approx(np.percentile(d, 95))
    assert matching.caliper(first, 102) == pytest.approx(np.percentile(d + [1e9] * 2, 95), rel=1e-6)
    with pytest.raises(ValueError):
        matching.caliper(first, 200)


def test_label_disagreement_by_hand(spark):
    q = spark.createDataFrame([(10, 1), (11, 0), (12, 0)], "id long, label long")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "id long, label long")
    m = spark.createDataFrame([(10, 0, 0.1), (10, 1, 0.2), (10, 2, 0.3), (12, 3, 0.4)], "id long, neighbour long, d double")
    row = matching.set_row(q, m, labels).first()
    assert row["eta"] == pytest.approx(5 / 6) and row["n_matched"] == 2 and row["dist_median"] == pytest.approx(0.25)


def test_variogram_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0, 0.0), (1, 500, 0, 1.0, None), (2, 1500, 0, 3.0, 3.0)], "k long, x long, y long, a double, b double")
    got = {(r["column"], r["bin"]): (r["pairs"], r["gamma"]) for r in V.semivariogram(df, "k", ["a", "b"], 1000, 3000).collect()}
    assert got == {("a", 0): (1, 0.5), ("a", 1): (2, 3.25), ("b", 1): (1, 4.5)}


def test_variogram_fit_finds_the_range():
    h = np.arange(5, 200, 10.0)
    name, c0, c1, a, reach, note = V.fit(h, 0.2 + 1.5 * (1 - np.exp(-h / 20)), np.full(len(h), 100.0), 10, 200)
    assert name == "exponential" and a == pytest.approx(20, rel=1e-3) and reach == pytest.approx(20 * math.log(20), rel=1e-3)
    assert note == "" and V.fit(h, 0.001 * h, np.full(len(h), 100.0), 10, 200)[5].startswith("beyond the lags")
    assert V.fit(h, np.full(len(h), 0.7), np.full(len(h), 100.0), 10, 200)[4:] == (0, "pure nugget (no spatial structure)")


def test_projection_of_a_published_point(spark):
    clarke = G.Albers(29.5, 45.5, 23.0, -96.0)
    x, y = clarke.forward(F.lit(-75.0), F.lit(35.0))
    lon, lat = clarke.inverse(x, y)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    # Snyder's worked example (Clarke 1866: 1,885,472.7 and 1,535,925.0 m); GRS 80 differs by tens of metres
    assert abs(r["x"] - 1885472.7) < 100 and abs(r["y"] - 1535925.0) < 100
    assert r["lon"] == pytest.approx(-75, abs=1e-10) and r["lat"] == pytest.approx(35, abs=1e-10)


def test_hulls(spark):
    rows = [("a", x, y) for x in range(5) for y in range(5)] + [("b", 1, 1), ("b", 1, 1)]
    got = {}
    for r in hulls.convex_hulls(spark.createDataFrame(rows, "g string, x long, y long").repartition(4), "g").orderBy("g", "seq").collect():
        got.setdefault(r["g"], []).append((r["x"], r["y"]))
    assert got == {"a": [(0, 0), (4, 0), (4, 4), (0, 4)], "b": [(1, 1)]}


def test_codes(spark):
    df = spark.createDataFrame([("None",), (None,), ("Frequent",)], "v string")
    assert [r[0] for r in df.select(S.flood_code(F.col("v"))).collect()] == [0, None, 4]
    with pytest.raises(Exception, match="unknown flooding frequency"):
        spark.createDataFrame([("Sometimes",)], "v string").select(S.flood_code(F.col("v"))).collect()
    blocks = spark.createDataFrame([("10_20",), ("-1_-6",)], "b string")
    assert [r[0] for r in blocks.select(S.tile_of_block(F.col("b"))).collect()] == ["2_4", "-1_-2"]


def test_joins_refuse_repeated_and_unknown_keys(spark):
    left, right = spark.createDataFrame([(1,), (None,), (3,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"] or "") for r in relational.many_to_one(left, right, "k").collect()) == [(0, ""), (1, "a"), (3, "")]
    with pytest.raises(ValueError):
        relational.many_to_one(left, right.union(right), "k")
    with pytest.raises(ValueError):
        relational.many_to_one(left, right, "k", strict=True)


def test_quota_and_split():
    rng = np.random.default_rng(1)
    counts = np.mean([sampling.quota([90, 6, 4, float("nan"), -1], 20_000, rng) for _ in range(20)], 0)
    assert counts[3] == counts[4] == 0 and counts[0] == pytest.approx(18_000, rel=0.01)
    assert sampling.quota([1, 1], 10, rng, cap=6).sum() == 10
    with pytest.raises(sampling.SupplyError):
        sampling.quota([0, 0], 5, rng)
    parts = sampling.split(360)
    assert [len(parts[k]) for k in ("train", "val", "test")] == [216, 72, 72]


def test_placement_reports_too_few_points(spark):
    z = spark.createDataFrame([(1, 0, 0, 10, 10, 3, 0.01)], "poly int, x0 long, y0 long, x1 long, y1 long, need int, fill double")
    with pytest.raises(sampling.SupplyError):
        sampling.place(z, "need", 1, F.lit(False), rounds=2)
    assert sampling.place(z, "need", 1, F.col("x") < 5).count() == 3


def clustered(n=400):
    """Points in a few crowds, with repeated places."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 3000, (12, 2))
    xy = centres[rng.integers(0, 12, n)] + rng.integers(-120, 120, (n, 2))
    return np.concatenate((xy, xy[:20], rng.integers(0, 4000, (60, 2))))


def near_matrix(xy, distance):
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) < distance**2
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block,limit", [(5000, 100_000), (20, 15)])
def test_sums_over_neighbours_need_no_pairs(spark, monkeypatch, block, limit):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "LIMIT", limit)
    xy = clustered()
    z = np.arange(len(xy)) % 5
    df = spark.createDataFrame([(i, int(a), int(b), int(z[i])) for i, (a, b) in enumerate(xy)], "pid long, x long, y long, z long")
    near = near_matrix(xy, 40)
    d = np.abs(z[:, None] - z[None]) * near
    want = {i: (int(near[i].sum()), float((near[i] * z).sum()), float((d[i] ** 2).sum()), float(d[i].sum())) for i in range(len(xy))}
    t = blocks.near_sums(df, "pid", 40, ("z",), gap="z")
    assert {r["pid"]: (r["n"], r["sum_z"], r["squares"], r["gaps"]) for r in t.collect()} == want


@pytest.mark.parametrize("block,limit", [(5000, 100_000), (20, 15)])
def test_components_of_near_points_need_no_pairs(spark, monkeypatch, block, limit):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "LIMIT", limit)
    xy = clustered()
    near, root = near_matrix(xy, 40), np.arange(len(xy))
    while (least := np.minimum(root, np.where(near, root, len(xy)).min(1))).tolist() != root.tolist():
        root = least
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(xy)] + [(900, None, 5)]
    got = {r["node"]: r["root"] for r in blocks.near_components(spark.createDataFrame(rows, "pid long, x long, y long"), "pid", 40).collect()}
    assert got == {**dict(enumerate(root.tolist())), 900: 900}


def random_rings(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        ring = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (3, 2))]
        xs, ys = zip(*ring)
        rows.append((i, i % 3, edges(*ring), min(xs), min(ys), max(xs), max(ys)))
    ps = [(i, int(a), int(b), i % 3) for i, (a, b) in enumerate(rng.integers(-70, 70, (300, 2)))]
    return spark.createDataFrame(ps, "pid int, x long, y long, map int"), spark.createDataFrame(rows, f"poly int, map int, edges {G.EDGES}, x0 long, y0 long, x1 long, y1 long")


def test_polygons_are_not_broadcast_on_an_estimate(spark):
    p, poly = random_rings(spark)
    plan = SP.points_in_polygons(p.drop("map"), poly, 16)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_the_first_polygon_is_found_in_rounds(spark):
    p, poly = random_rings(spark)
    pairs = SP.points_in_polygons(p, poly.withColumnRenamed("map", "own"), 16).select("pid", "poly", (F.col("map") == F.col("own")).alias("same")).collect()
    least = {}
    for r in pairs:
        least[r["pid"]] = min(r["poly"], least.get(r["pid"], 99))
    got = {r["pid"]: r["poly"] for r in SP.first_polygon(p, poly.drop("map"), "pid", 16, [F.col("poly")], first=1).collect()}
    assert got == {i: least.get(i) for i in range(300)}
    own = {}
    for r in pairs:
        if r["same"]:
            own[r["pid"]] = max(r["poly"], own.get(r["pid"], -1))
    got = {r["pid"]: r["poly"] for r in SP.first_polygon(p, poly, "pid", 16, [F.desc("poly")], on=("map",), first=1).collect()}
    assert got == {i: own.get(i) for i in range(300)}


def test_thinning_in_batches_is_the_sweep(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PAIRS", 200)
    rng = np.random.default_rng(8)
    xy, u = rng.integers(0, 600, (400, 2)), rng.permutation(400)
    df = spark.createDataFrame([(i, int(a), int(b), int(u[i])) for i, (a, b) in enumerate(xy)] + [(900, None, 1, 5)], "pid int, x long, y long, u int")
    kept = []
    for i in np.argsort(u):
        if all(((xy[i] - xy[j]) ** 2).sum() >= 100**2 for j in kept):
            kept.append(i)
    assert sorted(r["pid"] for r in sampling.thin(df, "pid", 100, "u").collect()) == [*sorted(int(i) for i in kept), 900]
