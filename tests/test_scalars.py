import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import scalar as S
from terrafold.operators import sampling, search
from terrafold.sources import readers, writers


def values(spark, rule, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(rule(F.col("x"))).collect()]


def test_study_regimes(spark):
    rows = [None, "", " NP\n", "\u00a0Flood Risk\t", "flood risk, ble available", "Redelineation with BFE", "digital conversion", "without BFE", "unpublished bfe", "else"]
    want = ["NOT_POPULATED", "NOT_POPULATED", "NOT_POPULATED", "BLE_RISKCLASS", "BLE_UNPUBLISHED", "BFE_DETAIL", "DIGITAL_CONVERSION", "NO_BFE", "NO_BFE", "OTHER"]
    assert values(spark, S.study_regime, rows) == want


def test_slugs_have_no_hyphens_at_their_ends(spark):
    assert values(spark, S.slug, ["St. Johns (east)", "--A  b--", "", "!!"]) == ["st-johns-east", "a-b", "", ""]


def test_class_names(spark):
    assert values(spark, lambda x: S.class_name(x.cast("int")), ["12", "31", "52", "13"])[:3] == ["Perennial Ice/Snow", "Barren Land (Rock/Sand/Clay)", "Shrub/Scrub"]


def test_feature_lists_skip_whole_comment_lines_only(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("# comment\nslope hand#m\n #x\n\n")
    assert readers.feature_list(spark, str(path)) == ["slope", "hand#m", "#x"]


def test_report_tables_are_whole_or_refused(spark):
    assert writers.markdown(spark.range(300)).count("\n") == 301
    with pytest.raises(ValueError):
        writers.markdown(spark.range(30), rows=29)


def test_tiles_are_split_once_for_all(spark):
    rows = [(f"{i % 20}", "A" if i % 2 else "AE", 0 if i % 20 in (3, 4) else 1) for i in range(0, 400)] + [(f"{t}", z, 1) for t in range(20) if t not in (3, 4) for z in ("A", "AE")] + [(None, "A", 1)]
    points = spark.createDataFrame(rows, "tile string, dom string, label int")
    seen = set()
    for seed in range(6):
        got = dict(map(tuple, sampling.split_tiles(points, "tile", "dom", "label", seed).collect()))
        test = {t for t, part in got.items() if part == "test"}
        assert sum(p == "train" for p in got.values()) == 14 and len(test) <= 6 and not test & {"3", "4"}
        seen.add(frozenset(test))
    assert len(seen) > 3


def test_top_takes_the_lower_index_of_ties():
    rng = np.random.default_rng(1)
    for _ in range(200):
        theta = rng.integers(0, 6, 30).astype(float)
        s = int(rng.integers(0, 33))
        want = np.zeros(30)
        want[np.argsort(-theta, kind="stable")[:s]] = 1
        assert (search.top(theta, s) == want).all()
