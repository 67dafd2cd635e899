"""The pipeline's stages, one by one and as a whole, against plain Python."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import brute_links, measure, prose, tiktoken_encoding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, texts = np.random.default_rng(3), []
    for k in range(8):
        base = prose(120, 900 + k)
        near = base.split()
        near[50] = "other"
        texts += [base, base, " ".join(near), base.upper()]
    items = [(1, prose(20, 50)), (2, prose(9, 51)), (3, "too short to miss")]
    texts += [prose(60, 60) + " " + items[0][1] + " end", prose(300, 61) + " " + items[1][1], "this is too short to miss " + prose(60, 62)]
    texts += [prose(70, 70 + k) + f" password = 'live{k}secret0{k}' and token=EXAMPLE0EXAMPLE0" for k in range(5)]
    texts += [None, "", "short text", "same words again " * 40, prose(4000, 80), "x" * 20_000 + " " + prose(60, 81), "日本語 " * 60 + prose(60, 82)]
    rows = [(int(i), texts[k], "en", f"s{k % 5}", None if texts[k] is None else len(texts[k])) for i, k in enumerate(rng.permutation(len(texts)))]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, str(folder)


def kept_by_rules(rows):
    out = []
    for r in rows:
        n, *_, repeats = measure(r[1])
        if n >= 50 and 100 * repeats <= 50 * n:
            out.append(r)
    return out


def kept_of_copies(rows):
    rows = sorted(rows)
    return [r for i, (r, root) in enumerate(zip(rows, brute_links([r[1] for r in rows], 0.8))) if i == root]


def kept_clean(rows, items):
    words = lambda t: [w for x in t.lower().split() if (w := re.sub(r"^[\W_]+|[\W_]+$", "", x))]
    cut = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    tests = [words(t) for _, t in items]
    return [r for r in rows if not any(len(cut(words(r[1]), min(5, len(t))) & cut(t, min(5, len(t)))) >= 0.8 * len(cut(t, min(5, len(t)))) for t in tests)]


def masked(rows):
    assign = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""")
    owners = {}
    for r in rows:
        for m in assign.finditer(r[1]):
            owners.setdefault(m[2], set()).add(r[3])
    out = []
    for r in rows:
        text = assign.sub(lambda m: m[0] if len(owners[m[2]]) >= 3 else "[SECRET]", r[1])
        out.append((*r[:1], text, *r[2:4], len(text)))
    return out


def test_stages_and_the_whole_equal_brute_force(spark, corpus):
    rows, items, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = kept_by_rules(rows)
    for name, step in (("quality", None), ("near_copies", kept_of_copies), ("decontamination", lambda x: kept_clean(x, items)), ("secrets", masked)):
        want = step(want) if step else want
        got = STAGES[name](spark, docs, folder)
        assert got.columns == docs.columns, name
        assert sorted(map(tuple, got.collect())) == sorted(want), name
        docs = spark.createDataFrame(want, SCHEMA)
    assert len(want) == 8 + 5 + 3 and sum("[SECRET]" in r[1] for r in want) == 5
    enc = tiktoken_encoding()
    final = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert final == sorted((r[0], enc.encode_ordinary(r[1])) for r in want)
    assert sorted((r["doc_id"], r["ids"]) for r in STAGES["token_ids"](spark, docs, folder).collect()) == final


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[2]).count() == 0, name


def test_own_columns_pass_whatever_their_names(spark, corpus):
    docs = spark.read.parquet(f"{corpus[2]}/documents.parquet")
    for c in ("fp", "spans", "fails", "kept", "bands", "own", "live", "__text"):
        docs = docs.withColumn(c, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, corpus[2])
        assert got.columns == docs.columns and got.filter("fp = 'own' AND spans = 'own'").count() == got.count() > 0, name
