"""Near copies by the Jaccard similarity of word shingles: SimHash links first, MinHash bands for the rest, exact verification.

Texts are lower-cased (A-Z) and cut into words; a text's set holds the 64-bit hashes of its shingles
of ``width`` words (a shorter text is one shingle). Texts of one set, as its digest tells, are one
node. The links of the nodes' SimHash fingerprints (simhash.py: covering masks) are verified first, and their components
contracted. Only pairs of different components are looked at after that: a fingerprint differs in about 10 of 64 bits
at similarity 0.8, more than any number of masks that could be made reaches, so pairs
that agree in one of BANDS bands of ROWS least values are candidates too: at similarity 0.8 a pair escapes with a chance of (1 - 0.8^4)^24, about 0.000003.
Candidates are linked only if the similarity of their sets, recomputed from the texts, is enough.

In a band's bucket of up to BUCKET nodes all pairs are candidates. A larger bucket is searched until
its links connect it as all its pairs would, without listing them. First, in up to STARS rounds, one node of the bucket (the
least, then the one with the most links) is compared with all that aren't in its component yet; that
ends buckets of copies of one text in a round or two. Buckets that still hold several components are
dealt into chunks of about CHUNK nodes, and a task compares two chunks, but only nodes of different components. So
rows grow with a bucket's nodes times its chunks, a task holds two chunks, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import contracted
from .columns import salted_join, settled, slices, texts_of

BANDS, ROWS = 24, 4
#: Nodes of a bucket up to which all pairs are listed.
BUCKET = 64
#: Rounds in which a larger bucket's nodes are compared with one of them; nodes of a chunk after that.
STARS, CHUNK = 3, 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.random.default_rng(7).integers(1 << 63, size=(BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; empty for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    width = min(width, len(hashes))
    n = len(hashes) - width + 1 if width else 0
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out ^= out >> np.uint64(31)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def _digest(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 1) if len(own) else 0


def _bands(own: np.ndarray) -> np.ndarray:
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096]
        for j, (a, b) in enumerate(_ODD):
            y = x * a + b
            y ^= y >> np.uint64(32)
            least[j] = min(least[j], (y * _MIX).min())
    out = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        out = (out ^ x) * _MIX
        out ^= out >> np.uint64(31)
    return out


def nodes(docs: DataFrame, id_col: str, text: str, width: int, fingerprints: Callable[[list[str], int], np.ndarray]) -> DataFrame:
    """The id, the set's digest ``fp``, the text's fingerprint ``sim`` and the band values, which differ by band, of every row
    (none for a text without words)."""
    longs = [T.StructField(c, T.LongType(), False) for c in ("fp", "sim")]
    schema = T.StructType([docs.schema[id_col], *longs, T.StructField("bands", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                fps, values = [], []
                texts = texts_of(part, "__text").to_pylist()
                sims = fingerprints(texts, width).view(np.int64)
                for x in texts:
                    own = shingle_set(x, width)
                    fps.append(_digest(own))
                    values.append(_bands(own) if len(own) else own)
                ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sims), bands], schema.names)

    return docs.select(id_col, F.col(text).alias("__text")).mapInArrow(run, schema)


def simhash_pairs(kinds: DataFrame, close: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (fp, sim) that the links ``close`` (a, b) of fingerprints give: the least node of a fingerprint
    with its other nodes and with the least one of each fingerprint linked to it."""
    least = settled(kinds.groupBy("sim").agg(F.min("fp").alias("a"), F.count("*").alias("n")))
    same = salted_join(kinds.select("sim", "fp"), least.filter("n > 1").select("sim", "a"), ["sim"], ["fp"], "inner").filter("fp <> a")
    ends = [least.select(F.col("sim").alias(c), F.col("a").alias(f"fp_{c}")) for c in ("a", "b")]
    other = close.select("a", "b").join(ends[1], "b").join(ends[0], "a")
    return same.select("a", F.col("fp").alias("b")).unionByName(other.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))


def candidates(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that share a bucket of up to BUCKET nodes; keyed: (v, n, fp) of the buckets of over two."""
    pairs = shared.filter("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    some = keyed.filter(f"n <= {BUCKET}").groupBy("v").agg(F.collect_list("fp").alias("fps"))
    some = some.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).filter("a < b")
    return pairs.unionByName(some).distinct()


def enough(p: np.ndarray, q: np.ndarray, similar: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``similar`` or more."""
    if min(len(p), len(q)) < similar * max(len(p), len(q)) - 1e-9:
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common >= similar * (len(p) + len(q) - common) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similar: float, stars: bool = False) -> DataFrame:
    """The pairs (a, b) that are similar enough. With ``stars``, many pairs may have one a."""
    right = sets.select(F.col("fp").alias("b"), F.col("own").alias("y"))
    left = sets.select(F.col("fp").alias("a"), F.col("own").alias("x"))
    both = pairs.select("a", "b").join(right, "b")
    if stars:
        both = salted_join(both, left.join(pairs.select("a").distinct(), "a", "left_semi"), ["a"], ["b"], "inner")
    else:
        both = both.join(left, "a")

    # c / (m + n - c) >= similar for c common ones of m and n; sizes too far apart need no look
    near = f"least(size(x), size(y)) >= {similar} * greatest(size(x), size(y)) - 1e-9 AND {1 + similar} * size(array_intersect(x, y)) >= {similar} * (size(x) + size(y)) - 1e-9"
    return both.filter(near).select("a", "b")


def chunk_links(rest: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links between nodes of different components in the buckets of rest (v, fp, root)."""
    chunks = rest.groupBy("v").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("k"))
    dealt = salted_join(rest, chunks, ["v"], ["fp"], "inner").withColumn("c", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("k")).cast("int"))
    dealt = dealt.join(sets, "fp").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("v", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp", "root", "own")

    def compare(t: pa.Table) -> pa.Table:
        fps, chunk, owns = t["fp"].to_numpy(), t["c"].to_numpy(), [x.values.to_numpy() for x in t["own"].combine_chunks()]
        _, part = np.unique(t["root"].to_numpy(), return_inverse=True)
        same_chunk = t["i"][0] == t["j"][0]
        sizes = np.array([len(x) for x in owns])
        found: list[tuple[int, int]] = []
        for i in range(len(fps)):
            other = (part != part[i]) & (np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]) - 1e-9)
            other &= (np.arange(len(fps)) > i) if same_chunk else (chunk > chunk[i])
            for j in np.flatnonzero(other).tolist():
                if part[i] != part[j] and enough(owns[i], owns[j], similar):
                    found.append((int(min(fps[i], fps[j])), int(max(fps[i], fps[j]))))
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("v", "i", "j").applyInArrow(compare, "a long, b long")


def large_buckets(hot: DataFrame, linked: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """linked, and the links that connect the buckets of hot (v, fp, root) as all their pairs would."""
    pivots = settled(hot.groupBy("v").agg(F.min("fp").alias("a")))
    used, rest = pivots, hot
    for turn in range(STARS):
        own = rest.select("v", F.col("fp").alias("a"), F.col("root").alias("own_root")).join(pivots, ["v", "a"], "left_semi")
        stars = salted_join(rest, own, ["v"], ["fp"], "inner").filter("root <> own_root").select("a", F.col("fp").alias("b")).distinct()
        linked = settled(linked.unionByName(verified(stars, sets, similar, stars=True)))
        roots = contracted(linked)
        now = rest.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        now = settled(now)
        open_ = settled(now.groupBy("v").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("v"))
        rest = settled(salted_join(now, open_, ["v"], ["fp"], "inner"))
        if rest.isEmpty():
            return linked
        if turn < STARS - 1:
            degree = linked.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("d"))
            new = rest.join(used.withColumnRenamed("a", "fp"), ["v", "fp"], "left_anti").join(degree, "fp", "left")
            pivots = settled(new.groupBy("v").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), "fp")).alias("x")).select("v", F.col("x.fp").alias("a")))
            used = used.unionByName(pivots)
    return linked.unionByName(chunk_links(rest, sets, similar))


def links(docs: DataFrame, own: DataFrame, id_col: str, text: str, similar: float, width: int, simhash_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of nodes whose similarity is ``similar`` or more, which connect the nodes as all such
    pairs that share a bucket or that ``simhash_links`` gives for the fingerprints would; own: nodes() of docs, written."""
    # Of texts that differ in repeats of shingles alone, one set has several fingerprints; the least is taken.
    kinds = settled(own.groupBy("fp").agg(F.first("bands").alias("bands"), F.min("sim").alias("sim"), F.min(F.struct(F.col(id_col).alias("id"))).alias("x")))
    fingerprinted = settled(simhash_pairs(kinds, settled(simhash_links(kinds.select(F.col("sim").alias("fp")).distinct()))))
    keyed = kinds.select("fp", F.explode("bands").alias("v"))
    shared = settled(keyed.groupBy("v").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most")).filter("n > 1"))
    keyed = settled(salted_join(keyed, shared.filter("n > 2").select("v", "n"), ["v"], ["fp"], "inner"))
    found = settled(candidates(keyed, shared))
    hot = keyed.filter(f"n > {BUCKET}").select("v", "fp")
    ends = F.explode(F.array("a", "b")).alias("fp")
    wanted = settled(found.select(ends).unionByName(fingerprinted.select(ends)).unionByName(hot.select("fp")).distinct())
    # Rows that repeat an id bring other sets along; their digests tell which are wanted.
    ids = kinds.join(wanted, "fp", "left_semi").select("x.id").distinct()
    source = docs.join(ids, docs[id_col].eqNullSafe(ids["id"]), "left_semi").select(F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                sets = [shingle_set(x, width) for x in texts_of(part, "__text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_digest(x) for x in sets], np.uint64).view(np.int64)), values], ["fp", "own"])

    sets = settled(source.mapInArrow(run, "fp long, own array<long>").join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))
    linked = settled(verified(fingerprinted, sets, similar, stars=True))
    roots = contracted(linked)
    # Pairs within a component need no look any more.
    for c in ("a", "b"):
        found = found.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    found = found.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    linked = settled(linked.unionByName(verified(found, sets, similar)))
    if hot.isEmpty():
        return linked
    hot = settled(hot.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("v", "fp", F.coalesce("root", "fp").alias("root")))
    return large_buckets(hot, linked, sets, similar)
