"""SimHash near copies by covering locality-sensitive hashing.

Fingerprints. Texts are lower-cased (A-Z), cut into words and 4-word shingles; a bit is 1
if set in over half the shingles' XXH64 values.

Candidates. Each bit position gets a vector of radius + 1 bits; for each of the
2^(radius+1) - 1 non-zero vectors v, a mask holds the positions whose vector has an odd
product with v. Two fingerprints that differ in at most ``radius`` positions agree under
some mask: the differing positions' vectors span at most ``radius`` dimensions, so some v
is orthogonal to them all. No pair within the radius is missed.

Only distinct fingerprints are compared, so copies cost nothing. In a bucket of up to
BUCKET fingerprints the pairs are tested in place and only links come out. Fingerprints of a
larger bucket go another exact way, whose rows grow linearly: each is listed under every
value within radius/2 flips of it; fingerprints under one value differ by at most the radius
and are linked to the least of them, and two within the radius share such a value.

Components of the links come from alternating star contraction with the edges written to the
shared folder each round; rounds grow with the logarithm of the longest chain.

A null or empty text has fingerprint zero, linked like any other. Rows with equal ids or
texts are separate rows of one component. A component's id is its smallest id (null ids
take part, but never name a component unless all its ids are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import contracted
from . import near
from .columns import salted_join, settled, slices, texts_of

#: Distinct fingerprints up to which a bucket's pairs are tested in place.
BUCKET = 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = 4) -> int:
    """One text's fingerprint, as fingerprints() computes it."""
    return int(_fingerprints([text], width)[0])


#: Shingles that are turned into bits at once.
SHINGLES = 200_000


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _fingerprints(texts: list[str], width: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    counts: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(counts)
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
        hashes.clear(), counts.clear(), rows.clear()

    for row, text in enumerate(texts):
        words = text.encode("utf-8").translate(_LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        n = max(1, len(words) - width + 1)
        if n == 1:
            hashes.append(digest(line, 42))
        else:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            del words
            starts = np.cumsum(sizes + 1) - sizes - 1
            starts, ends = starts[:n], (starts + sizes)[width - 1 :]
            if n > SHINGLES:  # a long text by itself, in parts
                ones = np.zeros(64, np.int64)
                for at in range(0, n, SHINGLES):
                    ones += _ones([digest(line[a:b], 42) for a, b in zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())])
                out[row] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
                continue
            hashes.extend([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())])
        counts.append(n)
        rows.append(row)
        if len(hashes) > SHINGLES:
            flush()
    flush()
    return out


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fp", width: int = 4) -> DataFrame:
    """``keep`` and the fingerprint as a long (bit 63 is the sign)."""
    from pyspark.sql import types as T

    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                fp = _fingerprints(texts_of(part, "__text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], schema.names)

    return source.mapInArrow(run, schema)


def masks(radius: int, seed: int = 1) -> np.ndarray:
    """The covering masks: 2^(radius+1) - 1 values of 64 bits, of about 33 positions each."""
    d = radius + 1
    vectors = np.concatenate([np.random.default_rng([seed, i]).permutation(np.arange(1, 1 << d)) for i in range(64 // ((1 << d) - 1) + 1)])[:64]
    out = []
    for v in range(1, 1 << d):
        odd = np.array([bin(int(x) & v).count("1") & 1 for x in vectors], np.uint64)
        out.append(int((odd << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)))
    return np.array(out, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` of one column as all pairs within
    the radius would; a column so few of whose rows repeat a pair that they stay."""
    tables = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(int(x)))).alias("v")) for i, x in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.m", "k.v")
    sizes = keyed.groupBy("m", "v").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    shared = settled(sizes.filter("n > 1"))
    # A bucket of two, which most are, is a pair already.
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    pairs = shared.filter("n = 2").filter(near("least", "most")).select(F.col("least").alias("a"), F.col("most").alias("b"))
    more = keyed.join(shared.filter(f"n > 2 AND n <= {bucket}").select("m", "v"), ["m", "v"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, starts, ends = b.column(0), [], []
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.unique(flat[x:y])
                near_ = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
                i, j = np.nonzero(np.triu(near_, 1))
                starts.append(own[i])
                ends.append(own[j])
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], ["a", "b"])

    grouped = more.groupBy("m", "v").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(within, "a long, b long")
    hot = keyed.join(shared.filter(f"n > {bucket}").select("m", "v"), ["m", "v"], "left_semi").select("fp").distinct()
    half = radius // 2
    flips = [0] + [1 << i for i in range(64)]
    if half >= 2:
        flips += [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    if half > 2 or radius % 2:
        raise ValueError("radius must be 2 or 4")
    table = np.array(flips, np.uint64).view(np.int64)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0))
            for at in range(0, len(fp), 100):
                z = fp[at : at + 100, None] ^ table[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp[at : at + 100], len(table))), pa.array(z.ravel())], ["fp", "z"])

    listed = hot.mapInArrow(around, "fp long, z long")
    centers = listed.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = listed.join(centers.select("z", "a"), "z").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(grouped).unionByName(stars).distinct()


def named(own: DataFrame, id_col: str, radius: int, linked: DataFrame | None = None) -> DataFrame:
    """(fp, component_id) of every fingerprint in own, a written table of ids and fingerprints; ``linked``
    takes the place of the links within the radius."""
    kinds = settled(own.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = contracted(links(kinds.select("fp"), radius) if linked is None else linked)
    rooted = kinds.join(roots, kinds.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = settled(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    # A lone fingerprint names itself; only the others, which may be many in one component, meet their root.
    alone = rooted.filter("fp = root").join(least.filter("n = 1"), "root").select("fp", "component_id")
    return alone.unionByName(salted_join(rooted, least.filter("n > 1"), ["root"], ["fp"], "inner").select("fp", "component_id"))


def classes(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row."""
    own = settled(fingerprints(docs, text, (id_col,)))
    return own.join(named(own, id_col, radius), "fp").select(F.col(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text", similar: float | None = None, width: int = 5) -> DataFrame:
    """One row of each component, with all its columns: of the rows with the least id, the first by text.

    With ``similar``, the links of fingerprints, here of shingles of ``width`` words, hold only if the sets of shingles have that
    Jaccard similarity, and pairs that are similar enough but beyond the radius are linked too (near.py).

    Only ids travel: the texts are joined with the ids that stay, not with the components. Rows
    that repeat an id are told apart by a row number within it; those are few.
    """
    if similar is None:
        own, linked = settled(fingerprints(docs, text, (id_col,))), None
    else:
        own = settled(near.nodes(docs, id_col, text, width, _fingerprints))
        linked = near.links(docs, own, id_col, text, similar, width, lambda fps: links(fps, radius))
    best = named(own, id_col, radius, linked).select(F.col("component_id").alias("__id"), F.lit(True).alias("__stays")).distinct()
    many = own.groupBy(F.col(id_col).alias("__many")).count().filter("count > 1").select("__many")
    many = settled(many)
    once = docs.join(best, docs[id_col].eqNullSafe(best["__id"]), "left_semi")
    if many.isEmpty():
        return once
    again = once.join(many, once[id_col].eqNullSafe(many["__many"]), "left_semi")
    single = once.join(many, once[id_col].eqNullSafe(many["__many"]), "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.col(text).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in docs.columns if c not in (id_col, text)])
    return single.unionByName(again.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n"))
