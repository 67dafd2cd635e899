"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of its distinct 5-word shingles are
among the document's, however long the document is.

Index. Items are partitioned by size (powers of two of their shingle counts), and each partition has an
index of its own. The MinHash sketch of an item with n shingles is the floor((1 - threshold) * n) + 1 least values of one
64-bit hash over its shingles. Whatever document holds ``threshold`` of the item misses fewer
shingles than the sketch has, so at least one sketch value is among the document's hashes:
fixed bands of a MinHash signature would lose short items inside long documents (their Jaccard
similarity tends to zero), this search loses none.

Search. Documents stay where they are: a task hashes its shingles once, and each size partition is searched by itself,
by the documents with enough shingles for its least item only, against the values of its sketches.
Candidates are verified by exact containment of the shingles' words, not their hashes.
Items go to the tasks in blocks of at most BLOCK_BYTES of text, each block a pass over the
documents; so what is broadcast is bounded however many items there are.

Words are runs without white space, in lower case, without the signs at their ends; runs
of signs alone are no words. An item of under five words is one shingle of its own width and is
found where its words stand in a row. Texts that are null or without words match nothing. Equal items, or documents, are
separate rows; each matches by itself. Item ids may be of any type, and null. The found columns replace documents' columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .columns import coded, free, position, slices, texts_of, without

#: Text bytes of the items that a block holds.
BLOCK_BYTES = 16 << 20
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """A word in lower case without the signs at its ends; empty if nothing else is in it."""
    low = word.lower()
    return low if low.isalnum() else _ENDS.sub("", low)


def words_of(text: str | None) -> list[str]:
    # The same white space as Arrow's ascii_split_whitespace
    return [w for x in re.split("[ \t-\r]+", text or "") if (w := normal(x))]


def shingles_of(text: str | None, width: int = 5) -> list[str]:
    words = words_of(text)
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 0) for w in words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words, wherever they begin."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _index(items: list[tuple], threshold: float, width: int) -> dict:
    kept, values, owners = [], [], []
    short: dict[int, dict[str, list[int]]] = {}
    for item_id, text in items:
        own = sorted(set(shingles_of(text, width)))
        if not own:
            if words := words_of(text):
                short.setdefault(len(words), {}).setdefault(" ".join(words), []).append(len(kept))
                kept.append((item_id, 1, frozenset((" ".join(words),))))
            continue
        hashes = np.unique(np.concatenate([_rolled(_word_hashes(x.split(" ")), width) for x in own]))
        sketch = hashes[: int((1 - threshold) * len(own) + 1e-9) + 1]
        values.append(sketch)
        owners.append(np.full(len(sketch), len(kept)))
        kept.append((item_id, len(own), frozenset(own)))
    # Size partitions: for each, the least shingles that a document needs, and its own sketch values with their items
    sizes = np.array([n for _, n, _ in kept], np.int64)
    groups: dict[int, list[int]] = {}
    for k, owner in enumerate(owners):
        groups.setdefault(int(np.log2(sizes[owner[0]])), []).append(k)
    partitions = []
    for _, ks in sorted(groups.items()):
        own_values, own_items = np.concatenate([values[k] for k in ks]), np.concatenate([owners[k] for k in ks])
        order = np.argsort(own_values, kind="stable")
        least = min(int(np.ceil(threshold * sizes[owners[k][0]] - 1e-9)) for k in ks)
        partitions.append((least, own_values[order], own_items[order]))
    bitmap = np.zeros(1 << 20, bool)  # of all partitions: most shingles fail it and are looked up in none
    for _, own_values, _ in partitions:
        bitmap[(own_values >> np.uint64(44)).astype(np.int64)] = True
    whole = {n: (np.unique(np.concatenate([_rolled(_word_hashes(x.split(" ")), n) for x in own])), own) for n, own in short.items()}
    return {"items": kept, "partitions": partitions, "bitmap": bitmap, "short": whole}


def _matches(texts: pa.Array, index: dict, threshold: float, width: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, common shingles) of every match."""
    lens, codes, raw = coded(pc.ascii_split_whitespace(texts))
    names = [normal(w) for w in raw]
    real = np.fromiter(map(bool, names), bool, len(names))[codes] if len(codes) else np.array([], bool)
    rows = np.repeat(np.arange(len(lens)), lens)[real]
    codes = codes[real]
    hashes = _word_hashes(names)[codes]
    for n, (values, phrases) in index["short"].items():
        at = np.flatnonzero(np.isin(_rolled(hashes, n), values))
        at = at[rows[at] == rows[at + n - 1]]
        seen = set()
        for row, a in zip(rows[at].tolist(), at.tolist()):
            phrase = " ".join([names[c] for c in codes[a : a + n].tolist()])
            if (row, phrase) not in seen:
                seen.add((row, phrase))
                for item in phrases.get(phrase, ()):
                    yield row, item, 1
    rolled = _rolled(hashes, width)
    if not len(rolled) or not index["partitions"]:
        return
    at = np.flatnonzero(index["bitmap"][(rolled >> np.uint64(44)).astype(np.int64)])
    at = at[rows[at] == rows[at + width - 1]]
    sizes = np.bincount(rows, minlength=len(lens)) - width + 1
    candidates = []
    for least, values, items in index["partitions"]:
        own = at[sizes[rows[at]] >= least]
        low = np.searchsorted(values, rolled[own], "left")
        n = np.searchsorted(values, rolled[own], "right") - low
        own, low, n = own[n > 0], low[n > 0], n[n > 0]
        if len(own):
            owners = items[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            candidates.append(np.stack((np.repeat(rows[own], n), owners), 1))
    if not candidates:
        return
    pairs = np.unique(np.concatenate(candidates), axis=0)
    starts = np.searchsorted(rows, np.arange(len(lens) + 1))
    last, own = -1, set()
    for row, item in pairs.tolist():
        if row != last:
            words = [names[c] for c in codes[starts[row] : starts[row + 1]].tolist()]
            last, own = row, {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
        _, size, shingles = index["items"][item]
        common = len(shingles & own)
        if common >= threshold * size - 1e-9:
            yield row, item, common


def _blocks(items: DataFrame, item_id: str, item_text: str, threshold: float, width: int) -> Iterator:
    """Broadcast indexes, each of about BLOCK_BYTES of items."""
    tests = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        block = tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else tests
        yield items.sparkSession.sparkContext.broadcast(_index([tuple(r) for r in block.collect()], threshold, width))


FOUND = ("item_id", "n_item", "n_common", "containment")


def hits(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """A row for each (document, item found in it): ``keep``, item_id, n_item, n_common, containment."""
    keep = [keep[i] for i in without(list(keep), *FOUND)]
    source = docs.select(*keep, F.col(text).alias(free(keep, "__text")))
    kind = items.schema[item_id].dataType
    found_types = (T.StructField("item_id", kind), T.StructField("n_item", T.IntegerType()), T.StructField("n_common", T.IntegerType()), T.StructField("containment", T.DoubleType()))
    schema = T.StructType([*(docs.schema[c] for c in keep), *found_types])
    arrow = to_arrow_type(kind)
    out = None
    for sent in _blocks(items, item_id, item_text, threshold, width):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in slices(batch, len(keep)):
                    found = list(_matches(texts_of(part, len(keep)), index, threshold, width))
                    if found:
                        taken = part.take(pa.array([row for row, _, _ in found]))
                        sizes = [index["items"][i][1] for _, i, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *taken.columns[:-1],
                                pa.array([index["items"][i][0] for _, i, _ in found], arrow),
                                pa.array(sizes, pa.int32()),
                                pa.array([c for _, _, c in found], pa.int32()),
                                pa.array([c / n for (_, _, c), n in zip(found, sizes)], pa.float64()),
                            ],
                            schema.names,
                        )

        got = source.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The documents in which no item is found, with all their columns; one pass per block, no shuffle."""
    out, at = docs, position(docs, text)
    for sent in _blocks(items, item_id, item_text, threshold, width):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, _, _ in _matches(texts_of(part, at), sent.value, threshold, width)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
