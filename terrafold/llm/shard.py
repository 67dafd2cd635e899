"""Uniform sharding by a hypergeometric communication matrix.

A uniform shuffle of all rows into shards of fixed sizes induces, for input partitions of
n_p rows, a table of counts (partition p to shard s) that follows a multivariate
hypergeometric law. Here the table is drawn first, then each partition permutes its rows
and deals the drawn counts, rows are exchanged, and each shard permutes what it received.
Shard sizes are exact: they differ by one row at most, whatever the data.

The table is never held whole. It is drawn down a binary tree over the partitions, each
node seeded by its bounds, so a task draws its own row in log2(partitions) steps from the
partitions' sizes alone (8 bytes a partition). Everything depends on the seed and on the
scan's partitions only, so that a lost executor's tasks give the same rows again.

A shard of more than RANGE_ROWS rows is dealt as several ranges, which are shards of the matrix like any other, of
exact sizes. So the first slot of each range is known beforehand, no task sorts a whole shard, and one exchange of the
rows gives slots without gaps; within a range, rows are ordered by a random key.

Null texts count as empty; repeated rows and repeated or null ids are separate rows, each
dealt by its place in the scan; an empty table gives no rows. Columns of the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free, without

#: Rows for each range of a shard.
RANGE_ROWS = 500_000
# Tags that keep the seeds of tree nodes and of partitions apart
_TREE, _DEAL = 0, 1
_NUMPY_LIMIT = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Draws how many of n picks from good + bad items are good, for counts of any size."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n and good + bad else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = int(40 * (1 + n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5) + 40
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) - np.log(k + 1) + np.log(n - k) - np.log(bad - n + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split(rng: np.random.Generator, counts: list[int], n: int) -> list[int]:
    """Draws how many of n picks fall on each of the groups of the given sizes."""
    rest, out = sum(counts), []
    for c in counts:
        rest -= c
        got = hypergeometric(rng, c, rest, n)
        out.append(got)
        n -= got
    return out


def matrix_row(ends: np.ndarray, shards: list[int], p: int, seed: int) -> list[int]:
    """Row p of the communication matrix; ends: running sums of the partitions' sizes, from 0."""
    counts, a, b = shards, 0, len(ends) - 1
    while b - a > 1:
        mid = (a + b) // 2
        left = split(np.random.default_rng([seed, _TREE, a, b]), counts, int(ends[mid] - ends[a]))
        if p < mid:
            counts, b = left, mid
        else:
            counts, a = [x - y for x, y in zip(counts, left)], mid
    return counts


def shard(df: DataFrame, n_shards: int, seed: int = 7, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Adds the shard (0 to n_shards - 1) and the slot (0, 1, ... within the shard) of each row.

    df must be deterministic from scan to here (a scan, with columns added and rows filtered).
    """
    spark = df.sparkSession
    sizes = {r[0]: r[1] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}
    n_parts = max(sizes, default=-1) + 1
    total = sum(sizes.values())
    ends = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(n_parts)]))).astype(np.int64)
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    n_ranges = max(1, -(-shards[0] // RANGE_ROWS))
    ranges = [x // n_ranges + (r < x % n_ranges) for x in shards for r in range(n_ranges)]
    sent = spark.sparkContext.broadcast(ends)
    kept = without(df.columns, shard_col, slot_col)
    names = [df.columns[i] for i in kept]
    extra = [free(names, f"__{x}") for x in ("range", "key", "row")]
    added = [T.StructField(extra[0], T.IntegerType(), False), *(T.StructField(x, T.LongType(), False) for x in extra[1:])]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *added])
    source = df.select(*names, F.spark_partition_id().alias(extra[0]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rng, at, p = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if labels is None:
                p = batch.column(batch.num_columns - 1)[0].as_py()
                rng = np.random.default_rng([seed, _DEAL, p])
                labels = rng.permutation(np.repeat(np.arange(len(ranges), dtype=np.int32), matrix_row(sent.value, ranges, p, seed)))
            n = batch.num_rows
            own = [pa.array(labels[at : at + n]), pa.array(rng.integers(0, 1 << 62, n)), pa.array((np.int64(p) << 33) + np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], schema.names)

    here = Window.partitionBy(extra[0]).orderBy(*extra[1:])
    at, of = F.col(extra[0]) % n_ranges, F.floor(F.col(extra[0]) / n_ranges).cast("int")
    # The rows of a shard's earlier ranges: of its total // n_ranges rows each, and one more in the first few
    rows = F.lit(total // n_shards) + (of < total % n_shards).cast("long")
    first = at * F.floor(rows / n_ranges) + F.least(at, rows % n_ranges)
    dealt = source.mapInArrow(deal, schema).withColumn("__slot", first + F.row_number().over(here) - 1)
    return dealt.select(*names, of.alias(shard_col), F.col("__slot").cast("long").alias(slot_col))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns that are exchanged: the id, the size in bytes and the text's crc32."""
    return docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
