"""Token-count rollups kept by signed deltas.

A change is a row with a sign: +1 for an inserted document, -1 for a deleted one, and both for
a revision (the old counts out, the new ones in). A batch of changes is reduced map-side to
one row for each (source, language, tokenizer version) and written to a folder of its own, which counts once
the store's log names it. Totals are the sums over the folders that the log has, so revising a
document costs its own counts, never a recount of the corpus. A source with a third of all rows is one row a task.

The log is a folder of numbered entries; an entry is made by creating the file of the next number, which must
not exist. Of two writers one gets the number, the other reads the log again and takes the next, unless its
batch has been committed meanwhile. So a batch can be retried, replayed or sent by two writers at once and
counts once; a folder that no entry names (a writer broke off) is never read. Compaction sums the folders so far into
one and makes an entry that replaces theirs and keeps their batch ids.

Tokens are counted by the encoders of this subpackage (byte-level BPE; word BPE), whose names are the tokenizer
versions.

Null sources or languages form groups of their own, null texts count no tokens. Repeated rows
are counted each. A batch without changes commits an empty folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, tokenfile
from .columns import position, settled, shared_dir, slices, texts_of, without

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Seconds for which the log waits for an entry that is being written.
WAIT = 5.0

Counter = Callable[[pa.Array], np.ndarray]


def byte_bpe(ranks_path: str, pattern: str) -> Counter:
    return lambda texts: bpe.codec(ranks_path, pattern).encode(texts)[0]


def word_bpe(path: str) -> Counter:
    return lambda texts: tokenfile.encode_words(path, texts)[0]


def counted(df: DataFrame, columns: dict[str, str], counters: dict[str, Counter]) -> DataFrame:
    """df with a map from tokenizer version to token count for each text column: ``columns`` maps the added name to
    the text's, and text columns go. A null text counts no tokens."""
    texts = list(columns.values())
    kept = without(df.columns, *texts, *columns)
    at = [position(df, c) for c in texts]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *(T.StructField(c, T.MapType(T.StringType(), T.LongType(), False), False) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at[0]):
                out = [part.column(i) for i in kept]
                for i in at:
                    arr = texts_of(part, i)
                    values = np.stack([np.asarray(f(arr), np.int64) for f in counters.values()], 1)
                    offsets = pa.array(np.arange(len(arr) + 1, dtype=np.int32) * len(counters))
                    out.append(pa.MapArray.from_arrays(offsets, pa.array(list(counters) * len(arr), pa.string()), pa.array(values.ravel())))
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([pa.field(n, a.type) for n, a in zip(schema.names, out)]))

    return df.mapInArrow(run, schema)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def entries(spark: SparkSession, store: str) -> dict[int, dict]:
    """The log's entries by number; a few bytes a batch."""
    fs, folder = _fs(spark, f"{store}/_log")
    out: dict[int, dict] = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else ():
        name, until = status.getPath().getName(), time.time() + WAIT
        if not name.endswith(".json") or name.startswith("."):
            continue
        while True:
            stream = fs.open(status.getPath())
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                out[int(name.split(".")[0])] = json.loads(text)
            elif time.time() < until:  # its writer is at work
                time.sleep(0.1)
                continue
            break
    return out


def _append(spark: SparkSession, store: str, number: int, entry: dict) -> bool:
    """Makes entry ``number`` of the log; False if there is one."""
    fs, path = _fs(spark, f"{store}/_log/{number:012d}.json")
    try:
        stream = fs.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    stream.write(bytearray((json.dumps(entry) + "\n").encode()))
    stream.close()
    return True


def _numbers(log: dict[int, dict]) -> int:
    return max(log, default=-1) + 1


def _active(log: dict[int, dict]) -> dict[int, dict]:
    gone = {n for e in log.values() for n in e.get("replaces", ())}
    return {n: e for n, e in log.items() if n not in gone}


def committed(log: dict[int, dict]) -> set[str]:
    return {b for e in log.values() for b in e["batches"]}


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def commit(store: str, batch_id: str, changes: DataFrame) -> bool:
    """Writes the deltas of a batch (columns source, lang, tokenizer, sign, n_tokens); False if it was committed before."""
    spark, log = changes.sparkSession, entries(changes.sparkSession, store)
    if batch_id in committed(log):
        return False
    path = f"{store}/data/{uuid.uuid4().hex}"
    delta = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
    delta.write.parquet(path)
    number = _numbers(log)
    while not _append(spark, store, number, {"batches": [batch_id], "path": path}):
        log = entries(spark, store)
        if batch_id in committed(log):
            _remove(spark, path)
            return False
        number = max(_numbers(log), number + 1)
    return True


def _sums(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], _SCHEMA)
    rows = spark.read.schema(_SCHEMA).parquet(*paths)
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """The totals over the committed batches."""
    return _sums(spark, [e["path"] for e in _active(entries(spark, store)).values()])


def compact(spark: SparkSession, store: str) -> bool:
    """Sums the committed folders into one; False if another writer did so meanwhile, or there are fewer than two."""
    log = entries(spark, store)
    active = _active(log)
    if len(active) < 2:
        return False
    path = f"{store}/data/{uuid.uuid4().hex}"
    _sums(spark, [e["path"] for e in active.values()]).write.parquet(path)
    entry = {"batches": sorted(committed(active)), "path": path, "replaces": sorted(active)}
    number = _numbers(log)
    while not _append(spark, store, number, entry):
        log = entries(spark, store)
        if not set(active) <= set(_active(log)):
            _remove(spark, path)
            return False
        number = max(_numbers(log), number + 1)
    return True


def changes(counts: DataFrame, column: str, sign: int) -> DataFrame:
    """Signed rows, one for each document and tokenizer, of a column that maps tokenizers to counts."""
    return counts.select("source", "lang", F.explode(column).alias("tokenizer", "n_tokens")).withColumn("sign", F.lit(sign))


def history(docs: DataFrame, counters: dict[str, Counter]) -> DataFrame:
    """The totals after three batches: all documents come in; those with repeated lines are revised to
    one copy of each line; those of under 50 tokens of the first tokenizer are deleted. The second batch is sent twice, and
    the store is compacted before the third."""
    spark = docs.sparkSession
    store = shared_dir(spark, "rollup")
    lines = F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1)), "\n")
    edited = lines != F.coalesce("text", F.lit(""))
    table = docs.select("source", "lang", "text", F.when(edited, lines).alias("revised"), F.coalesce(edited, F.lit(False)).alias("edited"))
    table = settled(counted(table, {"old": "text", "new": "revised"}, counters))
    revised = table.filter("edited")
    now = table.withColumn("now", F.when(F.col("edited"), F.col("new")).otherwise(F.col("old")))
    batches = {
        "insert": changes(table, "old", 1),
        "revise": changes(revised, "old", -1).unionByName(changes(revised, "new", 1)),
        "delete": changes(now.filter(F.col("now")[next(iter(counters))] < 50), "now", -1),
    }
    for batch in ("insert", "revise", "revise", "delete"):
        if batch == "delete":
            compact(spark, store)
        commit(store, batch, batches[batch])
    return totals(spark, store)
