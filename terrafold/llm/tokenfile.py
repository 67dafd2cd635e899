"""Token-id files: Parquet list columns, ordered by document, that can be read in parts.

Documents are exchanged by ranges of the id, so that file k holds ids below those of file
k + 1, and sorted within a file. Each text is encoded (the tokenizers library, on the
distinct words of a slice) and written as one row: doc_id, part, local_start, n_tokens and
the ids as an int list, the latter dictionary-encoded (a vocabulary's ids have few distinct
values), plain numbers delta-encoded where no dictionary pays. Row groups are of fixed size
and pages are small, each with its entry in the column index: a reader that filters by
doc_id reads those pages only, and one that wants counts never reads the ids.

The global start of a document is local_start plus the tokens of earlier files; the
files' totals are one row a file. Nulls are empty texts; null doc_ids come first; equal
doc_ids are ordered by text; the empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import coded_array, gather, shared_dir, slices, sums, texts_of

#: Settings of the files: row groups, pages, and the writer whose fallback encoding is delta.
OPTIONS = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.column.index.truncate.length": "64",
    "compression": "zstd",
}

FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType(), False),
        T.StructField("local_start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    ]
)


@functools.cache
def tokenizer(path: str):
    """(tokenizer, words met before in this process and their ids, whether an id ends a word)."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocab = tok.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for word, i in vocab.items() if word.endswith(WORD_END)]] = True
    return tok, {}, ends


#: Words for each call of the tokenizer, and words that it gets as one text.
WORDS, JOINED = 5_000, 200
#: Words that a process remembers.
KNOWN = 200_000
# The vocabulary's mark of a word's last token; how special tokens begin
WORD_END, SPECIAL = "</w>", "<|"
# A letter or digit that every Unicode version takes for one (but U+0130, whose lower case ends in a mark), and the ASCII signs after it
_TAIL = "(?s)^(?P<core>.*[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u021f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f])(?P<tail>[!-/:-@\\[-`{-~]+)$"


def _encoded(tok, ends: np.ndarray, words: list[str]) -> list[bytes]:
    """The ids (unsigned 16-bit) of each word.

    Words of letters only are one pre-token each, so JOINED of them are encoded as one text and cut behind the
    ids that end a word; should a text not have as many of these as words, its words are encoded one by one.
    """
    out: dict[str, bytes] = {}
    plain = [w for w in words if w.isalpha()]
    for at in range(0, len(plain), WORDS):  # an encoding holds a hundred times its ids
        block = plain[at : at + WORDS]
        texts = [block[i : i + JOINED] for i in range(0, len(block), JOINED)]
        for own, e in zip(texts, tok.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint16)
            cuts = (2 * np.flatnonzero(ends[ids]) + 2).tolist()
            if len(cuts) == len(own):
                raw = ids.tobytes()
                out.update((w, raw[a:b]) for w, a, b in zip(own, [0, *cuts], cuts))
    rest = [w for w in words if w not in out]
    for at in range(0, len(rest), WORDS):
        block = rest[at : at + WORDS]
        out.update((w, array("H", e.ids).tobytes()) for w, e in zip(block, tok.encode_batch_fast(block, add_special_tokens=False)))
    return [out[w] for w in words]


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word as its core and the signs at its end, as the tokenizer cuts and folds them.

    The tokenizer breaks between a letter or digit and a sign behind it, and lowers letters. ASCII letters are
    lowered here only where a core has no others, since composition comes first. What may hold a special token
    stays whole.
    """
    special = pc.match_substring(words, SPECIAL)
    found = pc.extract_regex(words, _TAIL)
    cut = pc.and_not(found.is_valid(), special)
    core = pc.if_else(cut, pc.struct_field(found, "core"), words)
    tail = pc.if_else(cut, pc.struct_field(found, "tail"), "")
    return pc.if_else(pc.and_not(pc.string_is_ascii(core), special), pc.ascii_lower(core), core), tail


def encode_words(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each text: how many, all ids). The tokenizer drops white space and breaks at
    it, so a text's ids are those of its parts between spaces and line ends, joined."""
    tok, known, ends = tokenizer(path)
    lens, codes, words = coded_array(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
    core, tail = _parts(words)
    both = pc.dictionary_encode(pa.chunked_array([core, tail]).combine_chunks())
    names = both.dictionary.to_pylist()
    new = [w for w in names if w not in known]
    fresh = dict(zip(new, _encoded(tok, ends, new)))
    done = [known.get(w) if w in known else fresh[w] for w in names]
    if len(known) < KNOWN:
        known.update(fresh)
    sizes = np.fromiter((len(x) >> 1 for x in done), np.int64, len(done))
    of = np.asarray(both.indices).reshape(2, -1).T.ravel()  # core and tail of each word, one after another
    sizes, ids = sizes[of].reshape(-1, 2).sum(1), gather(of, sizes, np.frombuffer(b"".join(done), np.uint16))
    return sums(sizes[codes], lens), gather(codes, sizes, ids)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text", n_files: int | None = None) -> None:
    """Writes the token file (a folder of Parquet files) in ascending order of the id."""
    spark = docs.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            for part in slices(batch, "text"):
                lens, ids = encode_words(tokenizer_path, texts_of(part, "text"))
                ends = np.cumsum(lens)
                ids = np.insert(ids.astype(np.int32), ends, np.int32(end_id))
                lens = lens + 1
                ends = np.cumsum(lens)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(start + ends - lens), pa.array(lens), lists], FILE_SCHEMA.names)
                start += int(ends[-1])

    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**OPTIONS).mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file, with the global start of each."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a file
    before, offsets = 0, {}
    for r in totals:
        offsets[r["part"]] = before
        before += r["n"]
    table = spark.createDataFrame(list(offsets.items()), "part int, before long")
    return files.join(F.broadcast(table), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def summary(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents that read() gives."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat = np.asarray(lists.flatten()).astype("<u4")
            ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64)).tolist()
            crc = [zlib.crc32(flat[x:y]) for x, y in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write(docs, path, tokenizer_path, end_id)
    return read(spark, path)
