"""Byte-level BPE: encoding and decoding as DuckDB queries within each partition.

Encoding. The pre-tokeniser's pieces of a slice of rows are made distinct; a piece that
is itself a vocabulary entry is done. Any other piece becomes token-position rows
(piece, position, token, next position, next token) that a recursive query joins with
the merge table: each round contracts the piece's leftmost pair of minimum rank, until no
pair of the piece has a rank. A recursive query keeps the rows of all its rounds, so it
makes at most STEP_ROWS of them and the pieces that aren't done go on in another query.
A piece of over LONG bytes is encoded in windows (stitch.py), which gives the same ids, so
one of millions of bytes costs time in proportion to its length.

Decoding. (row, position, id) rows join the vocabulary, and an aggregation ordered by
position joins the bytes.

Nothing is shuffled. A task's memory is bounded by SLICE_BYTES of text (or one longer text)
and STEP_ROWS rows for each DuckDB call; a lost executor's tasks are simply run again.

Nulls and the empty text have no ids. Repeated rows get the same ids. All other columns
pass through; a column of the added name is replaced, as by withColumn.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import coded_array, gather, position, slices, sums, texts_of, without
from .stitch import stitched, windows_of

#: Bytes beyond which a piece is encoded in windows.
LONG = 64
#: Rows at the beginning of a recursive query, and rows of all its rounds.
START_ROWS, STEP_ROWS = 100_000, 2_000_000
#: Encoded pieces, and encoded windows, that a process remembers, so that later slices needn't encode them again.
DONE, WINDOWS = 400_000, 50_000
#: Bytes of long pieces whose windows are encoded together.
GROUP_BYTES = 256 << 10

_NO_POS, _NO_TOKEN = 1 << 40, 65535

# A token stands at its last byte's position. A pair's rank, position and distance (under 256 bytes) are one number,
# so that a minimum finds the leftmost pair of minimum rank.
_STEP_SQL = """
WITH RECURSIVE step(n, w, p, p2, t, t2, k) AS (
  SELECT 0, s.w, s.p, s.p2, s.t, s.t2, m.k FROM start s LEFT JOIN merges m ON m.pair = (s.t << 16) | s.t2
  UNION ALL
  (WITH best AS (SELECT w, min((k << 44) | (p << 8) | (p2 - p)) AS b FROM step WHERE k IS NOT NULL AND n < {rounds} GROUP BY w),
        cut AS (SELECT w, b >> 44 AS m, (b >> 8) & 68719476735 AS bp, ((b >> 8) & 68719476735) + (b & 255) AS bp2 FROM best),
        moved AS (
          SELECT s.n + 1 AS n, s.w, s.p, CASE WHEN s.p2 = c.bp THEN c.bp2 ELSE s.p2 END AS p2,
                 CASE WHEN s.p = c.bp2 THEN c.m ELSE s.t END AS t, CASE WHEN s.p2 = c.bp THEN c.m ELSE s.t2 END AS t2
          FROM step s JOIN cut c USING (w) WHERE s.p <> c.bp)
   SELECT v.n, v.w, v.p, v.p2, v.t, v.t2, m.k FROM moved v LEFT JOIN merges m ON m.pair = (v.t << 16) | v.t2)
)
SELECT s.w, s.p, s.p2, s.t, s.t2, s.k FROM step s JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n) ORDER BY s.w, s.p
"""

#: The one thread of the connection aggregates rows in the order in which the sort gives them.
_DECODE_SQL = "SELECT d, string_agg(b, '') AS s FROM (SELECT d, b FROM ids JOIN vocab USING (id) ORDER BY d, p) GROUP BY d"


class Codec:
    """One process's vocabulary, with the DuckDB connection that holds its tables."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        pairs = [
            (left << 16 | right, k)
            for word, k in self.ranks.items()
            for i in range(1, len(word))
            if (left := self.ranks.get(word[:i])) is not None and (right := self.ranks.get(word[i:])) is not None
        ]
        #: Ids (unsigned 16-bit) of whole vocabulary entries, and of up to DONE pieces met before in this process.
        self.done = {w: k.to_bytes(2, "little") for w, k in self.ranks.items()}
        #: Ids of windows of long pieces; a window that is a vocabulary entry goes through the merges like any other.
        self.windows: dict[bytes, bytes] = {}
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = list(map(len, self.ranks))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("m0", pa.table({"pair": [p for p, _ in pairs], "k": [k for _, k in pairs]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m0")
        self.db.register("v0", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "b": [w.decode("latin-1") for w in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v0")

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each piece: how many, all ids one after another)."""
        done = [self.done.get(x) for x in pieces]
        short = [i for i, k in enumerate(done) if k is None and len(pieces[i]) <= LONG]
        for i, raw in zip(short, self._contracted([pieces[i] for i in short])):
            done[i] = raw
            if len(self.done) < DONE:
                self.done[pieces[i]] = raw
        group, size = [], 0
        for i in [i for i, k in enumerate(done) if k is None]:
            if group and size + len(pieces[i]) > GROUP_BYTES:
                self._stitch(pieces, group, done)
                group, size = [], 0
            group.append(i)
            size += len(pieces[i])
        if group:
            self._stitch(pieces, group, done)
        sizes = np.fromiter((len(k) >> 1 for k in done), np.int64, len(done))
        return sizes, np.frombuffer(b"".join(done), np.uint16)

    def _stitch(self, pieces: list[bytes], group: list[int], done: list) -> None:
        if len(group) > 1:  # their windows share a query
            self._windows([w for i in group for w in windows_of(pieces[i])])
        for i in group:
            done[i] = stitched(pieces[i], self._windows, self.sizes).tobytes()

    def _windows(self, windows: list[bytes]) -> list[np.ndarray]:
        new = [w for w in dict.fromkeys(windows) if w not in self.windows]
        if len(self.windows) + len(new) > WINDOWS:
            self.windows.clear()
            new = list(dict.fromkeys(windows))
        self.windows.update(zip(new, self._contracted(new)))
        return [np.frombuffer(self.windows[w], np.uint16) for w in windows]

    def _contracted(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, by the merges alone."""
        out: list[bytes] = [b""] * len(pieces)
        block, rows = [], 0
        for i, x in enumerate(pieces):
            if block and rows + len(x) > START_ROWS:
                self._contract(pieces, block, out)
                block, rows = [], 0
            block.append(i)
            rows += len(x)
        if block:
            self._contract(pieces, block, out)
        return out

    def _contract(self, pieces: list[bytes], index: list[int], out: list[bytes]) -> None:
        rows = self._rows([pieces[i] for i in index])
        while rows.num_rows:
            self.db.register("start", rows)
            got = self.db.sql(_STEP_SQL.format(rounds=max(1, STEP_ROWS // rows.num_rows))).to_arrow_table()
            w = got["w"].to_numpy()
            opens = np.zeros(len(index), bool)
            opens[w[np.asarray(got["k"].is_valid())]] = True
            goes_on = opens[w]
            raw = got["t"].to_numpy().astype(np.uint16).tobytes()
            ends = 2 * np.searchsorted(w, np.arange(len(index) + 1))
            for j in np.flatnonzero(~opens & (np.diff(ends) > 0)).tolist():
                out[index[j]] = raw[ends[j] : ends[j + 1]]
            rows = got.select(["w", "p", "p2", "t", "t2"]).filter(pa.array(goes_on))

    def _rows(self, pieces: list[bytes]) -> pa.Table:
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        t = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        w = np.repeat(np.arange(len(pieces)), lens)
        p = np.arange(len(t)) - (np.cumsum(lens) - lens)[w]
        last = p == lens[w] - 1
        t2 = np.append(t[1:], 0)
        t2[last] = _NO_TOKEN
        return pa.table({"w": w, "p": p, "p2": np.where(last, _NO_POS, p + 1), "t": t, "t2": t2})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text: how many, all ids one after another).

        Texts are cut before single spaces, where every piece of the pattern ends. A cut
        holds only between characters that aren't white space, so texts with longer white
        space are cut with care; Arrow cuts the rest.
        """
        odd = np.asarray(pc.match_substring_regex(texts, r"[\s\x0B\x1C-\x1F\x{85}\p{Z}] |  |^ | $"))
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        lens, codes, parts = coded_array(pc.split_pattern(texts.take(pa.array(plain)), " "))
        first = np.zeros(len(codes), bool)
        first[np.cumsum(lens) - lens] = True
        lead, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(parts)
        careful = [_careful(x) for x in texts.take(pa.array(rest)).to_pylist()]
        more: dict[str, int] = {}
        codes = np.concatenate((codes, np.array([len(parts) + len(lead) + more.setdefault(x, len(more)) for row in careful for x in row], np.int64)))
        lens = np.concatenate((lens, np.array([len(row) for row in careful], np.int64)))
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), parts, pa.scalar(" ", pa.large_string()))
        chunks = pa.chunked_array([spaced, parts.take(pa.array(lead)), pa.array(list(more), pa.large_string())]).combine_chunks()
        sizes, ids = self._encode_chunks(chunks)
        totals, out = sums(sizes[codes], lens), gather(codes, sizes, ids)
        if not len(rest):
            return totals, out
        order = np.argsort(np.concatenate((plain, rest)), kind="stable")
        return totals[order], gather(order, totals, out)

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Most chunks are letters, or letters and then signs, which are a piece each; the pattern cuts the others."""
        found = pc.extract_regex(chunks, _WORD_SIGNS)
        cut, word = np.flatnonzero(found.is_valid()), np.flatnonzero(pc.match_substring_regex(chunks, _WORD))
        other = np.ones(len(chunks), bool)
        other[cut] = other[word] = False
        other = np.flatnonzero(other)
        rest = [self.find(x) for x in chunks.take(pa.array(other)).to_pylist()]
        n_rest = np.fromiter(map(len, rest), np.int64, len(rest))
        of = np.concatenate((cut, cut, word, np.repeat(other, n_rest)))
        place = np.concatenate((np.zeros(len(cut), np.int64), np.ones(len(cut), np.int64), np.zeros(len(word), np.int64), np.arange(n_rest.sum()) - np.repeat(np.cumsum(n_rest) - n_rest, n_rest)))
        some = found.take(pa.array(cut))
        pieces = [pc.struct_field(some, "word"), pc.struct_field(some, "signs"), chunks.take(pa.array(word)), pa.array([x for row in rest for x in row], pa.large_string())]
        coded = pc.dictionary_encode(pa.chunked_array(pieces).combine_chunks())
        n_pieces = np.bincount(of, minlength=len(chunks))
        codes = np.empty(len(of), np.int64)
        codes[(np.cumsum(n_pieces) - n_pieces)[of] + place] = np.asarray(coded.indices)
        sizes, ids = self.encode_pieces(coded.dictionary.cast(pa.large_binary()).to_pylist())
        return sums(sizes[codes], n_pieces), gather(codes, sizes, ids.astype(np.uint32))


# Letters that every Unicode version takes for such, and the ASCII signs
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u021f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f]+"
_WORD, _WORD_SIGNS = f"^ ?{_LETTERS}$", f"^(?P<word> ?{_LETTERS})(?P<signs>[!-/:-@\\[-`{{-~]+)$"


def _careful(text: str) -> list[str]:
    out: list[str] = []
    for i, part in enumerate(text.split(" ")):
        if out and (out[-1] == "" or out[-1][-1].isspace() or not part):
            out[-1] += " " + part
        else:
            out.append(" " + part if i else part)
    return out


@functools.cache
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as an int list; ``ids`` may replace any column, ``text`` too."""
    kept = without(df.columns, ids)
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    at = position(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                lens, out = codec(ranks_path, pattern).encode(texts_of(part, at))
                offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), column], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, ranks_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Adds the bytes that each row's ids stand for (null ids: null)."""
    kept = without(df.columns, out)
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, T.BinaryType(), True)])
    at = position(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = decoded(codec(ranks_path, pattern), batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), back], schema.names)

    return df.mapInArrow(run, schema)


#: Ids for each decoding query.
DECODE_ROWS = 500_000


def decoded(code: Codec, column: pa.Array) -> pa.Array:
    """The bytes of each list of ids; null for a null list."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int32)
    out: list[list[bytes] | None] = [[] if ok else None for ok in np.asarray(column.is_valid())]
    d = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    for at in range(0, len(flat), DECODE_ROWS):
        ids = flat[at : at + DECODE_ROWS]
        code.db.register("ids", pa.table({"d": d[at : at + DECODE_ROWS], "p": np.arange(len(ids), dtype=np.int64), "id": ids}))
        got = code.db.sql(_DECODE_SQL).to_arrow_table()
        for i, s in zip(got["d"].to_pylist(), got["s"].to_pylist()):
            out[i].append(s.encode("latin-1"))
    return pa.array([x if x is None else b"".join(x) for x in out], pa.binary())


def digests(df: DataFrame, text: str, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encodes whole texts, decodes the ids, and returns ``keep``, n_tokens, ids_sha256, decoded_sha256.

    Both steps run on a slice of rows while its ids are in memory, so that they are neither
    shuffled nor sent back to the JVM in between; ``ids`` adds them as a list column.
    """
    df = df.select(*keep, text) if text not in keep else df.select(*keep)
    schema = T.StructType(
        [
            *(df.schema[c] for c in keep),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids_sha256", T.StringType(), False),
            T.StructField("decoded_sha256", T.StringType(), False),
            *([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if ids else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                lens, out = code.encode(texts_of(part, text))
                ends = np.cumsum(lens)
                little = out.astype("<u4", copy=False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out.astype(np.int32)))
                back = decoded(code, lists)
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                columns += [
                    pa.array(lens, pa.int64()),
                    pa.array([hashlib.sha256(little[b - n : b]).hexdigest() for b, n in zip(ends.tolist(), lens.tolist())], pa.string()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in back], pa.string()),
                    *([lists] if ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)
