"""Shared helpers: slices of texts, and words as arrays of codes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import removed, scratch, settled, shared_dir  # noqa: F401

#: Text bytes that one kernel call holds at once; a longer text is a slice by itself.
SLICE_BYTES = 8 << 20


def position(df: DataFrame, name: str) -> int:
    """The place of a column, by Spark's rule that a name's case says nothing."""
    return [c.lower() for c in df.columns].index(name.lower())


def without(names: list[str], *added: str) -> list[int]:
    """Places of the names that no added name replaces."""
    taken = {x.lower() for x in added}
    return [i for i, c in enumerate(names) if c.lower() not in taken]


def free(names: list[str], name: str) -> str:
    """The name, with as many underscores before it as set it apart from the names."""
    taken = {c.lower() for c in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Parts into which a salted join deals the rows of a key.
SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """many join few, with the rows of a key of ``many`` dealt over ``salts`` tasks by a hash of the columns ``by`` and those
    of ``few`` repeated for each."""
    salt = free([*many.columns, *few.columns], "salt")
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(F.lit(salts), *by), F.lit(salts)).cast("int"))
    again = few.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(again, [*on, salt], how).drop(salt)


def _at(batch: pa.RecordBatch, column: int | str) -> int:
    return column if isinstance(column, int) else batch.schema.get_field_index(column)


def slices(batch: pa.RecordBatch, column: int | str) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about SLICE_BYTES of text, so that memory stays bounded."""
    at = _at(batch, column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
    if not len(sizes):
        return
    piece = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
        release()


def release() -> None:
    """Gives freed memory back to the system: a worker lives on and shares its executor's limit with others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: int | str) -> pa.Array:
    """The text column without nulls (a null is the empty text)."""
    arr = batch.column(_at(batch, column))
    return pc.fill_null(arr.cast(pa.large_string()), "")


def coded_array(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A list column of strings as (parts per row, code of each part, distinct parts)."""
    lens = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    enc = pc.dictionary_encode(parts.flatten())
    return lens, np.array(enc.indices), enc.dictionary


def coded(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """coded_array() with the distinct parts as Python strings."""
    lens, codes, distinct = coded_array(parts)
    return lens, codes, distinct.to_pylist()


def gather(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Joins ragged entries: entry c has sizes[c] values, stored one after another."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    if not len(ends):
        return values[:0]
    kind = np.int32 if max(ends[-1], len(values)) < 1 << 31 else np.int64  # the index is the largest array here
    index = np.repeat((starts[codes] - (ends - n)).astype(kind), n)
    index += np.arange(len(index), dtype=kind)
    return values[index]


def sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]
