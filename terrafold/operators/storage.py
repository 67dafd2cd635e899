"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where tables go in local mode if ``spark.checkpoint.dir`` is unset.
LOCAL_DIR = "/tmp/checkpoints/terrafold"
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share.

    It lies in the folder that the session names in ``spark.checkpoint.dir``. Where that is unset, local
    mode (as in tests) takes LOCAL_DIR, and a cluster is refused: its machines share no local folder.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = LOCAL_DIR
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts the lineage, and random or
    order-dependent columns keep the values they have got."""
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, kinds: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns as arrays of the kinds, a batch at a time: executors pack them, and the driver gets one partition after
    another, so no value becomes an object there and no table is held twice."""
    names = list(kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype(kinds[c]).tobytes()], pa.binary()) for i, c in enumerate(names)], names)

    for row in df.select(*names).mapInArrow(pack, ", ".join(f"`{c}` binary" for c in names)).toLocalIterator():
        yield {c: np.frombuffer(row[c], kinds[c]) for c in names}


def arrays(df: DataFrame, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """packed() as one array for each column."""
    parts = list(packed(df, kinds))
    return {c: np.concatenate([np.empty(0, k), *[p.pop(c) for p in parts]]) for c, k in kinds.items()}


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """Deletes, at its end, the folders that shared_dir() has given inside it, but for ``keep``. What leaves it must
    have been written."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            if path != keep:
                removed(spark, path)
