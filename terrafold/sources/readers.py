"""Readers: points with geometry, layers with varying field names, feature lists, run folders, caches."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def wkb_point(values: pd.Series) -> pd.DataFrame:
    """x and y of well-known-binary points of either byte order; null for null."""
    out = np.full((len(values), 2), np.nan)
    for i, v in enumerate(values):
        if v is not None:
            order = "<" if v[0] == 1 else ">"
            kind = struct.unpack_from(f"{order}I", v, 1)[0]
            if kind % 1000 != 1 and kind & 0xFFFF != 1:
                raise ValueError(f"geometry type {kind} is no point")
            out[i] = struct.unpack_from(f"{order}2d", v, 9 if kind & 0x20000000 else 5)
    return pd.DataFrame(out, columns=["x", "y"])


def point_wkb(x: Column, y: Column) -> Column:
    """Little-endian well-known binary of a point."""

    @F.pandas_udf("binary")
    def pack(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BI2d", 1, 1, p, q) if p == p and q == q else None for p, q in zip(a, b)], dtype=object)

    return pack(x.cast("double"), y.cast("double"))


def read_points(spark: SparkSession, path: str, geometry: str = "geometry", crs: int = 5070, found_crs: int | None = None) -> DataFrame:
    """A point table with x and y from its geometry; refuses another coordinate system."""
    if found_crs is not None and found_crs != crs:
        raise ValueError(f"{path} is in EPSG:{found_crs}, not EPSG:{crs}")
    df = spark.read.parquet(path)
    xy = wkb_point(F.col(geometry))
    return df.withColumn("__xy", xy).select(*[c for c in df.columns if c != geometry], F.when(~F.isnan("__xy.x"), F.col("__xy.x")).alias("x"), F.when(~F.isnan("__xy.y"), F.col("__xy.y")).alias("y"))


def pick(df: DataFrame, *candidates: str) -> str:
    """The first candidate among the columns, whatever its case, in the table's own spelling."""
    own = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in own:
            return own[c.lower()]
    raise KeyError(f"none of {candidates} in {df.columns}")


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """Names in a text file, in order; a line that begins with # is a comment, a # elsewhere is part of a name."""
    lines = spark.read.text(path, wholetext=True).first()
    text = lines[0] if lines else ""
    return [w for line in text.splitlines() if not line.startswith("#") for w in line.split()]


def newest(cache: DataFrame, key: str, time: str = "mtime") -> DataFrame:
    """One row for each key of a cache of many files: that of the newest file."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *[F.col(c) for c in cache.columns if c not in (key, time)])
    return cache.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_file_time(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata.file_modification_time").alias("mtime"))


def latest_run(spark: SparkSession, folder: str) -> str:
    """The greatest name among the run folders whose manifest is complete."""
    runs = spark.read.text(f"{folder}/*/manifest.json", wholetext=True).select("value", F.input_file_name().alias("f")).collect()
    done = [r["f"].rstrip("/").split("/")[-2] for r in runs if json.loads(r["value"]).get("complete")]
    if not done:
        raise FileNotFoundError(f"no complete run in {folder}")
    return max(done)


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
