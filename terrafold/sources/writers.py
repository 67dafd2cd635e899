"""Writers: tables with their settings beside them, committed by a rename, and export bundles."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in place at once: written beside its name, then renamed."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, True)
    if not fs.rename(tmp, p):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_table(df: DataFrame, path: str, settings: dict | None = None, row_group_bytes: int = 128 << 20) -> int:
    """Writes a zstd Parquet table, then its settings and row count as JSON beside it; readers that need
    the settings see them only after the table is whole. Returns the count."""
    staged = f"{path}.{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", str(row_group_bytes)).parquet(staged)
    spark = df.sparkSession
    n = spark.read.parquet(staged).count()
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    if not fs.rename(_fs(spark, staged)[1], p):
        raise OSError(f"could not put {path} in place")
    write_text(spark, f"{path}.json", json.dumps({"rows": n, **(settings or {})}, sort_keys=True))
    return n


def export(df: DataFrame, path: str, by: str) -> dict[str, int]:
    """A CSV folder for each component, and the counts read back, which must agree."""
    df.write.partitionBy(by).option("header", True).mode("overwrite").csv(path)
    want = {str(r[0]): r[1] for r in df.groupBy(by).count().collect()}
    got = {str(r[0]): r[1] for r in df.sparkSession.read.option("header", True).csv(path).groupBy(by).count().collect()}
    if want != got:
        raise OSError(f"{path} holds {got}, not {want}")
    return got


#: Rows that a report table may have.
REPORT_ROWS = 10_000


def markdown(df: DataFrame, rows: int = REPORT_ROWS) -> str:
    """A small report table as Markdown; a table of more than ``rows`` rows is refused, not cut."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    found = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report table of over {rows} rows")
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in found)])
