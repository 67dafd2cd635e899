"""Joins and audits over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order (rank 1 is cut before the exchange)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def many_to_one(left: DataFrame, right: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """A left join that keeps the left rows as they are: it fails if the right side repeats a key and,
    where strict, if a left key that isn't null has no row there."""
    if not right.groupBy(on).count().filter("count > 1").isEmpty():
        raise ValueError(f"{on} repeats on the right side")
    if strict and not left.filter(F.col(on).isNotNull()).join(right, on, "left_anti").isEmpty():
        raise ValueError(f"a value of {on} has no row on the right side")
    return left.join(right, on, "left")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; empty if both hold the same keys."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, key, "full_outer").filter("in_a IS NULL OR in_b IS NULL").select(key, F.when(F.col("in_a").isNull(), "right").otherwise("left").alias("side"))


def frame_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other lacks, copies counted, with the side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def add_columns(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """base with the columns of more by a unique key; columns of the same name are replaced, the rest stay."""
    fresh = [c for c in more.columns if c != key]
    return many_to_one(base.drop(*fresh), more, key)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows where each column isn't null, and of rows where all are."""
    both = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns], F.avg(F.expr(both).cast("double")).alias("all"))
    return row.select(F.explode(F.create_map(*[x for c in [*columns, "all"] for x in (F.lit(c), F.col(c))])).alias("column", "share"))


def with_total(df: DataFrame, by: str, aggregates: list[Column], total: str = "all") -> DataFrame:
    """Groups and their grand total in one pass."""
    out = df.rollup(by).agg(F.grouping(by).alias("__g"), *aggregates)
    return out.withColumn(by, F.when(F.col("__g") == 1, total).otherwise(F.col(by))).drop("__g")


def ordered_offsets(df: DataFrame, order: list[Column], size: int, out: str = "chunk") -> DataFrame:
    """Numbers fixed-size chunks along a global order, without one task for all rows: ranges of the order
    are counted first, then ranked each by itself."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    here = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = sorted((r["__p"], r["n"]) for r in here.groupBy("__p").agg(F.count("*").alias("n")).collect())
    before, table = 0, []
    for p, n in counts:
        table.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(table or [(0, 0)], "__p int, __b long")
    numbered = here.join(F.broadcast(offsets), "__p")
    return numbered.withColumn(out, F.floor((F.col("__b") + F.col("__r") - 1) / size).cast("long")).drop("__p", "__r", "__b")
