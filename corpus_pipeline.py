"""The document pipeline: quality rules, near copies, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, columns, decontam, quality, secret_scan, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or their host's verdict rejects go."""
    return quality.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (SimHash links that five-word shingles confirm at similarity 0.8, then
    similar pairs beyond the radius) stays, that with the least id."""
    return simhash.representatives(docs, similar=0.8, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; the documents stay."""
    return secret_scan.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with digests of the ids and of the bytes they decode to."""
    return bpe.digests(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("token_ids", token_ids),
]

#: SimHash needs XXH64 and the token ids need byte pair merges, which DuckDB's SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables, and its input once it has been read, are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = columns.shared_dir(spark, f"pipeline-{name}")
        with columns.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            columns.removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
