"""The registered queries of this subpackage; each is thin and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, quality, rollup, secret_scan, shard, simhash, template, tokenfile

RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shard.sized(table(spark, sf_dir, "documents"))
    return shard.shard(docs, 40).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.summary(tokenfile.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), END_ID))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), radius=4)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = {"byte_bpe_50k": rollup.byte_bpe(public_tokenizers.path(RANKS), public_tokenizers.PATTERN), "word_bpe_49k": rollup.word_bpe(public_tokenizers.path(WORDS))}
    return rollup.history(table(spark, sf_dir, "documents"), counters)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sharding,
        op2_byte_bpe,
        op3_token_files,
        op4_simhash,
        op5_secrets,
        op6_quality,
        op7_token_counts,
        op8_decontamination,
        op9_language_id,
        op10_main_text,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality": quality.SQL}
