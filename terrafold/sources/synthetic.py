"""A synthetic point dataset with a built-in inversion, made by hashes: the same rows from any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import uniform


def dataset(spark: SparkSession, across: int = 6, up: int = 5, each: int = 40, tile: int = 50_000, seed: int = 1) -> DataFrame:
    """``each`` points in every tile and stratum (domain by label). In domain A, the tiles of the lower left
    corner have their labels flipped against the features."""
    t = spark.range(across * up * 4 * each).withColumn("k", F.floor(F.col("id") / each))
    t = t.withColumns({"ti": F.floor(F.col("k") / 4) % across, "tj": F.floor(F.col("k") / (4 * across)), "domain": F.when(F.col("k") % 2 == 0, "A").otherwise("AE"), "label": F.floor(F.col("k") % 4 / 2).cast("int")})
    noise = lambda n: uniform(seed + n, "id") - 0.5
    flipped = (F.col("domain") == "A") & (F.col("ti") <= 1) & (F.col("tj") <= 1)
    sign = F.when(flipped, 1 - F.col("label")).otherwise(F.col("label"))
    return t.select(
        F.format_string("FL%07d", "id").alias("point_id"),
        "domain",
        "label",
        F.when(F.col("label") == 0, "band").alias("neg_protocol"),
        F.concat_ws("_", "ti", "tj").alias("tile_50km"),
        F.floor((F.col("ti") + noise(1) + 0.5) * tile).alias("x"),
        F.floor((F.col("tj") + noise(2) + 0.5) * tile).alias("y"),
        (sign + 2 * noise(3)).alias("hand"),
        (sign + 3 * noise(4)).alias("slope"),
        F.when(uniform(seed + 5, "id") > 0.03, F.floor(uniform(seed + 6, "id") * 6)).alias("soil_floodfreq"),
    )
