"""Views over the benchmark tables that stand in for points, scores, polygons and a match pool.

Coordinates are whole metres, so that squared distances and crossing tests are exact in any
engine. ``CTE`` has the same views as SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Portable SQL (Spark and DuckDB) of each view
PTS = """
SELECT o_orderkey AS pid, CAST(floor(o_totalprice) AS BIGINT) AS x, (o_custkey * 331) % 500000 AS y,
       CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'AE' END AS dom,
       CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS BIGINT) AS label,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL WHEN o_custkey % 3 = 0 THEN 'shaded_x' ELSE 'band' END AS protocol,
       o_orderstatus AS lc,
       CAST(CAST(floor(floor(o_totalprice) / 50000) AS BIGINT) AS VARCHAR(20)) || '_' || CAST(CAST(floor(((o_custkey * 331) % 500000) / 50000) AS BIGINT) AS VARCHAR(20)) AS tile,
       12000 + o_custkey % 67 AS county
FROM orders"""
SCORES = """
SELECT CAST(l_suppkey % 40 AS BIGINT) AS model, l_orderkey AS pid, max(CAST(round(l_tax * 100, 0) AS BIGINT)) AS p8
FROM lineitem GROUP BY l_suppkey % 40, l_orderkey"""
BOXES = """
SELECT p_partkey AS poly, (p_partkey * 7919) % 480000 AS x0, (p_partkey * 104729) % 480000 AS y0,
       (p_partkey * 7919) % 480000 + CAST(p_size AS BIGINT) * 400 AS x1, (p_partkey * 104729) % 480000 + CAST(p_size AS BIGINT) * 300 AS y1,
       p_partkey % 7 AS dfirm, p_partkey % 2 = 0 AS tri
FROM part"""
POOL = """
SELECT vec_id AS id, CAST(label AS BIGINT) AS class, vec_id % 5 AS tile, embedding AS z FROM embeddings"""
CTE = {"pts": PTS, "scores": SCORES, "boxes": BOXES, "pool": POOL}


def with_views(*names: str) -> str:
    """The WITH clause of the named views, for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCE = {"pts": "orders", "scores": "lineitem", "boxes": "part", "pool": "embeddings"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    source = _SOURCE[name]
    text = CTE[name].replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))
