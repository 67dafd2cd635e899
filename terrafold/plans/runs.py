"""Queries of sources, sinks and staged runs, on tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..registry import register
from ..runner import Runner, Stage
from ..sources import readers, writers
from ..sources.proxies import table, view, with_views


@register("S02_point_geometry", with_views("pts") + "SELECT pid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pts")
def geometry(spark, sf_dir):
    """Points written as well-known binary and read again."""
    path = shared_dir(spark, "points")
    view(spark, sf_dir, "pts").select("pid", readers.point_wkb(F.col("x"), F.col("y")).alias("geometry")).write.parquet(path)
    return readers.read_points(spark, path, found_crs=5070)


@register("S17b_cache_of_files", "SELECT c_custkey, c_acctbal FROM customer")
def cache(spark, sf_dir):
    """Two files of a cache; the newer one wins."""
    path = shared_dir(spark, "cache")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    c.withColumn("c_acctbal", F.lit(0.0)).withColumn("mtime", F.lit(1)).write.parquet(path)
    c.withColumn("mtime", F.lit(2)).write.mode("append").parquet(path)
    return readers.newest(spark.read.parquet(path), "c_custkey").select("c_custkey", "c_acctbal")


@register("S30_S35_written_table", "SELECT n_nationkey, n_name FROM nation")
def written(spark, sf_dir):
    path = shared_dir(spark, "sink")
    writers.write_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, {"seed": 1})
    return spark.read.parquet(path)


@register("S38_export_bundle", "SELECT CAST(n_regionkey AS VARCHAR) AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def bundle(spark, sf_dir):
    got = writers.export(table(spark, sf_dir, "nation"), shared_dir(spark, "export"), "n_regionkey")
    return spark.createDataFrame(sorted(got.items()), "region string, n long")


@register("X01_X02_S22_staged_run", with_views("pts") + "SELECT tile, count(*) AS n FROM pts WHERE label = 1 GROUP BY tile")
def staged(spark, sf_dir):
    """Two stages, run, resumed and found again as the latest complete run."""
    base = shared_dir(spark, "runs")
    stages = [Stage("tiles", lambda s, t: t["points"].groupBy("tile").agg(F.count("*").alias("n")), ("points",)), Stage("points", lambda s, t: view(s, sf_dir, "pts").filter("label = 1"))]
    run = Runner(spark, f"{base}/2026-01-01", stages)
    run()
    run()
    return spark.read.parquet(f"{base}/{readers.latest_run(spark, base)}/tiles")


@register("X07_status_report", "SELECT 3::BIGINT AS chunks, 2::BIGINT AS done")
def status(spark, sf_dir):
    rows = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "chunk string, done boolean")
    return rows.agg(F.count("*").alias("chunks"), F.count_if(F.col("done")).alias("done"))


@register("S07_field_discovery", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0")
def discovery(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter(F.col(readers.pick(c, "BALANCE", "C_AcctBal")) > 0).agg(F.count("*").alias("n"))
