"""Neighbour graphs: components, purity, smoothing and quadratic forms, as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled


def symmetric(directed: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every edge once, without loops."""
    own = directed.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.count("*").alias("degree"))


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root is the least node of its component.

    Alternating star contraction: every round hangs neighbours on the least one, and the rounds grow
    with the logarithm of the longest path. Each round's edges are written to the shared folder.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        # Large star: each node hangs its greater neighbours on its least neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        # Small star: each node hangs its lesser neighbours, and itself, on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("w"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("w").alias("v"))
        now = settled(small.filter("u <> v").distinct())
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = digest


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, root): the least node of each node's component; a node without edges is its own."""
    return nodes.join(contracted(edges).withColumnRenamed("node", node), node, "left").select(node, F.coalesce("root", node).alias("root"))


def ranked(parts: DataFrame, node: str = "node", least: int = 1) -> DataFrame:
    """Components numbered from 0 by size, then by the least node, with at least ``least`` nodes."""
    sizes = parts.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    number = F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1
    return parts.join(sizes.withColumn("component", number), "root").select(node, "root", "size", "component")


def coherence(selected: DataFrame, edges: DataFrame, least: int, node: str = "node") -> DataFrame:
    """One row for a subset of the nodes: its components of ``least`` nodes or more under the edges within it, the nodes they
    hold, and all its pieces."""
    own = selected.select(F.col(node).alias("a"))
    inner = edges.join(own, "a", "left_semi").join(own.withColumnRenamed("a", "b"), "b", "left_semi")
    return pieces(components(selected, inner, node), least)


def pieces(parts: DataFrame, least: int) -> DataFrame:
    """coherence() of known components (node, root)."""
    sizes = parts.groupBy("root").agg(F.count("*").alias("n"))
    big = F.col("n") >= least
    return sizes.agg(F.count_if(big).alias("components"), F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).cast("long").alias("comp_points"), F.count("*").alias("pieces"))


def quadratic(edges: DataFrame, values: DataFrame, node: str = "node", value: str = "z") -> DataFrame:
    """Laplacian form and total variation over undirected edges (a < b)."""
    left = values.select(F.col(node).alias("a"), F.col(value).alias("za"))
    right = values.select(F.col(node).alias("b"), F.col(value).alias("zb"))
    d = F.col("za") - F.col("zb")
    return edges.filter("a < b").join(left, "a").join(right, "b").agg(F.sum(d * d).alias("laplacian"), F.sum(F.abs(d)).alias("variation"))


def purity(directed: DataFrame, selected: DataFrame, node: str = "node") -> DataFrame:
    """Mean over the selected nodes of the share of their own neighbours that are selected."""
    own = directed.join(selected.select(F.col(node).alias("a")), "a", "left_semi")
    marked = own.join(selected.select(F.col(node).alias("b"), F.lit(1.0).alias("in")), "b", "left")
    return marked.groupBy("a").agg(F.avg(F.coalesce("in", F.lit(0.0))).alias("share")).agg(F.avg("share").alias("purity"))


def smoothed(edges: DataFrame, values: DataFrame, node: str = "node", value: str = "q") -> DataFrame:
    """(I + D)^-1 (I + A) applied to the values."""
    near = edges.join(values.select(F.col(node).alias("b"), F.col(value).alias("qb")), "b").groupBy("a").agg(F.sum("qb").alias("s"), F.count("*").alias("d"))
    return smooth(values, near.withColumnRenamed("a", node), node, value)


def smooth(values: DataFrame, near: DataFrame, node: str = "node", value: str = "q") -> DataFrame:
    """smoothed() by the sums (s) and numbers (d) of the neighbours' values."""
    joined = values.join(near, node, "left")
    return joined.select(node, ((F.col(value) + F.coalesce("s", F.lit(0))) / (1 + F.coalesce("d", F.lit(0)))).alias("smooth"))
