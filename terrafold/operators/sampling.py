"""Constrained sampling: quotas, rejection placement, minimum-separation thinning, splits.

Random draws come from hashes of the row's key and a seed, so a lost task draws the same again and
another engine can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spatial import box_cells, cell, pairs_within
from .storage import settled


class SupplyError(RuntimeError):
    """Too few valid candidates."""


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the md5 of the keys and the seed (the first 13 hex digits)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def quota(weights: list[float], n: int, rng: np.random.Generator, cap: int | None = None) -> np.ndarray:
    """Multinomial counts; weights that aren't positive and finite count as 0. With a cap, the excess is
    drawn once more among the groups below it."""
    w = np.array([x if np.isfinite(x) and x > 0 else 0.0 for x in weights])
    if not w.sum():
        raise SupplyError("no positive weight")
    out = rng.multinomial(n, w / w.sum())
    if cap is not None and (over := int(np.maximum(out - cap, 0).sum())):
        out = np.minimum(out, cap)
        w = np.where(out < cap, w, 0.0)
        if w.sum():
            out += rng.multinomial(over, w / w.sum())
    return out


#: Pairs of close rows that a batch of thin() is expected to have at most.
PAIRS = 20_000_000


def apart(points: DataFrame, others: DataFrame, distance: float, where: Column | None = None) -> DataFrame:
    """The points that none of the others (whose columns have the suffix _2 in ``where``) is closer to than the distance."""
    left = points.withColumns({"cx": cell(F.col("x"), distance), "cy": cell(F.col("y"), distance)})
    x, y = F.col("x_2"), F.col("y_2")
    right = box_cells(others.select(*[F.col(c).alias(f"{c}_2") for c in others.columns]), x - distance, y - distance, x + distance, y + distance, distance)
    right = right.withColumnsRenamed({"cx": "cx_2", "cy": "cy_2"})
    dx, dy = F.col("x") - x, F.col("y") - y
    near = (F.col("cx") == F.col("cx_2")) & (F.col("cy") == F.col("cy_2")) & (dx * dx + dy * dy < distance * distance)
    return left.join(right.hint("merge"), near if where is None else near & where, "left_anti").drop("cx", "cy")


def thin(points: DataFrame, key: str, distance: int, priority: str) -> DataFrame:
    """The rows that a sweep in the order of priority (a number) keeps, if it keeps a row unless one kept is closer
    than the distance.

    The sweep goes in batches, of as many rows as have about PAIRS close pairs. What a batch keeps takes the later rows
    that are close to it; as kept rows are apart, few rows are left after a batch or two, however dense they lie.
    """
    rest, kept = settled(points.filter(F.col(key).isNotNull()).select(key, "x", "y", priority)), None
    while True:
        crowds = rest.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(cell(F.col("x"), distance), cell(F.col("y"), distance)).agg(F.count("*").cast("double").alias("n"))
        pairs = 1.5 * (crowds.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0)
        # Pairs go with the square of the share of the rows.
        cut = None if pairs <= PAIRS else rest.agg(F.percentile_approx(priority, math.sqrt(PAIRS / pairs), 10_000)).first()[0]
        first = F.lit(True) if cut is None else F.col(priority).isNull() | (F.col(priority) <= F.lit(cut))
        stay = settled(_swept(rest.filter(first), key, distance, priority))
        kept = stay if kept is None else kept.unionByName(stay)
        if cut is not None:
            rest = settled(apart(rest.filter(~first), stay, distance))
        if cut is None or rest.isEmpty():
            return points.join(kept.select(key), key, "left_semi").unionByName(points.filter(F.col(key).isNull()))


def _swept(points: DataFrame, key: str, distance: int, priority: str) -> DataFrame:
    """thin() over all close pairs. In each round, a row before all its undecided neighbours stays and its neighbours go. The
    result is the sweep's; expected rounds grow with the logarithm of the number of rows."""
    near = pairs_within(points, key, distance, keep=(priority,))
    pairs = settled(
        near.select(F.when(F.struct(f"{priority}_a", "a") < F.struct(f"{priority}_b", "b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("p")).select(F.col("p.a").alias("first"), F.col("p.b").alias("then"))
    )
    gone = None
    for _ in range(64):
        if pairs.isEmpty():
            break
        later = pairs.select("then").distinct()
        stay = pairs.select("first").distinct().join(later, F.col("first") == F.col("then"), "left_anti")
        lost = settled(pairs.join(stay, "first", "left_semi").select("then").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        left = pairs.join(lost.withColumnRenamed("then", "x1"), F.col("first") == F.col("x1"), "left_anti").join(lost.withColumnRenamed("then", "x2"), F.col("then") == F.col("x2"), "left_anti")
        pairs = settled(left)
    else:
        raise SupplyError("thinning did not end in 64 rounds")
    return points if gone is None else points.join(gone.select(F.col("then").alias(key)), key, "left_anti")


def place(polygons: DataFrame, need: str, seed: int, holds: Column, rounds: int = 30, fill: str = "fill") -> DataFrame:
    """``need`` points in each polygon by rejection in its bounds: 2 / fill proposals a missing point each
    round. polygons: poly, x0, y0, x1, y1, the share ``fill`` of the bounds and what ``holds`` reads."""
    left, out = polygons.withColumn("__missing", F.col(need)), None
    for r in range(rounds):
        n = F.ceil(2 * F.col("__missing") / F.greatest(fill, F.lit(0.002))).cast("int")
        tries = left.filter("__missing > 0").withColumn("__try", F.explode(F.sequence(F.lit(1), n)))
        u, v = uniform(seed + 2 * r, "poly", "__try"), uniform(seed + 2 * r + 1, "poly", "__try")
        tries = tries.withColumns({"x": F.floor(F.col("x0") + u * (F.col("x1") - F.col("x0"))), "y": F.floor(F.col("y0") + v * (F.col("y1") - F.col("y0")))})
        hits = tries.filter(holds).withColumn("__n", F.row_number().over(Window.partitionBy("poly").orderBy("__try"))).filter("__n <= __missing")
        hits = settled(hits.select("poly", F.lit(r).alias("round"), F.col("__n").alias("hit"), "x", "y"))
        out = hits if out is None else out.unionByName(hits)
        got = hits.groupBy("poly").agg(F.count("*").alias("__got"))
        left = settled(left.join(got, "poly", "left").withColumn("__missing", F.col("__missing") - F.coalesce("__got", F.lit(0))).drop("__got").filter("__missing > 0"))
        if left.isEmpty():
            return out
    raise SupplyError(f"polygons short of points after {rounds} rounds: {left.count()}")


def draw_valid(spark: SparkSession, n: int, propose: Callable[[int, int], DataFrame], valid: Callable[[DataFrame], DataFrame], seed: int, first: int, limit: int = 5_000_000) -> DataFrame:
    """Exactly n valid candidates: batches until enough are valid, then a random n of the pool.

    The next batch is the shortfall over the share of valid ones so far, and a fifth more, up to ten
    times the last and up to the limit. SupplyError after 20 batches, or with none in 100 n proposals.
    """
    pool, made, have, size = None, 0, 0, first
    for batch in range(20):
        own = settled(valid(propose(size, batch)).withColumn("batch", F.lit(batch)))
        pool = own if pool is None else pool.unionByName(own)
        made += size
        have += own.count()
        if have >= n:
            pool = pool.withColumn("__u", uniform(seed, "batch", "candidate"))
            return pool.orderBy("__u", "batch", "candidate").limit(n).drop("__u")
        if not have and made >= 100 * n:
            raise SupplyError("no valid candidate")
        size = int(min(size * 10, limit, (n - have) / max(have / made, 1e-9) * 1.2 + 1))
    raise SupplyError(f"{have} of {n} candidates after 20 batches")


def split(n: int, seed: int = 42) -> dict[str, list[int]]:
    """60/20/20 by two seeded permutations."""
    order = np.random.RandomState(seed).permutation(n)
    n_test = int(np.ceil(0.2 * n))
    rest = order[n_test:]
    again = np.random.RandomState(seed).permutation(len(rest))
    n_val = int(np.ceil(0.25 * len(rest)))
    return {"train": sorted(rest[again[n_val:]].tolist()), "val": sorted(rest[again[:n_val]].tolist()), "test": sorted(order[:n_test].tolist())}


def split_tiles(points: DataFrame, tile: str, zone: str, label: str, seed: int, share: float = 0.30) -> DataFrame:
    """(tile, part) of a seeded split by tiles, which all models of a cell share.

    Of the tiles in a random order (by a hash of the seed and the tile), the first ``share``, three at least, are candidates for
    the test; those with positives of two zones are its tiles, the other candidates belong to no part, and the rest
    is for training. Null tiles take no part.
    """
    tiles = settled(points.filter(F.col(tile).isNotNull()).select(tile).distinct())
    n = max(3, round(tiles.count() * share))
    first = tiles.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(tile))), tile).limit(n)
    zones = points.filter(F.col(label) == 1).groupBy(tile).agg(F.count_distinct(zone).alias("zones")).filter("zones = 2").select(tile)
    test = first.join(zones, tile, "left_semi").withColumn("part", F.lit("test"))
    return test.unionByName(tiles.join(first, tile, "left_anti").withColumn("part", F.lit("train")))
