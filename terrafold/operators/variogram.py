"""Empirical semivariograms over all pairs of a bounded sample, and their fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a variogram; the pairs of this many are what it costs, whatever the table's size.
MAX_POINTS = 20_000


def sampled(points: DataFrame, key: str, n: int = MAX_POINTS, seed: int = 1) -> DataFrame:
    """All points, or n of them by a hash of the key."""
    if points.count() <= n:
        return points
    return points.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def semivariogram(points: DataFrame, key: str, columns: list[str], lag: float, max_lag: float) -> DataFrame:
    """(column, bin, pairs, gamma) over pairs closer than max_lag; bin k holds distances in [k lag, (k + 1) lag).

    The sample, bounded by MAX_POINTS rows, is sent to every task; a task takes its rows against those
    with a greater key and returns sums by bin. Nulls take no part in a column's pairs.
    """
    n_bins = int(np.ceil(max_lag / lag))
    own = points.select(F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
    table = own.toPandas()
    if len(table) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points; sample first")
    sent = points.sparkSession.sparkContext.broadcast((table["k"].to_numpy(), table[["x", "y"]].to_numpy(float), table[columns].to_numpy(float)))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, xy, z = sent.value
        total, count = np.zeros((len(columns), n_bins)), np.zeros((len(columns), n_bins))
        for part in parts:
            for row in part.itertuples(index=False):
                later = keys > row[0]
                d = np.hypot(xy[later, 0] - row[1], xy[later, 1] - row[2])
                good = d < max_lag
                b = np.minimum((d[good] / lag).astype(int), n_bins - 1)
                for c in range(len(columns)):
                    diff = (z[later][good, c] - row[3 + c]) ** 2
                    ok = ~np.isnan(diff)
                    total[c] += np.bincount(b[ok], diff[ok], n_bins)
                    count[c] += np.bincount(b[ok], minlength=n_bins)
        yield pd.DataFrame({"column": np.repeat(columns, n_bins), "bin": np.tile(np.arange(n_bins), len(columns)), "s": total.ravel(), "n": count.ravel().astype("int64")})

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = own.repartition(parts).mapInPandas(scan, "column string, bin int, s double, n long").groupBy("column", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("pairs"))
    return sums.filter("pairs > 0").select("column", "bin", "pairs", (F.col("s") / (2 * F.col("pairs"))).alias("gamma"))


def fit(h: np.ndarray, gamma: np.ndarray, n: np.ndarray, lag: float, max_lag: float) -> tuple[str, float, float, float, float, str]:
    """(model, nugget, psill, a, effective range, note), least squares with weights n / h^2; nugget and psill >= 0.

    For a fixed a, the model is linear in nugget and psill; a comes from a grid and a golden section.
    """
    w = np.sqrt(n / h**2)
    shapes = {"spherical": lambda a: np.where(h < a, 1.5 * h / a - 0.5 * (h / a) ** 3, 1.0), "exponential": lambda a: 1 - np.exp(-h / a)}

    def solved(f: np.ndarray) -> tuple[float, float, float]:
        best = (np.inf, 0.0, 0.0)
        both = np.linalg.lstsq(np.stack((w, w * f), 1), w * gamma, rcond=None)[0]
        for c0, c1 in (both, (float((w * w * gamma).sum() / (w * w).sum()), 0.0), (0.0, float((w * w * f * gamma).sum() / max((w * w * f * f).sum(), 1e-300)))):
            if c0 >= 0 and c1 >= 0:
                best = min(best, (float(((w * (c0 + c1 * f - gamma)) ** 2).sum()), float(c0), float(c1)))
        return best

    out = None
    for name, shape in shapes.items():
        grid = np.geomspace(lag / 10, 10 * max_lag, 200)
        errors = [solved(shape(a))[0] for a in grid]
        i = int(np.argmin(errors))
        low, high, g = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)], (5**0.5 - 1) / 2
        for _ in range(80):
            p, q = high - g * (high - low), low + g * (high - low)
            low, high = (low, q) if solved(shape(p))[0] < solved(shape(q))[0] else (p, high)
        a = (low + high) / 2
        err, c0, c1 = solved(shape(a))
        own = (err, name, c0, c1, float(a), float(a * np.log(20) if name == "exponential" else 0.8113 * a))
        out = own if out is None or own < out else out
    _, name, c0, c1, a, reach = out
    if c1 < 0.01 * (c0 + c1):
        return name, c0, c1, a, 0.0, "pure nugget (no spatial structure)"
    rising = a >= 0.99 * 10 * max_lag or reach > max_lag
    return name, c0, c1, a, reach, "beyond the lags (still rising at the largest lag)" if rising else ""
