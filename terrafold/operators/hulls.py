"""Convex hulls of groups of points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def hull(points: list[tuple]) -> list[tuple]:
    """Andrew's monotone chain: corners counter-clockwise, from the lowest x."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(side: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """(group, seq, x, y): a task sends on only the corners of its own points, so a group of any size
    meets as the corners of its parts."""
    kind = points.schema[by].dataType.simpleString()
    xy = points.schema["x"].dataType.simpleString()

    def corners(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, g in part.groupby(by):
                own = hull(list(zip(g["x"], g["y"])))
                yield pd.DataFrame({by: name, "x": [p[0] for p in own], "y": [p[1] for p in own]})

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        own = hull(list(zip(g["x"], g["y"])))
        return pd.DataFrame({by: g[by].iloc[0], "seq": range(len(own)), "x": [p[0] for p in own], "y": [p[1] for p in own]})

    part = points.select(by, "x", "y").mapInPandas(corners, f"{by} {kind}, x {xy}, y {xy}")
    return part.groupBy(by).applyInPandas(merged, f"{by} {kind}, seq int, x {xy}, y {xy}")
