"""Scores of many models on labelled points: accuracy, F1, AUROC, per tile and pooled.

Scores are long tables (model, point, p); a model is a group, so any number of models and points
goes through one exchange by model (and tile), reduced map-side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_class_score(p: Column, y: Column) -> Column:
    """The probability that a model gives to the true class."""
    return F.when(y == 1, p).otherwise(1 - p)


def correct(s: Column, y: Column) -> Column:
    """At a half, the prediction is 0."""
    return (s > 0.5) | ((s == 0.5) & (y == 0))


def predicts_positive(s: Column, y: Column) -> Column:
    return F.when(y == 1, s > 0.5).otherwise(s < 0.5)


def probability(s: Column, y: Column) -> Column:
    """p back from the true-class score; equal scores stay equal."""
    return F.when(y == 1, 1 - (1 - s)).otherwise(1 - s)


def _counts(s: Column, y: Column) -> dict[str, Column]:
    hit, up, is_pos = correct(s, y), predicts_positive(s, y), y == 1
    found = {"n_correct": hit, "tp": up & is_pos, "fp": up & ~is_pos, "fn": ~up & is_pos, "n_pos": is_pos}
    return {"n": F.count("*"), **{k: F.sum(F.when(c, 1).otherwise(0)) for k, c in found.items()}}


def _rates(table: DataFrame) -> DataFrame:
    return table.withColumns({"acc": F.col("n_correct") / F.col("n"), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def pooled(scores: DataFrame, by: list[str], s: str = "s", y: str = "y") -> DataFrame:
    """n, acc and f1 (null without positives or predicted positives) for each group."""
    return _rates(scores.groupBy(*by).agg(*[c.alias(k) for k, c in _counts(F.col(s), F.col(y)).items()]))


def auroc(scores: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Mann-Whitney AUROC with average ranks for ties; null where a class is missing.

    Equal probabilities are summed first, so the ranking sorts distinct values, not rows.
    """
    kinds = scores.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("n1"))
    below = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ranked = kinds.withColumn("rank2", 2 * F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") + 1)
    total = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("rank2") * F.col("n1")).alias("r2"))
    u2 = F.col("r2") - F.col("n1") * (F.col("n1") + 1)
    return total.select(*by, F.try_divide(u2, 2 * F.col("n1") * (F.col("n") - F.col("n1"))).alias("auc"))


def rates_of(p: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """n, n_correct, tp, fp and auc of pooled() and auroc() for one group's arrays; a missing p (NaN) counts and ranks as
    null does there, and auc is NaN where a class is missing."""
    pos, known, none = y == 1, ~np.isnan(y), np.isnan(p)
    s = np.where(pos, p, 1 - p)
    up = np.where(pos, s > 0.5, s < 0.5)
    _, at, n = np.unique(np.where(none, -1.0, p), return_inverse=True, return_counts=True)
    rank2 = 2 * (n.cumsum() - n) + n + 1
    n1 = int(pos.sum())
    u2, pairs2 = int(rank2[at[pos]].sum()) - n1 * (n1 + 1), 2 * n1 * (len(y) - n1)
    counts = {"n": len(y), "n_correct": (s > 0.5) | ((s == 0.5) & (y == 0)), "tp": up & pos, "fp": up & ~pos & known}
    return {**{k: int(np.sum(v)) for k, v in counts.items()}, "auc": float(u2) / float(pairs2) if pairs2 else np.nan}


def per_tile(scores: DataFrame, half: str = "half", tile: str = "tile", model: str = "model") -> DataFrame:
    """A row for each tile and model with acc, f1 and auc of both halves; null where not defined:
    acc needs both halves, f1 a positive in both, auc both classes in both."""
    keys = [half, tile, model]
    # One pass over the scores: counts by probability, ranked and summed by group, halves side by side
    counts = _counts(F.col("s"), F.col("y"))
    kinds = scores.groupBy(*keys, "p").agg(*[c.alias(k) for k, c in counts.items()])
    below = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = kinds.withColumn("r2", (2 * F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") + 1) * F.col("n_pos"))
    table = _rates(ranked.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in (*counts, "r2")]))
    u2 = F.col("r2") - F.col("n_pos") * (F.col("n_pos") + 1)
    table = table.withColumn("auc", F.try_divide(u2, 2 * F.col("n_pos") * (F.col("n") - F.col("n_pos"))))
    names = ("n", "n_pos", "acc", "f1", "auc")
    out = table.groupBy(tile, model).agg(*[F.max(F.when(F.col(half) == h, F.col(c))).alias(f"{c}_{h}") for h in ("id", "ood") for c in names])
    out = out.filter("n_id IS NOT NULL AND n_ood IS NOT NULL")
    both = (F.col("n_pos_id") > 0) & (F.col("n_pos_ood") > 0)
    mixed = both & (F.col("n_pos_id") < F.col("n_id")) & (F.col("n_pos_ood") < F.col("n_ood"))
    return out.select(
        tile,
        model,
        (F.col("acc_id") - F.col("acc_ood")).alias("acc_delta"),
        F.when(both, F.col("f1_id") - F.col("f1_ood")).alias("f1_delta"),
        F.when(mixed, F.col("auc_id") - F.col("auc_ood")).alias("auc_delta"),
    )


def prediction_keys(scores: DataFrame, point: str, half: str = "half", model: str = "model") -> DataFrame:
    """(model, n, up, key): the number of predictions, of positive ones, and the digest of all in the order of half and
    point. A model's predictions meet in one group: one bit a test point."""
    up = predicts_positive(F.col("s"), F.col("y"))
    row = F.struct(half, point, F.when(up, "1").otherwise("0").alias("bit"))
    t = scores.groupBy(model).agg(F.array_sort(F.collect_list(row)).alias("b"), F.count("*").alias("n"), F.count_if(up).alias("up"))
    return t.select(model, "n", "up", F.sha2(F.array_join("b.bit", ""), 256).alias("key"))


def states(scores: DataFrame, point: str, half: str = "half", model: str = "model") -> DataFrame:
    """(model, degenerate, duplicate_of): a degenerate model predicts one class for over 19 in 20 points (equality is kept);
    of the others, one that repeats an earlier one's predictions names the first that has them."""
    t = prediction_keys(scores, point, half, model).select(model, "key", F.expr("20 * up < n OR 20 * up > 19 * n").alias("degenerate"))
    first = F.first(model).over(Window.partitionBy("degenerate", "key").orderBy(model))
    return t.select(model, "degenerate", F.when(~F.col("degenerate") & (first != F.col(model)), first).alias("duplicate_of"))


def interpolated(curves: DataFrame, by: str, x: str, y: str, low: float, high: float, steps: int = 101) -> DataFrame:
    """(by, step, y): each curve, linear between its points, on a grid of ``steps`` values from low to high that all curves
    span. Every piece gives the values of the grid that lie on it, so nothing is joined; points of one x are averaged."""
    one = curves.groupBy(by, x).agg(F.avg(y).alias("__y"))
    order = Window.partitionBy(by).orderBy(x)
    pieces = one.withColumns({"__x1": F.lead(x).over(order), "__y1": F.lead("__y").over(order)}).filter("__x1 IS NOT NULL")
    gap = (high - low) / (steps - 1)
    at = F.lit(low) + F.col("step") * F.lit(gap)
    bound = lambda c: F.greatest(F.lit(0), F.least(F.lit(steps - 1), c)).cast("int")
    spread = pieces.withColumn("step", F.explode(F.sequence(bound(F.floor((F.col(x) - low) / gap) - 1), bound(F.ceil((F.col("__x1") - low) / gap) + 1))))
    at = F.when(F.col("step") == steps - 1, F.lit(high)).otherwise(at)
    on = spread.filter((F.col(x) <= at) & (at <= F.col("__x1")))
    value = F.col("__y") + (F.col("__y1") - F.col("__y")) * (at - F.col(x)) / (F.col("__x1") - F.col(x))
    return on.groupBy(by, "step").agg(F.max_by(value, x).alias(y))


def matched(curves: DataFrame, by: str, x: str, y: str, first: str, second: str) -> DataFrame:
    """One row: the difference of two curves (first less second) over the x that both reach, as mean, least and greatest, the
    share of the grid where the first is lower, and which of them is lower on four fifths of it (null: neither).
    Without an overlap all are null. Four numbers reach the driver."""
    two = curves.filter(F.col(by).isin(first, second) & F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = two.groupBy(by).agg(F.min(x).alias("a"), F.max(x).alias("b")).agg(F.max("a"), F.min("b"), F.count("*")).first()
    low, high = ends[0], ends[1]
    if ends[2] < 2 or high <= low:
        two, low, high = two.limit(0), 0.0, 1.0
    side = lambda name: F.max(F.when(F.col(by) == name, F.col(y)))
    d = interpolated(two, by, x, y, float(low), float(high)).groupBy("step").agg((side(first) - side(second)).alias("d"))
    t = d.agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("greatest"), F.avg((F.col("d") < 0).cast("double")).alias("share"))
    return t.withColumn("stronger", F.when(F.col("share") >= 0.8, first).when(F.col("share") <= 0.2, second))


def tile_delta(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """Mean over models for each tile, with null where no model has it."""
    return tiles.groupBy(tile).agg(*[F.avg(f"{m}_delta").alias(f"{m}_delta") for m in ("acc", "f1", "auc")])


def holm(table: DataFrame, p: str, out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment; for a table of tests, which is small by nature."""
    order = Window.orderBy(p)
    n = table.count()
    step = table.withColumn("__r", F.row_number().over(order)).withColumn("__v", F.least(F.lit(1.0), (n - F.col("__r") + 1) * F.col(p)))
    return step.withColumn(out, F.max("__v").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__v")


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def epsilon_correlation(df: DataFrame, by: list[str], a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """Pearson r from population moments with eps added to each variance."""
    return df.groupBy(*by).agg((F.covar_pop(a, b) / F.sqrt((F.var_pop(a) + eps) * (F.var_pop(b) + eps))).alias("r"), F.count("*").alias("n"))
