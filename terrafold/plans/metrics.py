"""Queries of the model metrics: pooled, per tile, tests and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import fisher_interval, probit, t_quantile, wilcoxon
from ..operators import metrics as M
from ..operators import sampling as RS
from ..registry import register
from ..sources.proxies import view, with_views

#: The split of the tiles that all metric queries share (R10), as SQL: ordered tiles, test tiles, tiles of training.
SPLIT = """
rt AS (SELECT tile, row_number() OVER (ORDER BY md5('3|' || tile), tile) > greatest(3, round_even(count(*) OVER () * 0.3::DOUBLE, 0)) AS train FROM (SELECT DISTINCT tile FROM pts WHERE tile IS NOT NULL)),
tt AS (SELECT tile FROM pts JOIN rt USING (tile) WHERE label = 1 AND NOT train GROUP BY tile HAVING count(DISTINCT dom) = 2),
ct AS (SELECT tile FROM rt WHERE train)"""
_TILES = SPLIT + """,
sc AS (
  SELECT s.model, s.pid, s.p8 / 8.0::DOUBLE AS p, p.label AS y, p.tile, p.dom, CASE WHEN p.dom = 'A' THEN 'id' ELSE 'ood' END AS half,
         CASE WHEN p.label = 1 THEN s.p8 / 8.0::DOUBLE ELSE 1 - s.p8 / 8.0::DOUBLE END AS s
  FROM scores s JOIN pts p USING (pid) SEMI JOIN tt USING (tile))"""
SC = with_views("pts", "scores") + "," + _TILES


def tiles_of(pts: DataFrame, part: str) -> DataFrame:
    """The tiles of the split's "train" or "test" part."""
    return RS.split_tiles(pts, "tile", "dom", "label", 3).filter(F.col("part") == part).select("tile")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test tiles, joined with labels: zone A is the ID half, AE the OOD half."""
    pts = view(spark, sf_dir, "pts")
    own = pts.join(tiles_of(pts, "test"), "tile", "left_semi").select("pid", F.col("label").alias("y"), "tile", "dom", F.when(F.col("dom") == "A", "id").otherwise("ood").alias("half"))
    s = view(spark, sf_dir, "scores").withColumn("p", F.col("p8") / F.lit(8.0))
    return s.join(own, "pid").withColumn("s", M.true_class_score(F.col("p"), F.col("y")))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("A18_pooled_metrics", SC + """
SELECT model, half, count(*) AS n, round(avg(CASE WHEN s > 0.5 OR (s = 0.5 AND y = 0) THEN 1.0 ELSE 0.0 END), 6) AS acc,
  round(2.0 * count(*) FILTER (y = 1 AND s > 0.5) / nullif(2 * count(*) FILTER (y = 1 AND s > 0.5) + count(*) FILTER (y = 0 AND s < 0.5) + count(*) FILTER (y = 1 AND NOT s > 0.5), 0), 6) AS f1
FROM sc GROUP BY model, half""")
def pooled(spark, sf_dir):
    return rounded(M.pooled(scored(spark, sf_dir), ["model", "half"]).select("model", "half", "n", "acc", "f1"), "acc", "f1")


_AUC = """
rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r FROM sc),
au AS (SELECT {by}, count(*) AS n, sum(y) AS n1, sum(CASE WHEN y = 1 THEN r END) AS rs FROM rk GROUP BY {by})"""


@register("A19_auroc", SC + "," + _AUC.format(by="model, half") + """
SELECT model, half, round(CAST((rs - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0) AS DOUBLE), 6) AS auc FROM au""")
def auroc(spark, sf_dir):
    return rounded(M.auroc(scored(spark, sf_dir), ["model", "half"]), "auc")


_PER_TILE = SC + "," + _AUC.format(by="half, tile, model") + """,
g AS (
  SELECT half, tile, model, count(*) AS n, sum(y) AS np, avg(CASE WHEN s > 0.5 OR (s = 0.5 AND y = 0) THEN 1.0 ELSE 0.0 END) AS acc,
    2.0 * count(*) FILTER (y = 1 AND s > 0.5) / nullif(2 * count(*) FILTER (y = 1 AND s > 0.5) + count(*) FILTER (y = 0 AND s < 0.5) + count(*) FILTER (y = 1 AND NOT s > 0.5), 0) AS f1
  FROM sc GROUP BY half, tile, model),
w AS (SELECT g.*, CAST((rs - n1 * (n1 + 1) / 2.0) / nullif(n1 * (au.n - n1), 0) AS DOUBLE) AS auc FROM g JOIN au USING (half, tile, model)),
pt AS (
  SELECT a.tile, a.model, a.acc - b.acc AS acc_delta, CASE WHEN a.np > 0 AND b.np > 0 THEN a.f1 - b.f1 END AS f1_delta,
    CASE WHEN a.np > 0 AND b.np > 0 AND a.np < a.n AND b.np < b.n THEN a.auc - b.auc END AS auc_delta
  FROM (SELECT * FROM w WHERE half = 'id') a JOIN (SELECT * FROM w WHERE half = 'ood') b USING (tile, model)),
td AS (SELECT tile, avg(acc_delta) AS acc_delta, avg(f1_delta) AS f1_delta, avg(auc_delta) AS auc_delta FROM pt GROUP BY tile)"""


@register("A20_per_tile_metrics", _PER_TILE + """
SELECT tile, model, round(acc_delta, 6) AS acc_delta, round(f1_delta, 6) AS f1_delta, round(auc_delta, 6) AS auc_delta FROM pt""")
def per_tile(spark, sf_dir):
    return rounded(M.per_tile(scored(spark, sf_dir)), "acc_delta", "f1_delta", "auc_delta")


@register("A21_tile_delta", _PER_TILE + """
SELECT tile, round(acc_delta, 6) AS acc_delta, round(f1_delta, 6) AS f1_delta, round(auc_delta, 6) AS auc_delta FROM td""")
def tile_delta(spark, sf_dir):
    return rounded(M.tile_delta(M.per_tile(scored(spark, sf_dir))), "acc_delta", "f1_delta", "auc_delta")


@register("A21b_delta_summary", _PER_TILE + """
SELECT round(avg(acc_delta), 6) AS acc_delta, round(avg(f1_delta), 6) AS f1_delta, round(avg(auc_delta), 6) AS auc_delta,
  count(*) FILTER (acc_delta > 0) AS tiles_worse, count(acc_delta) AS acc_tiles, count(f1_delta) AS f1_tiles, count(auc_delta) AS auc_tiles FROM td""")
def delta_summary(spark, sf_dir):
    t = M.tile_delta(M.per_tile(scored(spark, sf_dir)))
    names = ("acc", "f1", "auc")
    return t.agg(*[F.round(F.avg(f"{m}_delta"), 6).alias(f"{m}_delta") for m in names], F.count_if(F.col("acc_delta") > 0).alias("tiles_worse"), *[F.count(f"{m}_delta").alias(f"{m}_tiles") for m in names])


@register("O06_worst_tiles", _PER_TILE + "SELECT tile, round(acc_delta, 6) AS acc_delta FROM td ORDER BY round(acc_delta, 6), tile LIMIT 3")
def worst_tiles(spark, sf_dir):
    """A top-3 report."""
    t = rounded(M.tile_delta(M.per_tile(scored(spark, sf_dir))), "acc_delta")
    return t.select("tile", "acc_delta").orderBy("acc_delta", "tile").limit(3)


@register("A22_mode_county", with_views("pts") + """
SELECT tile, county, n FROM (SELECT tile, county, count(*) AS n, row_number() OVER (PARTITION BY tile ORDER BY count(*) DESC, county) AS k FROM pts GROUP BY tile, county) WHERE k = 1""")
def mode_county(spark, sf_dir):
    n = view(spark, sf_dir, "pts").groupBy("tile", "county").agg(F.count("*").alias("n"))
    best = n.groupBy("tile").agg(F.min(F.struct((-F.col("n")).alias("m"), "county", "n")).alias("b"))
    return best.select("tile", "b.county", "b.n")


@register("F12_F15_score_rules", SC + """
SELECT model, count(*) FILTER (s > 0.5 OR (s = 0.5 AND y = 0)) AS correct, count(*) FILTER (CASE WHEN y = 1 THEN s > 0.5 ELSE s < 0.5 END) AS positive,
  round(sum(CASE WHEN y = 1 THEN 1 - (1 - s) ELSE 1 - s END), 6) AS sum_p FROM sc GROUP BY model""")
def score_rules(spark, sf_dir):
    s, y = F.col("s"), F.col("y")
    return scored(spark, sf_dir).groupBy("model").agg(
        F.count_if(M.correct(s, y)).alias("correct"), F.count_if(M.predicts_positive(s, y)).alias("positive"), F.round(F.sum(M.probability(s, y)), 6).alias("sum_p")
    )


@register("F16_degenerate", SC + """
SELECT model, n, k, 20 * k < n OR 20 * k > 19 * n AS degenerate FROM (SELECT model, count(*) AS n, count(*) FILTER (CASE WHEN y = 1 THEN s > 0.5 ELSE s < 0.5 END) AS k FROM sc GROUP BY model)""")
def degenerate(spark, sf_dir):
    """A model that predicts one class for over 19 in 20 points; equality is kept."""
    t = scored(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.count_if(M.predicts_positive(F.col("s"), F.col("y"))).alias("k"))
    return t.withColumn("degenerate", F.expr("20 * k < n OR 20 * k > 19 * n"))


_KEY = SC + """,
k AS (SELECT model % 4 * 10 + model % 10 AS grid, model, string_agg(CASE WHEN CASE WHEN y = 1 THEN s > 0.5 ELSE s < 0.5 END THEN '1' ELSE '0' END, '' ORDER BY half, pid) AS bits FROM sc GROUP BY model)"""


@register("F17_prediction_key", _KEY + "SELECT model, length(bits) AS n_bits, sha256(bits) AS key FROM k")
def prediction_key(spark, sf_dir):
    """A digest of all predictions of a model, ID points first; long models stay within their own group."""
    return M.prediction_keys(scored(spark, sf_dir), "pid").select("model", F.col("n").alias("n_bits"), "key")


STATES = _KEY + """,
c AS (SELECT model, 20 * k < n OR 20 * k > 19 * n AS degenerate FROM (SELECT model, count(*) AS n, count(*) FILTER (CASE WHEN y = 1 THEN s > 0.5 ELSE s < 0.5 END) AS k FROM sc GROUP BY model)),
st AS (SELECT model, degenerate, CASE WHEN NOT degenerate AND f <> model THEN f END AS duplicate_of FROM (SELECT model, degenerate, first_value(model) OVER (PARTITION BY degenerate, bits ORDER BY model) AS f FROM k JOIN c USING (model)))"""


@register("W08_M06_duplicates", STATES + "SELECT model, duplicate_of FROM st")
def duplicates(spark, sf_dir):
    """Models that repeat the predictions of an earlier one that isn't degenerate, naming the first holder."""
    return M.states(scored(spark, sf_dir), "pid").select("model", "duplicate_of")


@register("A29_family_counts", STATES + """
SELECT model % 8 AS family, count(*) AS settings, count(*) FILTER (degenerate) AS degenerate, count(duplicate_of) AS duplicate, count(*) FILTER (NOT degenerate AND duplicate_of IS NULL) AS kept FROM st GROUP BY 1""")
def family_counts(spark, sf_dir):
    t = M.states(scored(spark, sf_dir), "pid").groupBy((F.col("model") % 8).alias("family"))
    return t.agg(F.count("*").alias("settings"), F.count_if("degenerate").alias("degenerate"), F.count("duplicate_of").alias("duplicate"), F.count_if(~F.col("degenerate") & F.col("duplicate_of").isNull()).alias("kept"))


_ACC = SC + """,
ac AS (SELECT model, half, avg(CASE WHEN s > 0.5 OR (s = 0.5 AND y = 0) THEN 1.0 ELSE 0.0 END) AS acc FROM sc GROUP BY model, half),
mm AS (SELECT a.model, a.acc AS acc_id, b.acc AS acc_ood FROM ac a JOIN ac b USING (model) WHERE a.half = 'id' AND b.half = 'ood')"""


def _halves(spark, sf_dir):
    t = M.pooled(scored(spark, sf_dir), ["model", "half"])
    return t.groupBy("model").agg(F.max(F.when(F.col("half") == "id", F.col("acc"))).alias("acc_id"), F.max(F.when(F.col("half") == "ood", F.col("acc"))).alias("acc_ood"))


@register("T04_epsilon_correlation", _ACC + "SELECT round(covar_pop(acc_id, acc_ood) / sqrt((var_pop(acc_id) + 1e-6) * (var_pop(acc_ood) + 1e-6)), 6) AS r, count(*) AS n FROM mm")
def epsilon_correlation(spark, sf_dir):
    return rounded(M.epsilon_correlation(_halves(spark, sf_dir), [], "acc_id", "acc_ood"), "r")


@register("T05_probit_correlation")
def probit_correlation(spark, sf_dir):
    """r between the models' probit accuracies, with Fisher's interval (DuckDB has no normal quantile)."""
    t = _halves(spark, sf_dir).select(probit(F.col("acc_id")).alias("a"), probit(F.col("acc_ood")).alias("b"))
    r = M.epsilon_correlation(t, [], "a", "b")
    low, high = fisher_interval(F.col("r"), F.col("n"))
    return r.withColumns({"low": low, "high": high})


@register("F24_fisher_interval", _ACC + """, r AS (SELECT corr(acc_id, acc_ood) AS r, count(*) AS n FROM mm)
SELECT round(tanh(atanh(greatest(least(r, 0.999999), -0.999999)) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(greatest(least(r, 0.999999), -0.999999)) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM r""")
def fisher(spark, sf_dir):
    low, high = fisher_interval(F.col("r"), F.col("n"))
    return _halves(spark, sf_dir).agg(F.corr("acc_id", "acc_ood").alias("r"), F.count("*").alias("n")).select(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("W09_spearman", _ACC + """,
rr AS (SELECT rank() OVER (ORDER BY acc_id) + (count(*) OVER (PARTITION BY acc_id) - 1) / 2.0 AS a, rank() OVER (ORDER BY acc_ood) + (count(*) OVER (PARTITION BY acc_ood) - 1) / 2.0 AS b FROM mm)
SELECT round(corr(a, b), 6) AS rho FROM rr""")
def spearman(spark, sf_dir):
    t = M.average_rank(M.average_rank(_halves(spark, sf_dir), [], "acc_id", "a"), [], "acc_ood", "b")
    return t.agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@register("W02_average_rank", with_views("scores") + """
SELECT model, pid, round(rank() OVER (PARTITION BY model ORDER BY p8) + (count(*) OVER (PARTITION BY model, p8) - 1) / 2.0::DOUBLE, 6) AS r FROM scores""")
def average_rank(spark, sf_dir):
    return rounded(M.average_rank(view(spark, sf_dir, "scores"), ["model"], "p8", "r").select("model", "pid", "r"), "r")


@register("W06_T03_holm", with_views("scores") + """,
p AS (SELECT model, sum(p8) / (3.0::DOUBLE * count(*) * 8) + model / 1000.0::DOUBLE AS p FROM scores GROUP BY model),
r AS (SELECT *, least(1.0, (40 - row_number() OVER (ORDER BY p) + 1) * p) AS v FROM p)
SELECT model, round(max(v) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm(spark, sf_dir):
    p = view(spark, sf_dir, "scores").groupBy("model").agg((F.sum("p8") / (F.lit(3.0) * F.count("*") * 8)).alias("p")).withColumn("p", F.col("p") + F.col("model") / F.lit(1000.0))
    return rounded(M.holm(p, "p").select("model", "p_holm"), "p_holm")


@register("T06_focus_tile", SC + """
SELECT half, round(count(*) FILTER (tile = '4_4') / count(*), 6) AS share, round(avg(CASE WHEN tile = '4_4' THEN CASE WHEN s > 0.5 OR (s = 0.5 AND y = 0) THEN 1.0 ELSE 0.0 END END), 6) AS acc FROM sc GROUP BY half""")
def focus_tile(spark, sf_dir):
    here, hit = F.col("tile") == "4_4", M.correct(F.col("s"), F.col("y"))
    return scored(spark, sf_dir).groupBy("half").agg(F.round(F.count_if(here) / F.count("*"), 6).alias("share"), F.round(F.avg(F.when(here, hit.cast("double"))), 6).alias("acc"))


@register("T01_t_interval")
def t_interval(spark, sf_dir):
    """Mean tile difference with its 95% t-interval (the quantile has no SQL); nulls are dropped."""
    t = M.tile_delta(M.per_tile(scored(spark, sf_dir)))
    out = None
    for m in ("acc", "f1", "auc"):
        row = t.agg(F.avg(f"{m}_delta").alias("mean"), F.stddev_samp(f"{m}_delta").alias("sd"), F.count(f"{m}_delta").alias("n"))
        n = row.first()["n"]
        q = t_quantile(0.975, n - 1) if n > 1 else None
        half = F.lit(q).cast("double") * F.col("sd") / F.sqrt("n")
        own = row.select(F.lit(m).alias("metric"), "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
        out = own if out is None else out.unionByName(own)
    return out


@register("T02_wilcoxon")
def signed_rank(spark, sf_dir):
    """Two-sided signed-rank test of the tile differences; one row a tile comes to the driver."""
    t = M.tile_delta(M.per_tile(scored(spark, sf_dir))).filter("acc_delta IS NOT NULL").withColumn("acc_delta", F.round("acc_delta", 9))
    zero = t.filter("acc_delta = 0").count()
    ranks = M.average_rank(t.filter("acc_delta <> 0").withColumn("d", F.abs("acc_delta")), [], "d", "r").select("r", F.col("acc_delta") > 0).collect()
    return spark.createDataFrame([(len(ranks), wilcoxon([tuple(r) for r in ranks], zero))], "n int, p double")


@register("P05_train_id_ood_sets", with_views("pts") + "," + SPLIT + """
SELECT st, n, n_pos FROM (
 SELECT 'train' AS st, count(*) AS n, sum(label)::BIGINT AS n_pos FROM pts SEMI JOIN ct USING (tile) WHERE dom = 'A' AND (label = 1 OR protocol = 'band')
 UNION ALL SELECT 'id', count(*), sum(label)::BIGINT FROM pts SEMI JOIN tt USING (tile) WHERE dom = 'A' AND (label = 1 OR protocol = 'band')
 UNION ALL SELECT 'ood', count(*), sum(label)::BIGINT FROM pts SEMI JOIN tt USING (tile) WHERE dom = 'AE' AND (label = 1 OR protocol = 'band'))""")
def split_sets(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    tests, train = tiles_of(pts, "test"), tiles_of(pts, "train")
    usable = pts.filter("label = 1 OR protocol = 'band'")
    out = None
    for name, dom, tiles in (("train", "A", train), ("id", "A", tests), ("ood", "AE", tests)):
        own = usable.filter(F.col("dom") == dom).join(tiles, "tile", "left_semi").agg(F.lit(name).alias("st"), F.count("*").alias("n"), F.sum("label").alias("n_pos"))
        out = own if out is None else out.unionByName(own)
    return out


@register("R10_test_tiles", with_views("pts") + "," + SPLIT + " SELECT tile FROM tt")
def tiles_of_test(spark, sf_dir):
    return tiles_of(view(spark, sf_dir, "pts"), "test")
