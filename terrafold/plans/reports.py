"""Queries of reports, exports, checks and small readers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.distributions import fisher_interval, probit
from ..operators import metrics as M
from ..operators import sampling as RS
from ..operators.storage import shared_dir
from ..registry import register
from ..sources import readers, synthetic, writers
from ..sources.proxies import table, view, with_views
from .metrics import SC, scored

_P = [i / 200 for i in range(201)]


@register("F22_probit", "SELECT * FROM (VALUES " + ", ".join(f"({i}, round({NormalDist().inv_cdf(min(max(p, 1e-6), 1 - 1e-6))!r}::DOUBLE, 9))" for i, p in enumerate(_P)) + ") t(i, z)")
def probits(spark, sf_dir):
    """The normal quantile on a grid, against an independent implementation."""
    return spark.range(201).select(F.col("id").cast("int").alias("i"), F.round(probit(F.col("id") / F.lit(200.0)), 9).alias("z"))


@register("F26_number_formats", "SELECT c_custkey, printf('%+.2f', c_acctbal) AS signed, printf('%.3f%%', c_custkey / 8.0::DOUBLE) AS pct FROM customer")
def number_formats(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%+.2f", "c_acctbal").alias("signed"), F.format_string("%.3f%%", F.col("c_custkey") / F.lit(8.0)).alias("pct"))


@register("F29_export_columns", with_views("pts") + "SELECT pid AS point, CASE dom WHEN 'A' THEN 'approximate' ELSE 'detailed' END AS study, CASE label WHEN 1 THEN 'flood' ELSE 'none' END AS class, coalesce(protocol, '') AS protocol FROM pts")
def export_columns(spark, sf_dir):
    return view(spark, sf_dir, "pts").select(
        F.col("pid").alias("point"), F.when(F.col("dom") == "A", "approximate").otherwise("detailed").alias("study"), F.when(F.col("label") == 1, "flood").otherwise("none").alias("class"), F.coalesce("protocol", F.lit("")).alias("protocol")
    )


@register("P11_P12_columns_replaced", "SELECT s_suppkey, s_name, s_acctbal * 2 AS s_acctbal FROM supplier")
def columns_replaced(spark, sf_dir):
    """Stale columns dropped and added again, key first; twice the same as once."""
    s = table(spark, sf_dir, "supplier").drop("s_nationkey")
    side = s.select("s_suppkey", (F.col("s_acctbal") * 2).alias("s_acctbal"))
    for _ in range(2):
        s = s.drop("s_acctbal").join(side, "s_suppkey", "left")
    return s.select("s_suppkey", "s_name", "s_acctbal")


@register("P13_glob_selection", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#1?'")
def glob(spark, sf_dir):
    """Units by a shell pattern."""
    import fnmatch

    return table(spark, sf_dir, "part").filter(F.col("p_brand").rlike(fnmatch.translate("Brand#1?").replace("(?s:", "^(?s:").replace("\\Z", "$").replace("\\z", "$"))).select("p_partkey")


@register("S03_split_scan", "SELECT count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem")
def split_scan(spark, sf_dir):
    """A large file in splits; each task reads its own row groups."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@register("S18_feature_list", "SELECT unnest([0, 1, 2, 3])::INTEGER AS pos, unnest(['slope', 'hand#m', '#x', 'landcover']) AS name")
def features(spark, sf_dir):
    path = shared_dir(spark, "features") + ".txt"
    writers.write_text(spark, path, "# numeric\nslope hand#m\n  #x\n\nlandcover\n")
    return spark.createDataFrame(list(enumerate(readers.feature_list(spark, path))), "pos int, name string")


@register("S19_S20_optional_columns", with_views("pts") + "SELECT pid, coalesce(CASE WHEN lc = 'F' THEN tile END, 'none') AS tile FROM pts")
def optional_columns(spark, sf_dir):
    """A cell with an optional column read where it is there, and a stage that is missing."""
    if readers.optional(spark, shared_dir(spark, "missing")) is not None:
        raise AssertionError("a missing stage was found")
    p = view(spark, sf_dir, "pts").withColumn("tile_50km", F.when(F.col("lc") == "F", F.col("tile")))
    return p.select("pid", F.coalesce("tile_50km", F.lit("none")).alias("tile"))


@register("S31_S32_row_groups", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders")
def row_groups(spark, sf_dir):
    path = shared_dir(spark, "groups")
    writers.write_table(table(spark, sf_dir, "orders").select("o_custkey"), path, row_group_bytes=1 << 16)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@register("S39_report_table", "SELECT unnest([0, 1, 2, 3, 4, 5, 6])::INTEGER AS line, unnest(['| r_regionkey | r_name |', '|---|---|'] || (SELECT list('| ' || r_regionkey || ' | ' || r_name || ' |' ORDER BY r_regionkey) FROM region)) AS text")
def report_table(spark, sf_dir):
    text = writers.markdown(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@register("R09_stratified_build", with_views("pts") + """
SELECT dom, label, pid FROM (SELECT dom, label, pid, row_number() OVER (PARTITION BY dom, label ORDER BY md5('5|' || pid), pid) AS k FROM pts) WHERE k <= 60""")
def stratified(spark, sf_dir):
    """A sampling operator: sixty candidates of each stratum by a hash of the key."""
    order = [F.md5(F.concat_ws("|", F.lit("5"), F.col("pid").cast("string"))), F.col("pid")]
    k = F.row_number().over(Window.partitionBy("dom", "label").orderBy(*order))
    return view(spark, sf_dir, "pts").withColumn("k", k).filter("k <= 60").select("dom", "label", "pid")


@register("R13_seeds", "SELECT s AS budget, t AS trial, (7 * 1000003 + s) * 100003 + t AS seed FROM range(10, 14) a(s), range(3) b(t)")
def seeds(spark, sf_dir):
    """A seed for each budget and trial."""
    t = spark.range(10, 14).select(F.col("id").alias("budget"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("trial"))
    return t.withColumn("seed", (F.lit(7) * 1_000_003 + F.col("budget")) * 100_003 + F.col("trial"))


@register("T07_evaluated_subset", SC + """,
ac AS (SELECT model, sum(CASE WHEN half = 'id' THEN CASE WHEN s > 0.5 OR (s = 0.5 AND y = 0) THEN 1 ELSE 0 END END) / (count(*) FILTER (half = 'id') + 1e-6) AS a,
  sum(CASE WHEN half = 'ood' AND y = 1 THEN CASE WHEN s > 0.5 OR (s = 0.5 AND y = 0) THEN 1 ELSE 0 END END) / (count(*) FILTER (half = 'ood' AND y = 1) + 1e-6) AS b FROM sc GROUP BY model),
r AS (SELECT covar_pop(a, b) / sqrt((var_pop(a) + 1e-6) * (var_pop(b) + 1e-6)) AS r, count(*) AS n FROM ac)
SELECT round(r, 6) AS r, round(tanh(atanh(greatest(least(r, 0.999999), -0.999999)) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(greatest(least(r, 0.999999), -0.999999)) + 1.959963984540054 / sqrt(n - 3)), 6) AS high,
  (SELECT count(DISTINCT pid) FROM sc WHERE half = 'ood' AND y = 1) AS points, (SELECT count(DISTINCT tile) FROM sc WHERE half = 'ood' AND y = 1) AS tiles FROM r""")
def evaluated_subset(spark, sf_dir):
    """The subset of positives: its correlation with the ID half, Fisher's interval, points and tiles."""
    s = scored(spark, sf_dir)
    hit = M.correct(F.col("s"), F.col("y")).cast("int")
    own, sub = F.col("half") == "id", (F.col("half") == "ood") & (F.col("y") == 1)
    share = lambda c: F.sum(F.when(c, hit)) / (F.count_if(c) + 1e-6)
    acc = s.groupBy("model").agg(share(own).alias("a"), share(sub).alias("b"))
    r = M.epsilon_correlation(acc, [], "a", "b")
    low, high = fisher_interval(F.col("r"), F.col("n"))
    size = s.filter(sub).agg(F.count_distinct("pid").alias("points"), F.count_distinct("tile").alias("tiles")).first()
    return r.select(F.round("r", 6).alias("r"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.lit(size[0]).cast("long").alias("points"), F.lit(size[1]).cast("long").alias("tiles"))


@register("T14_self_checks", "SELECT unnest(['keys are unique', 'labels are 0 or 1', 'negatives have a protocol', 'tiles hold their points']) AS rule, unnest([true, true, true, true]) AS ok")
def self_checks(spark, sf_dir):
    """Invariants of the point table in one pass."""
    p = view(spark, sf_dir, "pts")
    rules = {
        "keys are unique": F.count("*") == F.count_distinct("pid"),
        "labels are 0 or 1": F.bool_and(F.col("label").isin(0, 1)),
        "negatives have a protocol": F.bool_and((F.col("label") == 1) == F.col("protocol").isNull()),
        "tiles hold their points": F.bool_and(F.col("tile") == S.block_id(F.col("x"), F.col("y"), 50_000)),
    }
    row = p.agg(*[c.alias(n) for n, c in rules.items()])
    return row.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(f"`{n}`"))])).alias("rule", "ok"))


@register("X13_synthetic_dataset", "SELECT d AS domain, l AS label, 1200::BIGINT AS n, 30::BIGINT AS tiles FROM (VALUES ('A'), ('AE')) a(d), (VALUES (0), (1)) b(l)")
def synthetic_dataset(spark, sf_dir):
    return synthetic.dataset(spark).groupBy("domain", "label").agg(F.count("*").alias("n"), F.count_distinct("tile_50km").alias("tiles"))


@register("G14_slope", with_views("pts") + """,
r AS (SELECT CAST(floor(x / 25000.0) AS BIGINT) AS c, CAST(floor(y / 25000.0) AS BIGINT) AS r, avg(x % 1000) AS z FROM pts GROUP BY 1, 2),
n AS (SELECT a.c, a.r, sum(b.z * (b.c - a.c) * CASE WHEN b.r = a.r THEN 2 ELSE 1 END) / 8 AS gx, sum(b.z * (b.r - a.r) * CASE WHEN b.c = a.c THEN 2 ELSE 1 END) / 8 AS gy, count(*) AS k
  FROM r a JOIN r b ON abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1 GROUP BY a.c, a.r)
SELECT c, r, round(sqrt(gx * gx + gy * gy), 4) AS slope FROM n WHERE k = 9""")
def slope(spark, sf_dir):
    """Horn's 3 by 3 gradient of a raster, by spreading each cell to its neighbours; edges have none."""
    cells = view(spark, sf_dir, "pts").groupBy(F.floor(F.col("x") / 25000).alias("c"), F.floor(F.col("y") / 25000).alias("r")).agg(F.avg(F.col("x") % 1000).alias("z"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cells.withColumn("o", F.explode(near)).select((F.col("c") - F.col("o.i")).alias("c"), (F.col("r") - F.col("o.j")).alias("r"), "z", "o.i", "o.j")
    weight = lambda along, across: F.sum(F.col("z") * F.col(along) * F.when(F.col(across) == 0, 2).otherwise(1)) / 8
    g = spread.join(cells.select("c", "r"), ["c", "r"], "left_semi").groupBy("c", "r").agg(weight("i", "j").alias("gx"), weight("j", "i").alias("gy"), F.count("*").alias("k"))
    return g.filter("k = 9").select("c", "r", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 4).alias("slope"))


@register("X12_guarded_export", with_views("pts") + "SELECT dom AS component, count(*) AS n FROM pts WHERE label = 1 GROUP BY dom")
def guarded_export(spark, sf_dir):
    """An export whose counts, read back, agree with the report's."""
    p = view(spark, sf_dir, "pts").filter("label = 1").select("pid", F.col("dom").alias("component"))
    got = writers.export(p, shared_dir(spark, "components"), "component")
    return spark.createDataFrame(sorted(got.items()), "component string, n long")
