"""Queries of joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import register
from ..sources.proxies import table, view, with_views

PT = with_views("pts")
GROUP = "dom || '/' || label || '/' || coalesce(protocol, '-')"


@register("S01_projected_scan", "SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_returnflag")
def projected_scan(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1995-01-01'"))
    return t.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@register("S04_point_lookup", "SELECT r.pos, r.id, o.o_totalprice FROM (SELECT c_custkey AS pos, c_custkey * 7 AS id FROM customer) r LEFT JOIN orders o ON o.o_orderkey = r.id")
def point_lookup(spark, sf_dir):
    """Rows by id in the order of the request; null for an unknown id."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 7).alias("id"))
    return ids.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id", "left").select("pos", "id", "o_totalprice")


@register("S08_bbox_scan", PT + "SELECT pid, x, y FROM pts WHERE x BETWEEN 100000 AND 150000 AND y BETWEEN 200000 AND 300000")
def bbox_scan(spark, sf_dir):
    return view(spark, sf_dir, "pts").filter("x BETWEEN 100000 AND 150000 AND y BETWEEN 200000 AND 300000").select("pid", "x", "y")


@register("S16_key_list_fetch", """
SELECT p.p_partkey, s.s_name, c.c_name FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % 50 LEFT JOIN customer c ON c.c_custkey = p.p_partkey * 3 WHERE p.p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def key_list_fetch(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    p = table(spark, sf_dir, "part").join(keys, "p_partkey", "left_semi")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return p.join(s, s.s_suppkey == p.p_partkey % 50).join(c, c.c_custkey == p.p_partkey * 3, "left").select("p_partkey", "s_name", "c_name")


@register("S17_newest_wins", """
SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1""")
def newest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    best = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@register("J01_J02_attribute_merge", """
SELECT o.o_orderkey, p.m FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) p ON p.l_orderkey = o.o_orderkey""")
def attribute_merge(spark, sf_dir):
    right = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("m"))
    return R.many_to_one(table(spark, sf_dir, "orders").select("o_orderkey"), right, "o_orderkey")


@register("J03_validated_joins", "SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey")
def validated_joins(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    t = R.many_to_one(t, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return R.many_to_one(t, table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@register("J04_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@register("J05_stale_rows", """
WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS unknown, (SELECT count(*) FROM a JOIN b USING (id) WHERE abs(a.v - b.v) > 1e-9) AS moved""")
def stale_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    a = o.filter("id % 5 <> 0")
    b = o.filter("id % 3 <> 0").withColumn("v", F.when(F.col("id") % 7 == 0, F.col("v") + 0.5).otherwise(F.col("v")))
    both = b.join(a.select("id", F.col("v").alias("w")), "id", "left")
    return both.agg(F.count_if(F.col("w").isNull()).alias("unknown"), F.count_if(F.abs(F.col("v") - F.col("w")) > 1e-9).alias("moved"))


@register("J06_key_differences", """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT o_custkey AS id FROM orders) a FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def key_differences(spark, sf_dir):
    return R.key_differences(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id")


@register("J07_map_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def map_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@register("J08_verified_gather", "SELECT count(*) AS n, max(abs(o_totalprice - l)) > 1000000 AS bad FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS l FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def verified_gather(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("l"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("o_totalprice") - F.col("l"))) > 1000000).alias("bad"))


@register("J19_union_first_unit", """
SELECT id, unit FROM (SELECT id, unit, row_number() OVER (PARTITION BY id ORDER BY unit) AS k FROM (SELECT l_partkey AS id, 1 AS unit FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT p_partkey, 2 FROM part)) WHERE k = 1""")
def union_first_unit(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("id"), F.lit(1).alias("unit"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(2).alias("unit"))
    return a.unionByName(b).groupBy("id").agg(F.min("unit").alias("unit"))


@register("J20_P06_raster_lookup", PT + """,
r AS (SELECT CAST(p_partkey % 40 AS BIGINT) AS col, CAST(p_partkey // 40 AS BIGINT) AS row, p_size % 4 * 11 AS cls FROM part)
SELECT pid, coalesce(cls, 0) AS cls, coalesce(cls, 0) NOT IN (0, 11) AS land FROM pts LEFT JOIN r ON CAST(floor(x / 10000.0) AS BIGINT) = col AND CAST(floor(y / 10000.0) AS BIGINT) = row""")
def raster_lookup(spark, sf_dir):
    """Class of the pixel under each point, 0 off the raster, by a computed key."""
    r = table(spark, sf_dir, "part").selectExpr("p_partkey % 40 AS col", "p_partkey div 40 AS row", "p_size % 4 * 11 AS cls")
    p = view(spark, sf_dir, "pts").select("pid", F.floor(F.col("x") / 10000).alias("col"), F.floor(F.col("y") / 10000).alias("row"))
    cls = F.coalesce("cls", F.lit(0))
    return p.join(r, ["col", "row"], "left").select("pid", cls.alias("cls"), (~cls.isin(0, 11)).alias("land"))


@register("A01_strata", PT + f"SELECT {GROUP} AS g, count(*) AS n FROM pts GROUP BY {GROUP}")
def strata(spark, sf_dir):
    return view(spark, sf_dir, "pts").groupBy(F.expr("concat_ws('/', dom, label, coalesce(protocol, '-'))").alias("g")).agg(F.count("*").alias("n"))


@register("A02_pivot_report", PT + "SELECT dom, count(*) FILTER (lc = 'F') AS \"F\", count(*) FILTER (lc = 'O') AS \"O\", count(*) FILTER (lc = 'P') AS \"P\" FROM pts GROUP BY dom")
def pivot_report(spark, sf_dir):
    return view(spark, sf_dir, "pts").groupBy("dom").pivot("lc", ["F", "O", "P"]).count().na.fill(0)


@register("A03_crosstab_verdict", PT + """
SELECT dom, lc, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dom), 6) AS share, round(abs(count(*) / sum(count(*)) OVER (PARTITION BY dom) - 1 / 3.0::DOUBLE), 6) AS deviation FROM pts GROUP BY dom, lc""")
def crosstab(spark, sf_dir):
    n = view(spark, sf_dir, "pts").groupBy("dom", "lc").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("dom"))
    return n.select("dom", "lc", "n", F.round(share, 6).alias("share"), F.round(F.abs(share - F.lit(1.0) / 3), 6).alias("deviation"))


@register("A04_total_row", PT + "SELECT coalesce(dom, 'all') AS dom, count(*) AS n, round(avg(label), 4) AS share FROM pts GROUP BY GROUPING SETS ((dom), ())")
def total_row(spark, sf_dir):
    return R.with_total(view(spark, sf_dir, "pts"), "dom", [F.count("*").alias("n"), F.round(F.avg("label"), 4).alias("share")])


@register("A05_attrition", PT + """
SELECT a.tile, a.n - coalesce(b.n, 0) AS lost FROM (SELECT tile, count(*) AS n FROM pts GROUP BY tile) a LEFT JOIN (SELECT tile, count(*) AS n FROM pts WHERE lc = 'F' AND x > 90000 GROUP BY tile) b USING (tile)""")
def attrition(spark, sf_dir):
    p = view(spark, sf_dir, "pts")
    after = p.filter("lc = 'F' AND x > 90000").groupBy("tile").agg(F.count("*").alias("m"))
    return p.groupBy("tile").agg(F.count("*").alias("n")).join(after, "tile", "left").select("tile", (F.col("n") - F.coalesce("m", F.lit(0))).alias("lost"))


@register("A06_X08_invariants", PT + """
SELECT tile, problem FROM (SELECT tile, unnest([CASE WHEN n > 160 THEN 'too many' END, CASE WHEN k = 0 THEN 'no positive' END, CASE WHEN k > n THEN 'more than all' END]) AS problem FROM (SELECT tile, count(*) AS n, sum(label) AS k FROM pts GROUP BY tile)) WHERE problem IS NOT NULL""")
def invariants(spark, sf_dir):
    """Violated design rules as rows."""
    t = view(spark, sf_dir, "pts").groupBy("tile").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    rules = F.array(F.expr("CASE WHEN n > 160 THEN 'too many' END"), F.expr("CASE WHEN k = 0 THEN 'no positive' END"), F.expr("CASE WHEN k > n THEN 'more than all' END"))
    return t.select("tile", F.explode(F.array_compact(rules)).alias("problem"))


@register("A07_top_share", PT + """
SELECT dom, round(max(s), 6) AS largest, round(sum(s) FILTER (k <= 10), 6) AS top10 FROM (SELECT dom, n / sum(n) OVER (PARTITION BY dom) AS s, row_number() OVER (PARTITION BY dom ORDER BY n DESC, tile) AS k FROM (SELECT dom, tile, count(*) AS n FROM pts GROUP BY dom, tile)) GROUP BY dom""")
def top_share(spark, sf_dir):
    n = view(spark, sf_dir, "pts").groupBy("dom", "tile").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dom")
    t = n.select("dom", (F.col("n") / F.sum("n").over(w)).alias("s"), F.row_number().over(w.orderBy(F.desc("n"), "tile")).alias("k"))
    return t.groupBy("dom").agg(F.round(F.max("s"), 6).alias("largest"), F.round(F.sum(F.when(F.col("k") <= 10, F.col("s"))), 6).alias("top10"))


@register("A08_value_shares", PT + "SELECT dom, lc, round(count(*) / sum(count(*)) OVER (PARTITION BY dom), 6) AS share FROM pts GROUP BY dom, lc")
def value_shares(spark, sf_dir):
    n = view(spark, sf_dir, "pts").groupBy("dom", "lc").agg(F.count("*").alias("n"))
    return n.select("dom", "lc", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dom")), 6).alias("share"))


@register("A09_ratio_of_sums", """
SELECT k, round(a.s / nullif(b.s, 0), 6) AS ratio FROM (SELECT l_suppkey AS k, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1) a JOIN (SELECT p_partkey % 100 AS k, sum(p_size % 3) AS s FROM part GROUP BY 1) b USING (k) WHERE b.s <> 0""")
def ratio_of_sums(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("a"))
    b = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("k")).agg(F.sum(F.col("p_size") % 3).alias("b"))
    return a.join(b, "k").select("k", F.round(F.try_divide("a", "b"), 6).alias("ratio")).filter("ratio IS NOT NULL")


@register("A10_min_and_distinct", """
SELECT c_custkey, min(o_orderkey) AS first, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def min_distinct(spark, sf_dir):
    """For a given key list; a key without rows has (null, 0)."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first"), F.count_distinct("o_orderpriority").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", "first", F.coalesce("n", F.lit(0)).alias("n"))


@register("A11_dominant_component", """
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY coalesce(nullif(l_quantity, 50), -1) DESC, (l_returnflag = 'R')::INT DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def dominant(spark, sf_dir):
    """First row of each key: share descending (null last), major first, lowest id."""
    t = table(spark, sf_dir, "lineitem")
    order = [F.coalesce(F.nullif("l_quantity", F.lit(50)), F.lit(-1)).desc(), (F.col("l_returnflag") == "R").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return R.first_by(t, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@register("A12_keep_first", "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def keep_first(spark, sf_dir):
    return R.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first"))


@register("A13_coverage", PT + "SELECT unnest(['protocol', 'lc', 'all']) AS \"column\", unnest([round(count(protocol) / count(*), 6), round(count(lc) / count(*), 6), round(count(*) FILTER (protocol IS NOT NULL AND lc IS NOT NULL) / count(*), 6)]) AS share FROM pts")
def coverage(spark, sf_dir):
    return R.coverage(view(spark, sf_dir, "pts"), ["protocol", "lc"]).withColumn("share", F.round("share", 6))


@register("A14_set_shares", PT + "SELECT dom, round(avg(CASE WHEN protocol IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, round(avg(label), 6) AS positive FROM pts GROUP BY dom")
def set_shares(spark, sf_dir):
    return view(spark, sf_dir, "pts").groupBy("dom").agg(F.round(F.avg(F.col("protocol").isNull().cast("double")), 6).alias("missing"), F.round(F.avg("label"), 6).alias("positive"))


@register("A15_top_classes", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size ORDER BY n DESC, p_size LIMIT 5")
def top_classes(spark, sf_dir):
    """A top-5 report; ties go to the smaller code."""
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_size").limit(5)


@register("A16_other_bucket", "SELECT CASE WHEN p_size IN (1, 2, 3) THEN CAST(p_size AS VARCHAR) ELSE 'other' END AS c, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def other_bucket(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy(F.when(F.col("p_size").isin(1, 2, 3), F.col("p_size").cast("string")).otherwise("other").alias("c")).agg(F.count("*").alias("n"))
    return n.select("c", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@register("A17_box_statistics", "SELECT c_mktsegment, " + ", ".join(f"round(quantile_cont(c_acctbal, {q}), 6) AS p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM customer GROUP BY c_mktsegment")
def box_statistics(spark, sf_dir):
    """Exact percentiles with linear interpolation."""
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    t = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", list(qs)).alias("q"))
    return t.select("c_mktsegment", *[F.round(F.col("q")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)])


@register("A30_A31_reason_sums", "SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS total, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_type")
def reason_sums(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@register("A32_agreement", "SELECT round(avg(CASE WHEN a IS NOT DISTINCT FROM b THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) FILTER (a IS DISTINCT FROM b) AS mismatches FROM (SELECT nullif(p_size, 3) AS a, nullif(p_size, CASE WHEN p_partkey % 9 = 0 THEN 4 ELSE 3 END) AS b FROM part)")
def agreement(spark, sf_dir):
    same = F.expr("nullif(p_size, 3) <=> nullif(p_size, CASE WHEN p_partkey % 9 = 0 THEN 4 ELSE 3 END)")
    return table(spark, sf_dir, "part").agg(F.round(F.avg(same.cast("double")), 6).alias("share"), F.count_if(~same).alias("mismatches"))


@register("A33_budget_conclusions", """
WITH t AS (SELECT p_size % 3 AS search, p_size AS s, avg(p_retailprice) - 1380 AS r FROM part GROUP BY p_size),
w AS (SELECT search, s, bool_and(r < 30) OVER (PARTITION BY search ORDER BY s) AS up, bool_and(r > -500) OVER (PARTITION BY search ORDER BY s DESC) AS down FROM t)
SELECT search, max(s) FILTER (up) AS largest, min(s) FILTER (down) AS smallest FROM w GROUP BY search""")
def budget_conclusions(spark, sf_dir):
    """Largest budget up to which a condition holds throughout, and smallest from which another does."""
    t = table(spark, sf_dir, "part").groupBy("p_size").agg((F.avg("p_retailprice") - 1380).alias("r")).withColumn("search", F.col("p_size") % 3)
    w = Window.partitionBy("search")
    t = t.select("search", F.col("p_size").alias("s"), F.bool_and(F.col("r") < 30).over(w.orderBy("p_size")).alias("up"), F.bool_and(F.col("r") > -500).over(w.orderBy(F.desc("p_size"))).alias("down"))
    return t.groupBy("search").agg(F.max(F.when(F.col("up"), F.col("s"))).alias("largest"), F.min(F.when(F.col("down"), F.col("s"))).alias("smallest"))


@register("W01_first_hits", PT + "SELECT tile, pid FROM (SELECT tile, pid, row_number() OVER (PARTITION BY tile ORDER BY pid) AS k FROM pts) WHERE k <= 3")
def first_hits(spark, sf_dir):
    w = Window.partitionBy("tile").orderBy("pid")
    return view(spark, sf_dir, "pts").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("tile", "pid")


@register("W04_west_east", PT + """
SELECT lc, tile, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN CASE WHEN k = 1 THEN '(west)' ELSE '(east)' END ELSE '(' || k || ' from west)' END AS name
FROM (SELECT lc, tile, row_number() OVER (PARTITION BY lc ORDER BY avg(x), tile) AS k, count(*) OVER (PARTITION BY lc) AS n FROM pts WHERE y < 50000 GROUP BY lc, tile)""")
def west_east(spark, sf_dir):
    t = view(spark, sf_dir, "pts").filter("y < 50000").groupBy("lc", "tile").agg(F.avg("x").alias("m"))
    k, n = F.row_number().over(Window.partitionBy("lc").orderBy("m", "tile")), F.count("*").over(Window.partitionBy("lc"))
    name = F.when(n == 1, "").when(n == 2, F.when(k == 1, "(west)").otherwise("(east)")).otherwise(F.concat(F.lit("("), k.cast("string"), F.lit(" from west)")))
    return t.select("lc", "tile", name.alias("name"))


@register("W07_T13_monotone_steps", """
WITH t AS (SELECT p_size % 4 AS g, p_size AS mu, avg(p_retailprice) AS v FROM part GROUP BY p_size),
d AS (SELECT g, mu, v, lag(v) OVER (PARTITION BY g ORDER BY mu) AS b, lag(mu) OVER (PARTITION BY g ORDER BY mu) AS f FROM t)
SELECT g, coalesce(bool_and(v >= b), true) AS rising, coalesce(string_agg(f || '->' || mu, ';' ORDER BY mu) FILTER (v < b), '') AS drops FROM d GROUP BY g""")
def monotone_steps(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("v")).withColumn("g", F.col("p_size") % 4)
    w = Window.partitionBy("g").orderBy("p_size")
    t = t.withColumns({"b": F.lag("v").over(w), "f": F.lag("p_size").over(w)})
    drop = F.when(F.col("v") < F.col("b"), F.struct("p_size", F.concat_ws("->", F.col("f").cast("string"), F.col("p_size").cast("string")).alias("t")))
    return t.groupBy("g").agg(F.coalesce(F.bool_and(F.col("v") >= F.col("b")), F.lit(True)).alias("rising"), F.array_join(F.sort_array(F.collect_list(drop))["t"], ";").alias("drops"))


@register("O01_O02_O04_top_bottom_ties", """
WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size, p_partkey) AS b FROM part), k AS (SELECT p_size AS v FROM r WHERE a = 500)
SELECT p_partkey, a <= 500 AS top, b <= 500 AS bottom, (SELECT count(*) FROM part, k WHERE p_size = v) AS ties FROM r WHERE a <= 500 OR b <= 500""")
def top_bottom(spark, sf_dir):
    """The 500 highest and lowest scores, ties to the lower index, and the ties at the cut."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    top = p.orderBy(F.desc("p_size"), "p_partkey").limit(500)
    low = p.orderBy("p_size", "p_partkey").limit(500)
    cut = top.agg(F.min("p_size").alias("p_size"))
    ties = p.join(F.broadcast(cut), "p_size").count()
    both = top.select("p_partkey", F.lit(True).alias("top")).join(low.select("p_partkey", F.lit(True).alias("bottom")), "p_partkey", "full_outer")
    return both.select("p_partkey", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("top", "bottom")], F.lit(ties).cast("long").alias("ties"))


@register("O05_ordered_chunks", PT + "SELECT chunk, count(*) AS n, min(pid) AS first FROM (SELECT pid, (row_number() OVER (ORDER BY tile, pid) - 1) // 2000 AS chunk FROM pts) GROUP BY chunk")
def ordered_chunks(spark, sf_dir):
    t = R.ordered_offsets(view(spark, sf_dir, "pts").select("tile", "pid"), [F.col("tile"), F.col("pid")], 2000)
    return t.groupBy("chunk").agg(F.count("*").alias("n"), F.min("pid").alias("first"))


@register("O07_O08_ordered_report", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name ORDER BY n DESC, n_name")
def ordered_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name")


@register("U01_U02_set_operations", """
SELECT 'except' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders)""")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    out = None
    for name, t in (("except", a.subtract(b)), ("intersect", a.intersect(b)), ("union_all", a.unionByName(b))):
        own = t.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@register("U03_S34_added_columns", "SELECT 0::BIGINT AS differences, count(*) AS n FROM supplier")
def added_columns(spark, sf_dir):
    """Adds columns by key and checks that all old columns are as they were."""
    s = table(spark, sf_dir, "supplier")
    more = s.select("s_suppkey", (F.col("s_acctbal") * 2).alias("twice"))
    new = R.add_columns(R.add_columns(s, more, "s_suppkey"), more, "s_suppkey")
    return R.frame_differences(s, new.select(*s.columns)).agg(F.count("*").alias("differences"), F.lit(new.count()).cast("long").alias("n"))
