"""Queries of the scalar rules and of projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..registry import register
from ..sources.proxies import table, view, with_views

PT = with_views("pts")


@register("F01_study_regime", """
SELECT p_partkey, CASE WHEN t LIKE '%BLE AVAILABLE%' THEN 'BLE_UNPUBLISHED' WHEN t LIKE '%WITH BFE%' THEN 'BFE_DETAIL' WHEN t LIKE '%WITHOUT BFE%' OR t LIKE '%UNPUBLISHED BFE%' THEN 'NO_BFE'
  WHEN t LIKE '%DIGITAL CONVERSION%' THEN 'DIGITAL_CONVERSION' WHEN t LIKE '%REDELINEATION%' THEN 'REDELINEATION' WHEN t LIKE '%FLOOD RISK%' THEN 'BLE_RISKCLASS' WHEN t IN ('NP', '') THEN 'NOT_POPULATED' ELSE 'OTHER' END AS regime
FROM (SELECT p_partkey, upper(regexp_replace(CASE p_size % 10 WHEN 0 THEN 'np ' WHEN 1 THEN '' WHEN 2 THEN 'Redelineation with bfe' WHEN 3 THEN 'without BFE' WHEN 4 THEN 'Flood Risk, BLE available' WHEN 5 THEN 'unpublished bfe' WHEN 6 THEN 'digital conversion' WHEN 7 THEN 'flood risk' ELSE chr(9) || p_type || chr(10) END, '^\\s+|\\s+$', '', 'g')) AS t FROM part)""")
def study_regime(spark, sf_dir):
    study = "CASE p_size % 10 WHEN 0 THEN 'np ' WHEN 1 THEN '' WHEN 2 THEN 'Redelineation with bfe' WHEN 3 THEN 'without BFE' WHEN 4 THEN 'Flood Risk, BLE available' WHEN 5 THEN 'unpublished bfe' WHEN 6 THEN 'digital conversion' WHEN 7 THEN 'flood risk' ELSE '\\t' || p_type || '\\n' END"
    return table(spark, sf_dir, "part").select("p_partkey", S.study_regime(F.expr(study)).alias("regime"))


@register("F02_clean_sentinel", """
SELECT p_partkey, CASE WHEN v IS NULL OR abs(v + 9999) <= 0.09999001 THEN NULL ELSE v END AS v
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN -9999.0 WHEN 1 THEN NULL WHEN 2 THEN -9999.05 ELSE CAST(p_size AS DOUBLE) END AS v FROM part)""")
def clean_sentinel(spark, sf_dir):
    raw = F.expr("CASE p_size % 4 WHEN 0 THEN '-9999' WHEN 1 THEN 'n/a' WHEN 2 THEN '-9999.05' ELSE cast(p_size AS string) END")
    return table(spark, sf_dir, "part").select("p_partkey", S.clean_sentinel(raw).alias("v"))


@register("F03_F04_blocks_and_tiles", """
SELECT o_orderkey AS pid, CAST(bx AS VARCHAR) || '_' || CAST(by_ AS VARCHAR) AS block, CAST(CAST(floor(bx / 5.0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(by_ / 5.0) AS BIGINT) AS VARCHAR) AS tile
FROM (SELECT o_orderkey, CAST(floor((floor(o_totalprice) - 250000) / 10000) AS BIGINT) AS bx, CAST(floor(((o_custkey * 331) % 500000 - 250000) / 10000.0) AS BIGINT) AS by_ FROM orders)""")
def blocks(spark, sf_dir):
    p = view(spark, sf_dir, "pts").select("pid", S.block_id(F.col("x") - 250000, F.col("y") - 250000, 10000).alias("block"))
    return p.withColumn("tile", S.tile_of_block(F.col("block")))


@register("F05_F06_county_and_state", """
SELECT s_suppkey, CASE WHEN regexp_matches(right(d, 1), '[A-Za-z]') THEN left(d, 5) END AS fips, CASE left(d, 2) WHEN '12' THEN 'FL' WHEN '13' THEN 'GA' END AS state
FROM (SELECT s_suppkey, CAST(12000 + s_suppkey % 2000 AS VARCHAR) || CASE WHEN s_suppkey % 3 = 0 THEN '9' ELSE 'C' END AS d FROM supplier)""")
def county_state(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat((12000 + F.col("s_suppkey") % 2000).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "9").otherwise("C")).alias("d"))
    states = F.create_map(F.lit("12"), F.lit("FL"), F.lit("13"), F.lit("GA"))
    return d.select("s_suppkey", S.county_fips(F.col("d")).alias("fips"), F.try_element_at(states, F.substring("d", 1, 2)).alias("state"))


@register("F07_F08_F09_soil_codes", """
SELECT p_partkey, CASE f WHEN 'None' THEN 0 WHEN 'Rare' THEN 2 WHEN 'Frequent' THEN 4 END AS flood, w AS water,
  CASE WHEN w OR g IS NULL THEN NULL WHEN g ILIKE '%fluv%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fluvial
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Rare' WHEN 2 THEN 'Frequent' END AS f, CASE p_size % 5 WHEN 0 THEN 'Typic Udifluvents' WHEN 1 THEN 'Aeric Epiaquods' WHEN 2 THEN 'FLUVaquents' END AS g,
  regexp_matches(CASE p_size % 6 WHEN 0 THEN 'Water' WHEN 1 THEN 'Waters of the Gulf' WHEN 2 THEN 'Waterway loam' WHEN 3 THEN 'Dredge channel' ELSE p_name END, '^(Waters?|Dredge channel)\\b') AS w FROM part)""".replace("\\\\b", "\\b"))
def soil_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "CASE p_size % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Rare' WHEN 2 THEN 'Frequent' END AS f",
        "CASE p_size % 5 WHEN 0 THEN 'Typic Udifluvents' WHEN 1 THEN 'Aeric Epiaquods' WHEN 2 THEN 'FLUVaquents' END AS g",
        "CASE p_size % 6 WHEN 0 THEN 'Water' WHEN 1 THEN 'Waters of the Gulf' WHEN 2 THEN 'Waterway loam' WHEN 3 THEN 'Dredge channel' ELSE p_name END AS m",
    )
    water = S.is_water_unit(F.col("m"))
    return p.select("p_partkey", S.flood_code(F.col("f")).alias("flood"), water.alias("water"), S.fluvial_code(F.col("g"), water).alias("fluvial"))


@register("F10_log10_floor", "SELECT c_custkey, round(log10(greatest(c_acctbal, 1)), 6) AS v FROM customer")
def log10_floor(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(S.log10_floor(F.col("c_acctbal")), 6).alias("v"))


@register("F11_P14_one_hot", """
SELECT 'p_size_' || l AS feature, round(avg(CASE WHEN p_size = l THEN 1.0 ELSE 0.0 END), 6) AS share FROM part, (SELECT DISTINCT p_size AS l FROM part WHERE p_size <= 10) GROUP BY l HAVING avg(CASE WHEN p_size = l THEN 1.0 ELSE 0.0 END) >= 0.01""")
def one_hot(spark, sf_dir):
    """Indicator columns over the levels (one row a level on the driver), those of at least 1%."""
    p = table(spark, sf_dir, "part")
    levels = sorted(r[0] for r in p.filter("p_size <= 10").select("p_size").distinct().collect())
    hot = S.one_hot("p_size", levels)
    shares = p.select(*[c.alias(n) for n, c in hot.items()]).agg(*[F.avg(n).alias(n) for n in hot])
    long = shares.select(F.explode(F.create_map(*[x for n in hot for x in (F.lit(n), F.col(n))])).alias("feature", "share"))
    return long.filter("share >= 0.01").withColumn("share", F.round("share", 6))


@register("F20_slug", "SELECT p_partkey, trim(regexp_replace(lower('(' || p_name || ' / ' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat(F.lit("("), "p_name", F.lit(" / "), "p_brand", F.lit(")"))).alias("slug"))


@register("F21_class_names", """
SELECT p_partkey, coalesce(name, '') AS name FROM part LEFT JOIN (VALUES (11, 'Open Water'), (12, 'Perennial Ice/Snow'), (21, 'Developed, Open Space'), (22, 'Developed, Low Intensity'),
  (23, 'Developed, Medium Intensity'), (24, 'Developed, High Intensity'), (31, 'Barren Land (Rock/Sand/Clay)'), (41, 'Deciduous Forest'), (42, 'Evergreen Forest'), (43, 'Mixed Forest'),
  (52, 'Shrub/Scrub'), (71, 'Grassland/Herbaceous'), (81, 'Pasture/Hay'), (82, 'Cultivated Crops'), (90, 'Woody Wetlands'), (95, 'Emergent Herbaceous Wetlands')) c(code, name) ON code = 10 + p_partkey % 90""")
def class_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.class_name((10 + F.col("p_partkey") % 90).cast("int")).alias("name"))


@register("F23_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS v, round(1 / (1 + exp(c_acctbal / 1000)), 6) AS c FROM customer")
def sigmoid(spark, sf_dir):
    t = F.col("c_acctbal") / 1000
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(S.sigmoid(t), 6).alias("v"), F.round(S.sigmoid(-t), 6).alias("c"))


@register("F25_variogram_models", """
SELECT p_size, round(0.5 + 2 * (1.5 * least(p_size / 30.0::DOUBLE, 1) - 0.5 * pow(least(p_size / 30.0::DOUBLE, 1), 3)), 6) AS spherical, round(0.5 + 2 * (1 - exp(-p_size / 10.0::DOUBLE)), 6) AS exponential FROM (SELECT DISTINCT p_size FROM part)""")
def variogram_models(spark, sf_dir):
    h = table(spark, sf_dir, "part").select("p_size").distinct()
    d = F.col("p_size").cast("double")
    return h.select("p_size", F.round(S.spherical(d, 0.5, 2.0, 30.0), 6).alias("spherical"), F.round(S.exponential(d, 0.5, 2.0, 10.0), 6).alias("exponential"))


@register("F27_F28_wkt_and_digest", """
SELECT pid, sha256(printf('POINT(%.9f %.9f)', x / 64.0::DOUBLE, y / 64.0::DOUBLE)) AS d FROM (""" + "SELECT o_orderkey AS pid, floor(o_totalprice) AS x, (o_custkey * 331) % 500000 AS y FROM orders)")
def wkt_digest(spark, sf_dir):
    return view(spark, sf_dir, "pts").select("pid", F.sha2(S.wkt_point(F.col("x") / F.lit(64.0), F.col("y") / F.lit(64.0)), 256).alias("d"))


@register("F31_date_range", "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def date_range(spark, sf_dir):
    text = F.date_format("o_orderdate", "M/d/yyyy h:mm:ss a")
    t = F.to_timestamp_ntz(text, F.lit("M/d/yyyy h:mm:ss a"))
    return table(spark, sf_dir, "orders").agg(F.min(t).alias("first"), F.max(t).alias("last"))


@register("F30_whitespace", "SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS n FROM documents".replace("\\\\", "\\"))
def whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", "\\s+", " ")).cast("long").alias("n"))


@register("P01_P04_zone_filters", PT + """
SELECT dom, count(*) FILTER (dom IN ('A', 'AE') AND lc = 'F') AS zone, count(*) FILTER (upper(coalesce(protocol, '')) LIKE '%SHADED%') AS shaded, count(*) FILTER (lc IN ('O')) AS unassessed, count(*) FILTER (label = 1 OR protocol = 'band') AS supervised FROM pts GROUP BY dom""")
def zone_filters(spark, sf_dir):
    rules = {"zone": F.col("dom").isin("A", "AE") & (F.col("lc") == "F"), "shaded": F.upper(F.coalesce("protocol", F.lit(""))).contains("SHADED"), "unassessed": F.col("lc").isin("O"), "supervised": (F.col("label") == 1) | (F.col("protocol") == "band")}
    return view(spark, sf_dir, "pts").groupBy("dom").agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


@register("P07_first_failure", PT + """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN x < 30000 THEN 'too_near' WHEN x > 400000 THEN 'too_far' WHEN y < 20000 THEN 'outside_panel' WHEN lc = 'O' THEN 'unassessed' WHEN lc = 'P' THEN 'open_water' WHEN y % 97 = 0 THEN 'not_on_land' WHEN y > 480000 THEN 'outside_state' ELSE 'kept' END AS reason FROM pts) GROUP BY reason""")
def first_failure(spark, sf_dir):
    """Each point under the first test that it fails, so counts are of points that passed all earlier tests."""
    rules = {"too_near": "x < 30000", "too_far": "x > 400000", "outside_panel": "y < 20000", "unassessed": "lc = 'O'", "open_water": "lc = 'P'", "not_on_land": "y % 97 = 0", "outside_state": "y > 480000"}
    return view(spark, sf_dir, "pts").select(S.first_of({n: F.expr(c) for n, c in rules.items()}).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("P08_P09_complete_cases", PT + "SELECT count(*) AS n, count(protocol) AS present, count(*) FILTER (protocol IS NOT NULL AND lc IS NOT NULL) AS complete FROM pts")
def complete_cases(spark, sf_dir):
    p = view(spark, sf_dir, "pts")
    return p.agg(F.count("*").alias("n"), F.count("protocol").alias("present"), F.count_if(F.col("protocol").isNotNull() & F.col("lc").isNotNull()).alias("complete"))


@register("P10_varying_columns", "SELECT 'p_size' AS c UNION ALL SELECT 'p_retailprice'")
def varying(spark, sf_dir):
    """The columns with two distinct values or more, found in one pass."""
    p = table(spark, sf_dir, "part").withColumn("constant", F.lit(1.0))
    names = ("p_size", "p_retailprice", "constant")
    ends = p.agg(*[f(n).alias(f"{n}_{t}") for n in names for t, f in (("a", F.min), ("b", F.max))]).first()
    return spark.createDataFrame([(n,) for n in names if ends[f"{n}_a"] != ends[f"{n}_b"]], "c string")


@register("P15_safe_identifier", "SELECT p_partkey FROM part WHERE regexp_full_match(replace(p_brand, '#', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '#' END), '[A-Za-z0-9_]+')")
def identifiers(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("n", F.expr("replace(p_brand, '#', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '#' END)"))
    return p.filter(S.safe_identifier(F.col("n"))).select("p_partkey")
