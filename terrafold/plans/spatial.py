"""Queries of polygons, distances, neighbours and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as SP
from ..operators.storage import settled
from ..registry import register
from ..sources.proxies import table, view, with_views

BX = with_views("pts", "boxes") + """,
poly AS (SELECT *, CASE WHEN tri THEN [[x0, y0, x1, y0], [x1, y0, x0, y1], [x0, y1, x0, y0]] ELSE [[x0, y0, x1, y0], [x1, y0, x1, y1], [x1, y1, x0, y1], [x0, y1, x0, y0]] END AS es FROM boxes),
edge AS (SELECT poly, e[1] AS ax, e[2] AS ay, e[3] AS bx, e[4] AS by_ FROM (SELECT poly, unnest(es) AS e FROM poly)),
pip AS (
  SELECT p.pid, q.poly, q.dfirm FROM pts p JOIN poly q ON p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1 JOIN edge e ON e.poly = q.poly
  GROUP BY p.pid, q.poly, q.dfirm
  HAVING sum(CASE WHEN ((ay <= p.y AND by_ > p.y) AND (bx - ax) * (p.y - ay) - (p.x - ax) * (by_ - ay) > 0) OR ((by_ <= p.y AND ay > p.y) AND (bx - ax) * (p.y - ay) - (p.x - ax) * (by_ - ay) < 0) THEN 1 ELSE 0 END) % 2 = 1)"""
CELL = 10000


def polygons(spark, sf_dir):
    """Boxes, and triangles, as edge arrays."""
    e = lambda *p: "array(" + ", ".join(f"named_struct('x1', {p[i]}, 'y1', {p[i + 1]}, 'x2', {p[(i + 2) % len(p)]}, 'y2', {p[(i + 3) % len(p)]})" for i in range(0, len(p), 2)) + ")"
    edges = f"CASE WHEN tri THEN {e('x0', 'y0', 'x1', 'y0', 'x0', 'y1')} ELSE {e('x0', 'y0', 'x1', 'y0', 'x1', 'y1', 'x0', 'y1')} END"
    return view(spark, sf_dir, "boxes").withColumn("edges", F.expr(f"cast({edges} AS {G.EDGES})"))


def segments(spark, sf_dir):
    return polygons(spark, sf_dir).select("poly", F.posexplode("edges").alias("i", "e")).select((F.col("poly") * 10 + F.col("i")).alias("segment"), "e.*")


@register("G02_J09_J11_point_in_polygon", BX + "SELECT pid, poly FROM pip")
def point_in_polygon(spark, sf_dir):
    return SP.points_in_polygons(view(spark, sf_dir, "pts").select("pid", "x", "y"), polygons(spark, sf_dir), CELL).select("pid", "poly")


@register("J09_first_polygon", BX + "SELECT pts.pid, min(poly) AS poly FROM pts LEFT JOIN pip USING (pid) GROUP BY pts.pid")
def first_polygon(spark, sf_dir):
    p = view(spark, sf_dir, "pts").select("pid", "x", "y")
    return SP.first_polygon(p, polygons(spark, sf_dir), "pid", CELL, [F.col("poly")]).select("pid", "poly")


@register("J10_preferred_polygon", BX + """
SELECT pid, poly FROM (SELECT p.pid, q.poly, row_number() OVER (PARTITION BY p.pid ORDER BY (q.dfirm = p.county % 7)::INT DESC, q.poly) AS k FROM pip q JOIN pts p USING (pid)) WHERE k = 1""")
def preferred_polygon(spark, sf_dir):
    """The polygon of the point's own map first, then the lowest."""
    p = view(spark, sf_dir, "pts").select("pid", "x", "y", (F.col("county") % 7).alias("dfirm"))
    poly = polygons(spark, sf_dir)
    own = settled(SP.first_polygon(p, poly, "pid", CELL, [F.col("poly")], on=("dfirm",)))
    rest = SP.first_polygon(own.filter("poly IS NULL").select("pid", "x", "y"), poly, "pid", CELL, [F.col("poly")])
    return own.unionByName(rest, allowMissingColumns=True).filter("poly IS NOT NULL").select("pid", "poly")


@register("S15_boundary_point_in_polygon", BX + """
SELECT p.pid, min(q.poly) AS poly, count(*) AS n FROM (SELECT poly AS pid, x1 AS x, y1 AS y FROM boxes) p JOIN poly q ON p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1 WHERE NOT q.tri GROUP BY p.pid""")
def boundary(spark, sf_dir):
    """Corners of the boxes in boxes: a point on an edge is in both, and the lowest is taken."""
    corners = view(spark, sf_dir, "boxes").select(F.col("poly").alias("pid"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    plain = polygons(spark, sf_dir).filter("NOT tri")
    return SP.points_in_polygons(corners, plain, CELL, boundary=True).groupBy("pid").agg(F.min("poly").alias("poly"), F.count("*").alias("n"))


_D2 = """CASE WHEN l2 > 0 THEN pow(px - (ax + t * dx), 2) + pow(py - (ay + t * dy), 2) ELSE pow(px - ax, 2) + pow(py - ay, 2) END"""
_SEG = BX + """,
dd AS (
  SELECT pid, segment, pow(x - (ax + t * dx), 2) + pow(y - (ay + t * dy), 2) AS d2 FROM (
    SELECT p.pid, p.x, p.y, e.segment, ax, ay, bx - ax AS dx, by_ - ay AS dy,
      CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))::DOUBLE)) ELSE 0.0::DOUBLE END AS t
    FROM pts p, (SELECT poly * 10 + row_number() OVER (PARTITION BY poly ORDER BY k) - 1 AS segment, ax, ay, bx, by_ FROM (SELECT poly, unnest(es) AS e, unnest(range(len(es))) AS k, e[1] AS ax, e[2] AS ay, e[3] AS bx, e[4] AS by_ FROM (SELECT poly, es FROM poly))) e))"""
_SEG = _SEG.replace("SELECT poly, unnest(es) AS e, unnest(range(len(es))) AS k, e[1] AS ax, e[2] AS ay, e[3] AS bx, e[4] AS by_ FROM (SELECT poly, es FROM poly)", "SELECT poly, k, e[1] AS ax, e[2] AS ay, e[3] AS bx, e[4] AS by_ FROM (SELECT poly, unnest(es) AS e, unnest(range(len(es))) AS k FROM poly)")


@register("J12_G03_nearest_line", _SEG + "SELECT pid, round(sqrt(min(d2)), 4) AS d FROM dd GROUP BY pid")
def nearest_line(spark, sf_dir):
    near = SP.nearest_segment(view(spark, sf_dir, "pts"), segments(spark, sf_dir), "pid")
    return near.select("pid", F.round(F.sqrt("d2"), 4).alias("d"))


@register("J13_bounded_nearest", _SEG + "SELECT pid, round(sqrt(min(d2) FILTER (d2 <= 25000000)), 4) AS d FROM dd GROUP BY pid")
def bounded_nearest(spark, sf_dir):
    """Distance up to 5 km, null beyond."""
    near = SP.nearest_segment(view(spark, sf_dir, "pts"), segments(spark, sf_dir), "pid", radius=5000)
    return near.select("pid", F.round(F.sqrt("d2"), 4).alias("d"))


@register("G10_line_types", _SEG + "SELECT pid, round(sqrt(min(d2) FILTER (segment % 10 < 2)), 4) AS river, round(sqrt(min(d2) FILTER (segment % 10 >= 2)), 4) AS coast FROM dd GROUP BY pid")
def line_types(spark, sf_dir):
    """Rivers and coast measured apart."""
    p, s = view(spark, sf_dir, "pts"), segments(spark, sf_dir)
    river, coast = (SP.nearest_segment(p, s.filter(c), "pid").select("pid", F.round(F.sqrt("d2"), 4).alias(n)) for n, c in (("river", "segment % 10 < 2"), ("coast", "segment % 10 >= 2")))
    return river.join(coast, "pid")


_KNN = with_views("pts") + """,
kn AS (
  SELECT pid, unnest(l) AS neighbour, unnest(range(1, len(l) + 1)) AS rank FROM (
    SELECT a.pid, arg_min(b.pid, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 1000000 + b.pid, 10) AS l FROM pts a, pts b WHERE a.pid <> b.pid GROUP BY a.pid)),
nn AS (SELECT k.*, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM kn k JOIN pts a ON a.pid = k.pid JOIN pts b ON b.pid = k.neighbour)"""


def neighbours(spark, sf_dir, k=10):
    p = view(spark, sf_dir, "pts").select("pid", "x", "y")
    return SP.knn(p, p, k, "pid")


@register("J14_K01_neighbours", _KNN + "SELECT pid, neighbour, rank::INTEGER AS rank, d2 FROM nn")
def knn(spark, sf_dir):
    return neighbours(spark, sf_dir).select("pid", "neighbour", "rank", "d2")


@register("K06_kth_distance", _KNN + "SELECT round(median(sqrt(d2)), 6) AS d FROM nn WHERE rank = 10")
def kth_distance(spark, sf_dir):
    return neighbours(spark, sf_dir).filter("rank = 10").agg(F.round(F.median(F.sqrt("d2")), 6).alias("d"))


_NEAR = with_views("pts") + ", pr AS (SELECT a.pid AS a, b.pid AS b, a.dom AS dom_a, b.dom AS dom_b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.pid < b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 4000000)"


@register("J15_pairs_within", _NEAR + "SELECT a, b, d2 FROM pr")
def pairs_within(spark, sf_dir):
    return SP.pairs_within(view(spark, sf_dir, "pts"), "pid", 2000).select("a", "b", "d2")


@register("G17_J18_spacing_audit", _NEAR + """,
n1 AS (SELECT a AS pid, d2 FROM pr UNION ALL SELECT b, d2 FROM pr)
SELECT (SELECT count(*) FROM pr) AS close, (SELECT count(*) FROM pr WHERE dom_a = dom_b) AS within, (SELECT min(d2) FROM pr) AS least2, (SELECT count(DISTINCT pid) FROM n1) AS points""")
def spacing(spark, sf_dir):
    pr = SP.pairs_within(view(spark, sf_dir, "pts"), "pid", 2000, keep=("dom",))
    ends = F.explode(F.array("a", "b")).alias("p")
    points = pr.select(ends).agg(F.count_distinct("p").alias("points"))
    return pr.agg(F.count("*").alias("close"), F.count_if(F.col("dom_a") == F.col("dom_b")).alias("within"), F.min("d2").alias("least2")).withColumn("points", F.lit(points.first()[0]).cast("long"))


@register("G04_areas", BX + """
SELECT poly, abs(sum(ax * by_ - bx * ay))::BIGINT AS area2, round(sum(sqrt(((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))::DOUBLE)), 6) AS length, min(ax) AS x0, max(ay) AS y1 FROM edge GROUP BY poly""")
def areas(spark, sf_dir):
    p = polygons(spark, sf_dir)
    return p.select("poly", F.abs(G.area2(F.col("edges"))).alias("area2"), F.round(G.length(F.col("edges")), 6).alias("length"), F.array_min("edges.x1").alias("x0"), F.array_max("edges.y1").alias("y1"))


@register("G15_bounds", with_views("pts") + "SELECT dom, min(x) - 10000 AS x0, min(y) - 10000 AS y0, max(x) + 10000 AS x1, max(y) + 10000 AS y1 FROM pts GROUP BY dom")
def bounds(spark, sf_dir):
    pad = 10000
    return view(spark, sf_dir, "pts").groupBy("dom").agg((F.min("x") - pad).alias("x0"), (F.min("y") - pad).alias("y0"), (F.max("x") + pad).alias("x1"), (F.max("y") + pad).alias("y1"))


@register("G16_G18_tile_layout", with_views("pts") + """,
w AS (SELECT CAST(floor(min(x) / 30.0) AS BIGINT) AS c0, CAST(ceil(max(x) / 30.0) AS BIGINT) AS c1, CAST(floor(min(y) / 30.0) AS BIGINT) AS r0, CAST(ceil(max(y) / 30.0) AS BIGINT) AS r1 FROM pts)
SELECT i * 4096 + c0 AS col, j * 4096 + r0 AS row, least(4096, c1 - c0 - i * 4096) AS w, least(4096, r1 - r0 - j * 4096) AS h, 'r' || j || '_c' || i AS name
FROM w, unnest(range(0, (c1 - c0 + 4095) // 4096)) a(i), unnest(range(0, (r1 - r0 + 4095) // 4096)) b(j)""")
def tile_layout(spark, sf_dir):
    """The pixel window of all points, snapped outward, in tiles of 4,096 with clipped edges."""
    snap = lambda f, v: f(F.col(v) / 30).cast("long")
    p = view(spark, sf_dir, "pts").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    w = p.select(snap(F.floor, "a").alias("c0"), snap(F.ceil, "b").alias("c1"), snap(F.floor, "c").alias("r0"), snap(F.ceil, "d").alias("r1"))
    w = w.withColumn("i", F.explode(F.expr("sequence(0L, (c1 - c0 - 1) div 4096)"))).withColumn("j", F.explode(F.expr("sequence(0L, (r1 - r0 - 1) div 4096)")))
    return w.selectExpr("i * 4096 + c0 AS col", "j * 4096 + r0 AS row", "least(4096, c1 - c0 - i * 4096) AS w", "least(4096, r1 - r0 - j * 4096) AS h", "concat('r', j, '_c', i) AS name")


def _albers_sql(p: G.Albers, lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = f"({1 - p.e2!r}::DOUBLE * ({s} / (1 - {p.e2!r}::DOUBLE * {s} * {s}) - ln((1 - {p.e!r}::DOUBLE * {s}) / (1 + {p.e!r}::DOUBLE * {s})) / (2 * {p.e!r}::DOUBLE)))"
    rho = f"({p.a!r}::DOUBLE * sqrt({p.c!r}::DOUBLE - {p.n!r}::DOUBLE * {q}) / {p.n!r}::DOUBLE)"
    theta = f"({p.n!r}::DOUBLE * (radians({lon}) - {p.lon0!r}::DOUBLE))"
    return f"({p.east!r}::DOUBLE + {rho} * sin({theta}))", f"({p.north!r}::DOUBLE + {p.rho0!r}::DOUBLE - {rho} * cos({theta}))"


_LL = "(-87.0::DOUBLE + x / 65536.0::DOUBLE)", "(24.5::DOUBLE + y / 81920.0::DOUBLE)"
_XY = _albers_sql(G.CONUS, *_LL)


@register("G01_projection", with_views("pts") + f"SELECT pid, round({_XY[0]}, 4) AS px, round({_XY[1]}, 4) AS py, true AS back FROM pts")
def projection(spark, sf_dir):
    """Forward to metres, and back to the same degrees."""
    lon, lat = F.lit(-87.0) + F.col("x") / F.lit(65536.0), F.lit(24.5) + F.col("y") / F.lit(81920.0)
    p = view(spark, sf_dir, "pts").select("pid", lon.alias("lon"), lat.alias("lat"))
    x, y = G.CONUS.forward(F.col("lon"), F.col("lat"))
    p = p.withColumns({"px": x, "py": y})
    lon2, lat2 = G.CONUS.inverse(F.col("px"), F.col("py"))
    back = (F.abs(lon2 - F.col("lon")) < 1e-8) & (F.abs(lat2 - F.col("lat")) < 1e-8)
    return p.select("pid", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), back.alias("back"))


@register("G11_network_filter", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR p_type LIKE '%SMALL%'")
def network_filter(spark, sf_dir):
    """Rows known by key, or of one type."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("known")).distinct()
    return p.join(keys, "p_partkey", "left").filter("known OR p_type LIKE '%SMALL%'").select("p_partkey")
