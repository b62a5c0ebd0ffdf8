"""Geometry and token-sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import sequences as s
from quadrat.operators import contour_metrics, kernels, lines, tiles
from quadrat.plans.derived import rings, rings_sql
from quadrat.session import spread



def poly_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and length of rings."""
    return rings(spark, sf_dir).select("id", F.round(g.area(F.col("b")), 6).alias("area"), F.round(g.length(F.col("b")), 6).alias("length"))


def poly_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around rings."""
    return rings(spark, sf_dir).select("id", g.bounds(F.col("b")).alias("b")).select("id", "b.*")


def boundary_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the closed boundary line, numbered."""
    r = rings(spark, sf_dir).select("id", F.posexplode(g.handled("LINE", F.col("a"))).alias("ord", "p"))
    return r.select("id", F.col("ord").cast("bigint").alias("ord"), "p.x", "p.y")


def affine_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings in world coordinates, and the area back in pixels."""
    t = [F.lit(v) for v in (2.0, 0.5, 100.0, -0.25, -2.0, 900.0)]
    w = rings(spark, sf_dir).select("id", g.affine(F.col("a"), *t).alias("w"))
    back = g.affine_inverse(F.col("w"), *t)
    return w.select("id", F.round(g.area(F.col("w")), 6).alias("world_area"), F.round(g.area(back), 6).alias("pixel_area"))


def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along rings, every two units."""
    r = rings(spark, sf_dir).select("id", F.posexplode(g.densify(F.col("b"), 2.0)).alias("ord", "p"))
    return r.select("id", F.col("ord").cast("bigint").alias("ord"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def polis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric mean vertex distance of two rings."""
    return rings(spark, sf_dir).select("id", F.round(g.batch_polis(F.col("a"), F.col("b")), 6).alias("polis"))


def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hausdorff distance of two rings."""
    return rings(spark, sf_dir).select("id", F.round(g.hausdorff(F.col("a"), F.col("b")), 6).alias("hausdorff"))


def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete Fréchet distance of two rings."""
    return rings(spark, sf_dir).select("id", F.round(g.frechet(F.col("a"), F.col("b")), 6).alias("frechet"))


def polygon_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of ring a's box and that box moved by (2, 1), both taken as polygons."""
    box = lambda dx, dy: g.ring(*[(x + dx, y + dy) for x, y in ((F.col("x0"), F.col("y0")), (F.col("x0") + F.col("w"), F.col("y0")), (F.col("x0") + F.col("w"), F.col("y0") + F.col("h")), (F.col("x0"), F.col("y0") + F.col("h")))])
    o = kernels.with_polygon_iou(spread(rings(spark, sf_dir), "id").select("id", box(0, 0).alias("p"), box(2, 1).alias("q")), "p", "q")
    return o.select("id", *[F.round(c, 6).alias(c) for c in ("iou", "inter", "uni")])


def nearest_vertex_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first vertex of b falls on the line of a."""
    p = rings(spark, sf_dir).select("id", g.nearest_point(F.col("b")[0], F.col("a")).alias("n"))
    return p.select("id", F.round("n.d", 6).alias("d"), F.round("n.x", 6).alias("x"), F.round("n.y", 6).alias("y"))


def equal_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rings, however they start and turn: reversed and rotated copies fold together."""
    r = rings(spark, sf_dir)
    turned = F.reverse(F.concat(F.slice("a", 3, 2), F.slice("a", 1, 2)))
    both = r.select(g.canonical(F.col("a")).alias("r")).unionByName(r.select(g.canonical(turned).alias("r")))
    return both.groupBy("r").agg(F.count("*").alias("n")).select(F.col("r")[0]["x"].alias("x"), F.col("r")[0]["y"].alias("y"), F.round(g.area(F.col("r")), 6).alias("area"), "n")


def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings after simplification: the points added along their edges go again."""
    dense = rings(spark, sf_dir).select("id", g.opened(g.densify(F.col("a"), 2.0)).alias("r"))
    return kernels.simplify(dense, "r", 0.01).select("id", F.size("r").cast("bigint").alias("n_vertices"), F.round(g.area(F.col("r")), 6).alias("area"))


def turning_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge vectors and signed turning angles at the vertices of closed lines."""
    v = lines.turning_angles(lines.explode_ring(rings(spark, sf_dir), ["id"], "a"), ["id"])
    return v.select("id", F.col("ord").cast("bigint").alias("ord"), "dx", "dy", F.round("angle", 6).alias("angle"))


def corner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of closed lines between vertices that turn by more than 1.58 radians."""
    v = lines.corners(lines.turning_angles(lines.explode_ring(rings(spark, sf_dir), ["id"], "a"), ["id"]), 1.58)
    p = lines.subpaths(v, ["id"])
    return p.select("id", F.col("ord").cast("bigint").alias("ord"), "is_corner", F.col("piece").cast("bigint").alias("piece"))


def junction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all lines of a block around their common point, by angle."""
    v = lines.edge_vectors(lines.explode_ring(rings(spark, sf_dir), ["id"], "a"), ["id"])
    e = v.select(F.floor(F.col("id") / 5).cast("bigint").alias("junction"), (F.col("id") * 4 + F.col("ord")).cast("bigint").alias("edge"), "dx", "dy")
    j = lines.junction_order(e, ["junction"])
    return j.select("junction", "edge", F.col("rank").cast("bigint").alias("rank"), "next_edge")


def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of rings."""
    t = rings(spark, sf_dir, 3.0).select("id", F.posexplode(s.encode(F.col("a"), 20)).alias("k", "token"))
    return t.select("id", F.col("k").cast("bigint").alias("k"), F.col("token").cast("bigint").alias("token"))


def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell centres that come back from the tokens."""
    tokens = s.encode(F.col("a"), 20)
    t = rings(spark, sf_dir, 3.0).select("id", F.posexplode(s.decode(F.slice(tokens, 3, 18))).alias("k", "p"))
    return t.select("id", F.col("k").cast("bigint").alias("k"), "p.x", "p.y")


def polygon_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal tokens of two rings."""
    return rings(spark, sf_dir, 3.0).select("id", F.round(s.token_accuracy(s.encode(F.col("a"), 20), s.encode(F.col("b"), 20)), 6).alias("accuracy"))


def teacher_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of a token sequence used in training."""
    v = rings(spark, sf_dir, 3.0).select("id", s.views(s.encode(F.col("a"), 12)).alias("v"))
    text = lambda c: F.array_join(F.col(f"v.{c}").cast("array<string>"), " ")
    return v.select("id", F.col("v.first").cast("bigint").alias("first"), text("inputs").alias("inputs"), text("shifted").alias("shifted"), text("targets").alias("targets"))


def tangent_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest angle between the outline of b and that of a."""
    e = contour_metrics.with_tangent_angle_error(spread(rings(spark, sf_dir), "id").select("id", "a", "b"), "a", "b")
    return e.select("id", F.round("angle_error", 6).alias("angle_error"))


def convert_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object: its crop with a margin and scale."""
    o = rings(spark, sf_dir, 3.0).select(F.col("id").alias("image"), F.lit(0).alias("pos"), F.col("b").alias("ring"), F.lit(180).alias("width"), F.lit(90).alias("height"))
    c = tiles.object_crops(o)
    return c.select(F.col("image").alias("id"), "min_col", "min_row", F.round("scale_w", 6).alias("scale_w"), F.round("scale_h", 6).alias("scale_h"), F.round(F.col("crop")[0]["x"], 4).alias("x"), F.round(F.col("crop")[0]["y"], 4).alias("y"))


QUERIES = {
    f.__name__: f
    for f in (poly_area, poly_bounds, boundary_vertices, affine_roundtrip, densify, polis, hausdorff, frechet, polygon_iou, nearest_vertex_point, equal_rings, simplify)
} | {f.__name__: f for f in (turning_angles, corner_split, junction_order, encode_tokens, decode_tokens, polygon_accuracy, teacher_views, tangent_angles, convert_objects)}

_BASE = rings_sql()
_SEG_T = "greatest(0, least(1, coalesce(((p.x - e.x) * (e.nx - e.x) + (p.y - e.y) * (e.ny - e.y)) / nullif((e.nx - e.x) * (e.nx - e.x) + (e.ny - e.y) * (e.ny - e.y), 0), 0)))"
_SEG = f"sqrt(pow(p.x - e.x - {_SEG_T} * (e.nx - e.x), 2) + pow(p.y - e.y - {_SEG_T} * (e.ny - e.y), 2))"
_DIST = _BASE + f", da AS (SELECT p.id, p.ord, min({_SEG}) AS d FROM va p JOIN eb e USING (id) GROUP BY ALL), db AS (SELECT p.id, p.ord, min({_SEG}) AS d FROM vb p JOIN ea e USING (id) GROUP BY ALL) "


def _frechet_sql() -> str:
    wide = ["SELECT id, " + ", ".join(f"max(x) FILTER (ord = {k}) AS {n}x{k}, max(y) FILTER (ord = {k}) AS {n}y{k}" for k in range(4)) + f" FROM v{n} GROUP BY id" for n in "ab"]
    cells = []
    for i in range(5):
        for j in range(5):
            p, q = i % 4, j % 4
            d = f"sqrt((ax{p} - bx{q}) * (ax{p} - bx{q}) + (ay{p} - by{q}) * (ay{p} - by{q}))"
            before = [f"c{a}{b}" for a, b in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if a >= 0 and b >= 0]
            cells.append(f"{f'greatest({d}, least({', '.join(before)}))' if before else d} AS c{i}{j}")
    return _BASE + f", wa AS ({wide[0]}), wb AS ({wide[1]}), c AS (SELECT id, {', '.join(cells)} FROM wa JOIN wb USING (id)) SELECT id, round(c44, 6) AS frechet FROM c"


_TRIPLE = rings_sql(3.0)
_CELL = "floor((({0}::FLOAT + 0.5::FLOAT) / 224::FLOAT)::FLOAT * 28::FLOAT)::BIGINT"


def _tokens_sql(side: str, length: int) -> str:
    token = f"{_CELL.format('x')} + 28 * {_CELL.format('y')}"
    return (
        f"t{side} AS (SELECT b.id, k, CASE WHEN k < 2 THEN 0 WHEN k < 6 THEN (SELECT {token} FROM v{side} v WHERE v.id = b.id AND v.ord = k - 2) WHEN k = 6 OR k % 7 = 6 THEN 784 WHEN k % 7 = 0 THEN 785 WHEN k % 7 = 1 THEN 786 "
        f"ELSE (SELECT {token} FROM v{side} v WHERE v.id = b.id AND v.ord = k % 7 - 2) END::BIGINT AS token FROM base b, range({length}) r(k))"
    )


_JOIN = lambda c, a, b: f"(SELECT string_agg(token::VARCHAR, ' ' ORDER BY k) FROM ta t WHERE t.id = b.id AND k BETWEEN {a} AND {b}) AS {c}"
_ANGLE = (
    _BASE
    + ", e AS (SELECT id, ord, nx - x AS dx, ny - y AS dy FROM ea), n AS (SELECT e.id, e.ord, e.dx, e.dy, atan2(p.dx * e.dy - p.dy * e.dx, p.dx * e.dx + p.dy * e.dy) AS angle FROM e JOIN e p ON p.id = e.id AND p.ord = (e.ord + 3) % 4) "
)
SQL = {
    "poly_area": _BASE + "SELECT id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 6) AS length FROM eb GROUP BY id",
    "poly_bounds": _BASE + "SELECT id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM vb GROUP BY id",
    "boundary_vertices": _BASE + "SELECT id, ord::BIGINT AS ord, x, y FROM va UNION ALL SELECT id, 4, x, y FROM va WHERE ord = 0",
    "affine_roundtrip": _BASE + "SELECT id, round(abs(sum(x * ny - nx * y)) / 2 * 3.875::DOUBLE, 6) AS world_area, round(abs(sum(x * ny - nx * y)) / 2, 6) AS pixel_area FROM ea GROUP BY id",
    "densify": _BASE
    + ", l AS (SELECT *, greatest(1, round_even(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 2, 0))::BIGINT AS n FROM eb), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, sum(n) OVER (PARTITION BY id)::BIGINT AS whole FROM l) "
    "SELECT id, b + i AS ord, round(x + (nx - x) * i / n, 6) AS x, round(y + (ny - y) * i / n, 6) AS y FROM o, LATERAL (SELECT unnest(range(n)) AS i) UNION ALL SELECT id, whole, x, y FROM o WHERE ord = 0",
    "polis": _DIST + "SELECT id, round((SELECT sum(d) FROM da WHERE da.id = base.id) / 10 + (SELECT sum(d) FROM db WHERE db.id = base.id) / 10, 6) AS polis FROM base",
    "hausdorff": _DIST + "SELECT id, round(greatest((SELECT max(d) FROM da WHERE da.id = base.id), (SELECT max(d) FROM db WHERE db.id = base.id)), 6) AS hausdorff FROM base",
    "frechet": _frechet_sql(),
    "polygon_iou": _BASE + ", o AS (SELECT id, greatest(w - 2, 0) * greatest(h - 1, 0) AS i, 2 * w * h AS s FROM base) SELECT id, round(i / (s - i), 6) AS iou, round(i, 6) AS inter, round(s - i, 6) AS uni FROM o",
    "nearest_vertex_point": _BASE
    + f", f AS (SELECT p.id, e.ord, {_SEG} AS d, e.x + {_SEG_T} * (e.nx - e.x) AS fx, e.y + {_SEG_T} * (e.ny - e.y) AS fy FROM vb p JOIN ea e USING (id) WHERE p.ord = 0) "
    "SELECT id, round(d, 6) AS d, round(fx, 6) AS x, round(fy, 6) AS y FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 9), ord) = 1",
    "equal_rings": _BASE + "SELECT x0 AS x, y0 AS y, round((w + w + 1) / 2 * h, 6) AS area, 2 * count(*) AS n FROM base GROUP BY x0, y0, w, h",
    "simplify": _BASE + "SELECT id, 4::BIGINT AS n_vertices, round((w + w + 1) / 2 * h, 6) AS area FROM base",
    "turning_angles": _ANGLE + "SELECT id, ord::BIGINT AS ord, dx, dy, round(angle, 6) AS angle FROM n",
    "corner_split": _ANGLE
    + ", c AS (SELECT id, ord, (abs(angle) > 1.58)::INT AS is_corner FROM n), s AS (SELECT *, sum(is_corner) OVER (PARTITION BY id ORDER BY ord)::BIGINT AS k FROM c) SELECT id, ord::BIGINT AS ord, is_corner, CASE WHEN k = 0 THEN max(k) OVER (PARTITION BY id) ELSE k END AS piece FROM s",
    "junction_order": _ANGLE
    + ", j AS (SELECT (id // 5)::BIGINT AS junction, (id * 4 + ord)::BIGINT AS edge, atan2(dy, dx) AS a FROM n), o AS (SELECT junction, edge, row_number() OVER (PARTITION BY junction ORDER BY a, edge) AS rank, count(*) OVER (PARTITION BY junction) AS m FROM j) SELECT o.junction, o.edge, o.rank, p.edge AS next_edge FROM o JOIN o p ON p.junction = o.junction AND p.rank = o.rank % o.m + 1",
    "encode_tokens": _TRIPLE + ", " + _tokens_sql("a", 20) + " SELECT id, k::BIGINT AS k, token FROM ta",
    "decode_tokens": _TRIPLE + f"SELECT id, ord::BIGINT AS k, ({_CELL.format('x')} * 8 + 4)::DOUBLE AS x, ({_CELL.format('y')} * 8 + 4)::DOUBLE AS y FROM va",
    "polygon_accuracy": _TRIPLE + ", " + _tokens_sql("a", 20) + ", " + _tokens_sql("b", 20) + " SELECT id, round(sum((ta.token = tb.token)::INT) / 18.0::DOUBLE, 6) AS accuracy FROM ta JOIN tb USING (id, k) WHERE k >= 2 GROUP BY id",
    "teacher_views": _TRIPLE + ", " + _tokens_sql("a", 12) + " SELECT id, (SELECT token FROM ta t WHERE t.id = b.id AND k = 2) AS first, " + ", ".join(_JOIN(c, a, z) for c, a, z in (("inputs", 0, 9), ("shifted", 1, 10), ("targets", 2, 11))) + " FROM base b",
    "convert_objects": _TRIPLE
    + ", e AS (SELECT id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM vb GROUP BY id), m AS (SELECT id, greatest(0, x1 - round_even(0.1::DOUBLE * (x2 - x1), 0))::DOUBLE AS min_col, greatest(0, y1 - round_even(0.1::DOUBLE * (y2 - y1), 0))::DOUBLE AS min_row, least(180, x2 + round_even(0.1::DOUBLE * (x2 - x1), 0))::DOUBLE AS mc, least(90, y2 + round_even(0.1::DOUBLE * (y2 - y1), 0))::DOUBLE AS mr FROM e) "
    "SELECT m.id, min_col, min_row, round(224::DOUBLE / (mc - min_col), 6) AS scale_w, round(224::DOUBLE / (mr - min_row), 6) AS scale_h, round(greatest(0, least(223, (v.x - min_col) * (224::DOUBLE / (mc - min_col)))), 4)::DOUBLE AS x, round(greatest(0, least(223, (v.y - min_row) * (224::DOUBLE / (mr - min_row)))), 4)::DOUBLE AS y FROM m JOIN vb v ON v.id = m.id AND v.ord = 0 WHERE mc > min_col AND mr > min_row",
}
