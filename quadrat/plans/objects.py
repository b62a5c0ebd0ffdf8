"""Matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import boxes, geometry
from quadrat.operators import kernels, logs, matching, tiles
from quadrat.plans.derived import BOXES_SQL, references, rings, rings_sql, targets
from quadrat.session import table

_R, _T = "ref_box", "target_box"


def _matches(spark: SparkSession, sf_dir: str, cell: float | None = None) -> DataFrame:
    return matching.match_boxes(references(spark, sf_dir), targets(spark, sf_dir), 0.5, cell)


def match_iou_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image: matches and what is left, with the mean IoU (the flagship)."""
    m = _matches(spark, sf_dir)
    per_image = m.groupBy("image").agg(F.count("*").alias("n_matches"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.sum(boxes.intersection(F.col(_R), F.col(_T))), 6).alias("shared"))
    n = references(spark, sf_dir).groupBy("image").agg(F.count("*").alias("n_refs"))
    return n.join(per_image, "image", "left").select("image", "n_refs", F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"), "mean_iou", "shared")


def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches themselves."""
    return _matches(spark, sf_dir).select("image", "ref", "target", F.round("iou", 6).alias("iou"))


def match_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches, with candidates from a grid (for images with very many objects)."""
    return _matches(spark, sf_dir, 40.0).select("image", "ref", "target", F.round("iou", 6).alias("iou"))


def unmatched_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a match."""
    return matching.unmatched(references(spark, sf_dir), _matches(spark, sf_dir), "ref").select("image", "ref")


def unmatched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets without a match."""
    return matching.unmatched(targets(spark, sf_dir), _matches(spark, sf_dir), "target").select("image", "target")


def matched_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with a match."""
    return matching.matched(references(spark, sf_dir), _matches(spark, sf_dir), "ref").select("image", "ref")


def match_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by the smallest distance of the lower corners, without a threshold."""
    a, b = F.col(_R), F.col(_T)
    pairs = matching.candidates(references(spark, sf_dir), targets(spark, sf_dir)).withColumn("gap", F.round(F.hypot(a["x1"] - b["x1"], a["y1"] - b["y1"]), 6))
    return matching.first_wins(pairs, "gap", largest=False).select("image", "ref", "target", "gap")


def _ring(b: str):
    c = F.col(b)
    return geometry.ring((c["x1"], c["y1"]), (c["x2"], c["y1"]), (c["x2"], c["y2"]), (c["x1"], c["y2"]))


def _by_distance(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    pairs = matching.candidates(references(spark, sf_dir), targets(spark, sf_dir)).select("image", "ref", "target", _ring(_R).alias("a"), _ring(_T).alias("b"))
    scored = kernels.with_ring_distance(pairs, "a", "b", kind).withColumn("distance", F.round("distance", 6))
    return matching.first_wins(scored, "distance", largest=False).select("image", "ref", "target", "distance")


def match_hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by the smallest Hausdorff distance of the boxes' rings."""
    return _by_distance(spark, sf_dir, "hausdorff")


def match_frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by the smallest discrete Fréchet distance of the boxes' rings."""
    return _by_distance(spark, sf_dir, "frechet")


def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric columns of each match."""
    metrics = {"iou": boxes.iou, "inter": boxes.intersection, "ios": boxes.ios}
    m = matching.with_metrics(_matches(spark, sf_dir).drop("iou"), metrics, _R, _T)
    return m.select("image", "ref", "target", *[F.round(c, 6).alias(c) for c in metrics])


def vertex_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest predicted vertex of each vertex that is hit."""
    pairs = rings(spark, sf_dir).select(F.col("id").alias("image"), F.lit(0).alias("pair"), F.col("a").alias("ref_ring"), F.col("b").alias("target_ring"))
    e = matching.vertex_errors(pairs)
    return e.select(F.col("image").alias("id"), F.col("gt_ord").cast("bigint").alias("gt_ord"), F.col("pred_ord").cast("bigint").alias("pred_ord"), F.round("distance", 6).alias("distance"))


def positional_box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean IoU of the i-th reference with the i-th target; 0 without a target."""
    by = W.partitionBy("image")
    a = references(spark, sf_dir).withColumn("pos", F.row_number().over(by.orderBy("ref")))
    b = targets(spark, sf_dir).withColumn("pos", F.row_number().over(by.orderBy("target")))
    scored = a.join(b, ["image", "pos"], "left").withColumn("iou", F.coalesce(boxes.iou(F.col(_R), F.col(_T)), F.lit(0.0)))
    return scored.groupBy("image").agg(F.round(F.avg("iou"), 6).alias("mean_iou"))


def xywh_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in the other notation and back."""
    b = references(spark, sf_dir).select("image", "ref", boxes.to_xywh(F.col(_R)).alias("b"), F.col(_R))
    back = boxes.convert_box(F.array("b.x", "b.y", "b.w", "b.h"), "xywh", "xyxy")
    return b.select("image", "ref", "b.x", "b.y", "b.w", "b.h", back[2].alias("x2"), back[3].alias("y2"))


def shift_crop_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved by their tile, clamped to 150 x 120, without degenerate ones."""
    moved = boxes.shift(F.col(_R), F.lit(20.0), F.lit(30.0))
    b = references(spark, sf_dir).select("image", "ref", boxes.crop(moved, F.lit(150), F.lit(120)).alias("b"))
    return b.where(~boxes.degenerate(F.col("b"))).select("image", "ref", "b.*")


def extended_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a margin of a tenth, clamped to 230 x 120, and the scale of their crop."""
    b = references(spark, sf_dir).select("image", "ref", boxes.extended(F.col(_R), F.lit(120), F.lit(230)).alias("b"))
    scale = lambda a, c: F.round(boxes.crop_scale(F.col(a) - F.col(c)), 6)
    return b.select("image", "ref", "b.*").select("*", scale("x2", "x1").alias("scale_w"), scale("y2", "y1").alias("scale_h"))


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets(spark, sf_dir)
    return t.select("image", F.col("target").alias("det"), f"{_T}.*", (F.pmod(F.col("target") * 37 + F.col("image"), F.lit(100)) / 100).alias("score"), F.lit(1).alias("label"))


def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-maximum suppression per image."""
    return kernels.nms(_detections(spark, sf_dir))


def union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping detections of a tile merged in their image."""
    d = _detections(spark, sf_dir).withColumns({"row0": F.lit(10), "col0": F.lit(5), "height": F.lit(220), "width": F.lit(120)})
    return tiles.merge_detections(d)


def map_at_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision at IoU 0.5 per label (the priority of the order)."""
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("label")).distinct()
    hits = _matches(spark, sf_dir).select("image", F.col("target").alias("det"), F.lit(True).alias("hit"))
    d = _detections(spark, sf_dir).join(hits, ["image", "det"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("label").join(labels, "image")
    totals = references(spark, sf_dir).join(labels, "image").groupBy("label").agg(F.count("*").alias("n_truth"))
    d = d.withColumn("order", F.col("image") * 1000 + F.col("det"))
    return logs.average_precision(d, totals, ["label"], "score", "hit", "order").select("label", F.round("ap", 6).alias("ap"))


QUERIES = {
    f.__name__: f
    for f in (match_iou_boxes, match_pairs, match_pairs_grid, unmatched_refs, unmatched_targets, matched_semi, match_centres, match_hausdorff, match_frechet, match_metrics, vertex_errors)
} | {f.__name__: f for f in (positional_box_iou, xywh_xyxy, shift_crop_drop, extended_bounds, nms_boxes, union_merge, map_at_50)}

_HELD = ", held AS MATERIALIZED (SELECT image, ref, target FROM matches) "
_RANKED = (
    BOXES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", d AS (SELECT image, target AS det, trunc(tx1 + {0}) AS x1, trunc(ty1 + {1}) AS y1, trunc(tx2 + {0}) AS x2, trunc(ty2 + {1}) AS y2, ((target * 37 + image) % 100) / 100.0::DOUBLE AS score FROM tgts), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, det) AS k FROM d), "
)
_LAP = "(greatest(least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1), 0) * greatest(least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1), 0))"
_SIZE = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
_IOU = f"({_LAP} / nullif({_SIZE.format('{0}')} + {_SIZE.format('{1}')} - {_LAP}, 0))"
_BOX = "{{'x1': {0}.x1, 'y1': {0}.y1, 'x2': {0}.x2, 'y2': {0}.y2, 'score': {0}.score}}"
# Greedy suppression: the best box stays, and each further one unless a kept one overlaps it too much.
_NMS = (
    _RANKED.format(0, 0)
    + f"s AS (SELECT image, k, det, true AS stays, [{_BOX.format('k')}] AS kept FROM k WHERE k = 1 UNION ALL "
    f"SELECT n.image, n.k, n.det, n.stays, CASE WHEN n.stays THEN list_append(n.kept, {_BOX.format('n')}) ELSE n.kept END FROM "
    f"(SELECT k.*, s.kept, len(list_filter(s.kept, lambda b: coalesce({_IOU.format('b', 'k')}, 0) > 0.5)) = 0 AS stays FROM s JOIN k ON k.image = s.image AND k.k = s.k + 1) n) "
    "SELECT s.image, s.det, t.tx1 AS x1, t.ty1 AS y1, t.tx2 AS x2, t.ty2 AS y2, d.score, 1 AS label FROM s JOIN d ON d.image = s.image AND d.det = s.det JOIN tgts t ON t.image = s.image AND t.target = s.det WHERE s.stays"
)
# Greedy union: a box grows over each of the remaining ones in turn that overlaps it too much; the others wait.
_GROWN = "{'x1': least(now.x1, todo[1].x1), 'y1': least(now.y1, todo[1].y1), 'x2': greatest(now.x2, todo[1].x2), 'y2': greatest(now.y2, todo[1].y2), 'score': greatest(now.score, todo[1].score)}"
_UNION = (
    _RANKED.format(10, 5)
    + f"l AS (SELECT image, list({_BOX.format('k')} ORDER BY k) AS boxes FROM k GROUP BY image), "
    "s AS (SELECT image, 0 AS det, boxes[1] AS now, boxes[2:] AS todo, [boxes[1]][2:] AS wait, false AS done FROM l UNION ALL "
    "SELECT image, CASE WHEN done THEN det + 1 ELSE det END, "
    f"CASE WHEN done THEN wait[1] WHEN len(todo) > 0 AND over THEN {_GROWN} ELSE now END, "
    "CASE WHEN done THEN wait[2:] ELSE todo[2:] END, "
    "CASE WHEN done THEN wait[1:0] WHEN len(todo) > 0 AND NOT over THEN list_append(wait, todo[1]) ELSE wait END, "
    "NOT done AND len(todo) = 0 "
    f"FROM (SELECT *, coalesce({_IOU.format('now', '(todo[1])')}, 0) > 0.5 AS over FROM s) WHERE NOT (done AND len(wait) = 0)), "
    "o AS (SELECT image, det, greatest(0, least({0}, now.x1)) AS x1, greatest(0, least({1}, now.y1)) AS y1, greatest(0, least({0}, now.x2)) AS x2, greatest(0, least({1}, now.y2)) AS y2, now.score AS score FROM s WHERE done) "
    "SELECT image, det::BIGINT AS det, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, score, 1 AS label FROM o WHERE x1 <> x2 AND y1 <> y2"
).replace("{0}", "220").replace("{1}", "120")
_PAIRS = BOXES_SQL + "SELECT image, ref, target, round(iou, 6) AS iou FROM matches"
_SMALLEST = (
    BOXES_SQL
    + ", d AS ({0}), b2 AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image, target ORDER BY {1}, ref) = 1) "
    + "SELECT image, ref, target, {1} FROM b2 QUALIFY row_number() OVER (PARTITION BY image, ref ORDER BY target) = 1"
)
_EXTENDED = "round_even(0.1::DOUBLE * ({0}2 - {0}1), 0)"


def _corner(side: str, k: int) -> tuple[str, str]:
    return (f"{side}x{1 if k in (0, 3) else 2}", f"{side}y{1 if k in (0, 1) else 2}")


def _gap(p: tuple[str, str], q: tuple[str, str]) -> str:
    return f"sqrt(({p[0]} - {q[0]}) * ({p[0]} - {q[0]}) + ({p[1]} - {q[1]}) * ({p[1]} - {q[1]}))"


def _to_box(p: tuple[str, str], s: str) -> str:
    """Distance of a point to the outline of a box: outside to the box, inside to its nearest side."""
    x, y = p
    dx, dy = f"greatest({s}x1 - {x}, 0, {x} - {s}x2)", f"greatest({s}y1 - {y}, 0, {y} - {s}y2)"
    inner = f"least({x} - {s}x1, {s}x2 - {x}, {y} - {s}y1, {s}y2 - {y})"
    return f"CASE WHEN {inner} > 0 THEN {inner} ELSE sqrt({dx} * {dx} + {dy} * {dy}) END"


_HAUSDORFF = "greatest(" + ", ".join([_to_box(_corner("r", k), "t") for k in range(4)] + [_to_box(_corner("t", k), "r") for k in range(4)]) + ")"


def _frechet_sql() -> str:
    cells = []
    for i in range(5):
        for j in range(5):
            d = _gap(_corner("r", i % 4), _corner("t", j % 4))
            before = [f"c{a}{b}" for a, b in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if a >= 0 and b >= 0]
            cells.append(f"{f'greatest({d}, least({', '.join(before)}))' if before else d} AS c{i}{j}")
    return "SELECT *, " + ", ".join(cells) + ", round(c44, 6) AS distance FROM cand"


_NEAREST = (
    rings_sql()
    + "SELECT id, gt_ord::BIGINT AS gt_ord, pred_ord::BIGINT AS pred_ord, round(distance, 6) AS distance FROM (SELECT * FROM (SELECT p.id, p.ord AS pred_ord, g.ord AS gt_ord, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS distance "
    "FROM (SELECT * FROM vb UNION ALL SELECT id, 4, x, y FROM vb WHERE ord = 0) p JOIN va g USING (id)) "
    "QUALIFY row_number() OVER (PARTITION BY id, pred_ord ORDER BY distance, gt_ord) = 1) QUALIFY row_number() OVER (PARTITION BY id, gt_ord ORDER BY distance, pred_ord) = 1"
)

SQL = {
    "match_iou_boxes": BOXES_SQL
    + "SELECT r.image, count(DISTINCT r.ref) AS n_refs, count(m.ref) AS n_matches, round(avg(m.iou), 6) AS mean_iou, round(sum(m.inter), 6) AS shared FROM refs r LEFT JOIN matches m ON m.image = r.image AND m.ref = r.ref GROUP BY r.image",
    "match_pairs": _PAIRS,
    "match_pairs_grid": _PAIRS,
    "unmatched_refs": BOXES_SQL + _HELD + "SELECT r.image, r.ref FROM refs r LEFT JOIN held m ON m.image = r.image AND m.ref = r.ref WHERE m.ref IS NULL",
    "unmatched_targets": BOXES_SQL + _HELD + "SELECT t.image, t.target FROM tgts t LEFT JOIN held m ON m.image = t.image AND m.target = t.target WHERE m.target IS NULL",
    "matched_semi": BOXES_SQL + _HELD + "SELECT r.image, r.ref FROM refs r JOIN held m ON m.image = r.image AND m.ref = r.ref",
    "match_centres": _SMALLEST.format(f"SELECT *, round({_gap(('rx1', 'ry1'), ('tx1', 'ty1'))}, 6) AS gap FROM cand", "gap"),
    "match_hausdorff": _SMALLEST.format(f"SELECT *, round({_HAUSDORFF}, 6) AS distance FROM cand", "distance"),
    "match_frechet": _SMALLEST.format(_frechet_sql(), "distance"),
    "match_metrics": BOXES_SQL
    + "SELECT image, ref, target, round(iou, 6) AS iou, round(inter, 6) AS inter, round(inter / least((rx2 - rx1) * (ry2 - ry1), (tx2 - tx1) * (ty2 - ty1)), 6) AS ios FROM matches",
    "vertex_errors": _NEAREST,
    "positional_box_iou": BOXES_SQL
    + ", a AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ref) AS pos FROM refs), b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY target) AS pos FROM tgts), "
    "s AS (SELECT a.image, greatest(least(rx2, tx2) - greatest(rx1, tx1), 0) * greatest(least(ry2, ty2) - greatest(ry1, ty1), 0) AS i, (rx2 - rx1) * (ry2 - ry1) + (tx2 - tx1) * (ty2 - ty1) AS s FROM a LEFT JOIN b ON b.image = a.image AND b.pos = a.pos) "
    "SELECT image, round(avg(coalesce(i / (s - i), 0)), 6) AS mean_iou FROM s GROUP BY image",
    "xywh_xyxy": BOXES_SQL + "SELECT image, ref, rx1 AS x, ry1 AS y, rx2 - rx1 AS w, ry2 - ry1 AS h, rx2 AS x2, ry2 AS y2 FROM refs",
    "shift_crop_drop": BOXES_SQL
    + "SELECT * FROM (SELECT image, ref, greatest(0, least(150, rx1 + 20))::DOUBLE AS x1, greatest(0, least(120, ry1 + 30))::DOUBLE AS y1, greatest(0, least(150, rx2 + 20))::DOUBLE AS x2, greatest(0, least(120, ry2 + 30))::DOUBLE AS y2 FROM refs) WHERE NOT (x1 = x2 OR y1 = y2)",
    "extended_bounds": BOXES_SQL
    + f", e AS (SELECT image, ref, greatest(0, rx1 - {_EXTENDED.format('rx')})::DOUBLE AS x1, greatest(0, ry1 - {_EXTENDED.format('ry')})::DOUBLE AS y1, least(230, rx2 + {_EXTENDED.format('rx')})::DOUBLE AS x2, least(120, ry2 + {_EXTENDED.format('ry')})::DOUBLE AS y2 FROM refs) "
    "SELECT *, round(224::DOUBLE / nullif(x2 - x1, 0), 6) AS scale_w, round(224::DOUBLE / nullif(y2 - y1, 0), 6) AS scale_h FROM e",
    "nms_boxes": _NMS,
    "union_merge": _UNION,
    "map_at_50": BOXES_SQL
    + ", lab AS (SELECT DISTINCT o_orderkey AS image, o_orderpriority AS label FROM orders), det AS (SELECT l.label, t.image, t.target, ((t.target * 37 + t.image) % 100) / 100.0::DOUBLE AS score, m.ref IS NOT NULL AS hit FROM tgts t JOIN lab l USING (image) LEFT JOIN matches m ON m.image = t.image AND m.target = t.target), "
    "tot AS (SELECT label, count(*) AS n FROM refs JOIN lab USING (image) GROUP BY label), "
    "cur AS (SELECT label, n, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k FROM det JOIN tot USING (label) WINDOW w AS (PARTITION BY label ORDER BY score DESC, image * 1000 + target ROWS UNBOUNDED PRECEDING)), "
    "bins AS (SELECT label, floor(tp / n::DOUBLE * 100 + 1e-9)::INT AS r, max(tp / k::DOUBLE) AS p FROM cur GROUP BY ALL) "
    "SELECT t.label, round(coalesce(sum((SELECT max(p) FROM bins b WHERE b.label = t.label AND b.r >= g.r)), 0) / 101, 6) AS ap FROM tot t, range(101) g(r) GROUP BY t.label",
}
