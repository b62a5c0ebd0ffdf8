"""Matching of target objects to reference objects, image by image.

A target picks its best candidate among the references that it touches; of the targets that
picked the same reference, the first in input order keeps it, and the others stay unmatched.
Both steps are ``row_number`` windows.  The candidate join has the image as equality key (or
image and grid cell, for images with very many objects), so it never becomes a nested loop; as
the windows' keys contain the image, its partitioning serves them too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import boxes


def with_cells(objects: DataFrame, box_col: str, cell: float) -> DataFrame:
    """One row per grid cell that the object's box touches, with ``cell_x, cell_y``."""
    b = F.col(box_col)
    span = lambda low, high: F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))
    return objects.withColumn("cell_x", F.explode(span(b["x1"], b["x2"]))).withColumn("cell_y", F.explode(span(b["y1"], b["y2"])))


def candidates(refs: DataFrame, targets: DataFrame, refine: Callable[[Column, Column], Column] | None = None, cell: float | None = None) -> DataFrame:
    """Pairs of one image whose boxes touch (and that ``refine`` accepts).

    ``refs`` has ``image, ref, ref_box``, ``targets`` has ``image, target, target_box``; further
    columns are kept.  With ``cell``, both sides are spread over a grid and each pair is found in
    the one cell that holds the lower corner of the boxes' common part.
    """
    a, b = F.col("ref_box"), F.col("target_box")
    if cell is None:
        pairs = refs.join(targets, "image").where(boxes.touches(a, b))
    else:
        pairs = with_cells(refs, "ref_box", cell).join(with_cells(targets, "target_box", cell), ["image", "cell_x", "cell_y"])
        home = (F.floor(F.greatest(a["x1"], b["x1"]) / cell) == F.col("cell_x")) & (F.floor(F.greatest(a["y1"], b["y1"]) / cell) == F.col("cell_y"))
        pairs = pairs.where(boxes.touches(a, b) & home).drop("cell_x", "cell_y")
    return pairs if refine is None else pairs.where(refine(a, b))


def first_wins(pairs: DataFrame, score: str, largest: bool = True, threshold: float = -1.0, strict: bool = False) -> DataFrame:
    """The matches among candidate pairs (``image, ref, target`` and a score).

    Ties go to the lowest reference.  A positive threshold rejects scores up to it; where the
    smallest score is best, ``strict`` rejects scores above it instead (the plain rule rejects
    low, that is good, scores and is kept as the default for equal results).
    """
    order = F.col(score).desc() if largest else F.col(score).asc()
    best = pairs.withColumn("_rank", F.row_number().over(W.partitionBy("image", "target").orderBy(order, "ref"))).where("_rank = 1").drop("_rank")
    if threshold > 0:
        best = best.where(F.col(score) <= threshold if strict and not largest else F.col(score) > threshold)
    return best.withColumn("_rank", F.row_number().over(W.partitionBy("image", "ref").orderBy("target"))).where("_rank = 1").drop("_rank")


def match_boxes(refs: DataFrame, targets: DataFrame, threshold: float = 0.5, cell: float | None = None) -> DataFrame:
    """Matches by the largest IoU of boxes: ``image, ref, target, iou`` and the other columns."""
    pairs = candidates(refs, targets, cell=cell).withColumn("iou", boxes.iou(F.col("ref_box"), F.col("target_box")))
    return first_wins(pairs, "iou", True, threshold)


def unmatched(objects: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Objects (references or targets, by ``key``) without a match."""
    return objects.join(matches.select("image", key), ["image", key], "left_anti")


def matched(objects: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Objects with a match."""
    return objects.join(matches.select("image", key), ["image", key], "left_semi")


def with_metrics(matches: DataFrame, metrics: dict[str, Callable[[Column, Column], Column]], ref: str, target: str) -> DataFrame:
    """One more column per metric of a match.

    A metric that gives a struct spreads to one column per member.
    """
    out = matches.select("*", *[f(F.col(ref), F.col(target)).alias(name) for name, f in metrics.items()])
    for field in [f for f in out.schema.fields if f.name in metrics and f.dataType.typeName() == "struct"]:
        out = out.select(*[c for c in out.columns if c != field.name], f"`{field.name}`.*")
    return out


def vertex_errors(pairs: DataFrame, ref: str = "ref_ring", target: str = "target_ring") -> DataFrame:
    """Per reference vertex the nearest of the target vertices that are nearest to it.

    ``pairs`` has ``image, pair`` and two rings.  Each target vertex (the closing one too) goes to
    its nearest reference vertex; a reference vertex keeps the smallest distance, the first on
    ties; vertices that none goes to are absent.
    """
    closed = F.concat(F.col(target), F.slice(F.col(target), 1, 1))
    rows = pairs.select("image", "pair", F.col(ref).alias("_ref"), F.posexplode(closed).alias("pred_ord", "p"))
    rows = rows.select("image", "pair", "pred_ord", "p", F.posexplode("_ref").alias("gt_ord", "g"))
    rows = rows.withColumn("distance", F.hypot(F.col("p.x") - F.col("g.x"), F.col("p.y") - F.col("g.y")))
    nearest = rows.withColumn("_r", F.row_number().over(W.partitionBy("image", "pair", "pred_ord").orderBy("distance", "gt_ord"))).where("_r = 1")
    kept = nearest.withColumn("_r", F.row_number().over(W.partitionBy("image", "pair", "gt_ord").orderBy("distance", "pred_ord"))).where("_r = 1")
    return kept.select("image", "pair", "gt_ord", "pred_ord", F.col("g").alias("gt_vertex"), F.col("p").alias("pred_vertex"), "distance")
