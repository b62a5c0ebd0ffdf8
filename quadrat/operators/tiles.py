"""Tiles of images, and what comes back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import boxes
from quadrat.operators.kernels import nms, union_merge


def tile_origins(images: DataFrame, tile: int, step: int, width: str = "width", height: str = "height") -> DataFrame:
    """One row per tile: ``tile_no, row0, col0``; the image is padded up to whole steps."""

    def count(extent: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil((extent - tile) / F.lit(step)).cast("int") + 1)

    rows, cols = count(F.col(height)), count(F.col(width))
    number = F.explode(F.sequence(F.lit(0), rows * cols - 1))
    out = images.withColumn("_cols", cols).withColumn("tile_no", number)
    return out.withColumn("row0", F.floor(F.col("tile_no") / F.col("_cols")).cast("int") * step).withColumn("col0", (F.col("tile_no") % F.col("_cols")).cast("int") * step).drop("_cols")


def merge_tiles(pixels: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of the tiles that cover a pixel."""
    return pixels.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value))


def merge_detections(detections: DataFrame, method: str = "union", threshold: float = 0.5, metric: str = "IOU") -> DataFrame:
    """Detections of tiles in their image, overlaps resolved, clamped, without empty boxes.

    ``detections`` has ``image, det, x1, y1, x2, y2, score, label`` in tile coordinates, the tile's
    ``row0, col0`` and the image's ``height, width``.
    """
    if method not in ("union", "nms"):
        raise ValueError(f"unknown method {method}")
    b = F.struct("x1", "y1", "x2", "y2")
    moved = detections.withColumn("b", boxes.shift(b, F.col("row0"), F.col("col0"))).select("image", "det", "b.*", "score", "label")
    resolved = union_merge(moved, threshold) if method == "union" else nms(moved, threshold, metric)
    sizes = detections.groupBy("image").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    inside = resolved.join(sizes, "image").withColumn("b", boxes.crop(b, F.col("height"), F.col("width")))
    return inside.where(~boxes.degenerate(F.col("b"))).select("image", "det", "b.*", "score", "label")


def object_crops(objects: DataFrame, tile: int = 224, margin: float = 0.1) -> DataFrame:
    """One row per object of an image: its crop with a margin, scaled to a tile.

    ``objects`` has ``image, pos, ring, width, height``.  Objects without extent are left out;
    ring coordinates are clamped to 0..223 whatever the tile.
    """
    from quadrat.functions import geometry as g

    bounds = g.bounds(F.col("ring"))
    out = objects.withColumn("_b", boxes.extended(bounds, F.col("height"), F.col("width"), margin))
    w, h = F.col("_b.x2") - F.col("_b.x1"), F.col("_b.y2") - F.col("_b.y1")
    out = out.where((w > 0) & (h > 0)).withColumn("scale_w", boxes.crop_scale(w, tile)).withColumn("scale_h", boxes.crop_scale(h, tile))
    out = out.withColumn("min_col", F.col("_b.x1")).withColumn("min_row", F.col("_b.y1")).drop("_b")
    return out.withColumn("crop", g.crop_to_tile(F.col("ring"), F.col("scale_w"), F.col("scale_h"), F.col("min_col"), F.col("min_row"))).withColumn("original_polygon_wkt", g.to_wkt(F.col("ring")))
