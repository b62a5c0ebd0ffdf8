"""Spatial selection: windows, extents and range joins with a grid as equality key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import boxes, geometry


def select_window(features: DataFrame, ring: str, x_min: float, x_max: float, y_min: float, y_max: float, clip: bool = False, min_area: float | None = None) -> DataFrame:
    """Features whose ring meets the window, clipped if asked, of more than ``min_area`` after that.

    ``features`` keeps ``minx, maxx, miny, maxy`` as plain columns, so that the range predicate
    prunes row groups; the exact test runs on what is left.  ``min_area`` must not be negative.
    """
    if min_area is not None and min_area < 0:
        raise ValueError("min_area must not be negative")
    near = features.where((F.col("minx") <= x_max) & (F.col("maxx") >= x_min) & (F.col("miny") <= y_max) & (F.col("maxy") >= y_min))
    inside = geometry.clip(F.col(ring), x_min, y_min, x_max, y_max)
    near = near.withColumn("_inside", inside).where(F.size("_inside") > 0)
    if clip:
        near = near.withColumn(ring, F.col("_inside"))
    near = near.drop("_inside")
    return near if min_area is None else near.where(geometry.area(F.col(ring)) > min_area)


def join_extents(extents: DataFrame, features: DataFrame, cell: float) -> DataFrame:
    """Features of each extent: ``extents`` has ``extent_box``, ``features`` has ``feature_box``.

    Both sides are spread over grid cells; a pair comes out of the cell that holds the lower
    corner of the common part, once.
    """
    from quadrat.operators.matching import with_cells

    a, b = F.col("extent_box"), F.col("feature_box")
    pairs = with_cells(extents, "extent_box", cell).join(with_cells(features, "feature_box", cell), ["cell_x", "cell_y"])
    home = (F.floor(F.greatest(a["x1"], b["x1"]) / cell) == F.col("cell_x")) & (F.floor(F.greatest(a["y1"], b["y1"]) / cell) == F.col("cell_y"))
    return pairs.where(boxes.touches(a, b) & home).drop("cell_x", "cell_y")
