"""Column functions on axis-parallel boxes, given as four columns or as a struct x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box from its corners."""
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))])


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box from its upper left corner and size."""
    return box(x, y, x + w, y + h)


def to_xywh(b: Column) -> Column:
    """Corner and size of a box."""
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def convert_box(values: Column, source: str, target: str) -> Column:
    """An array of four numbers from one notation to another; ``xywh`` and ``xyxy`` are known."""
    if source == target:
        return values
    a, b, c, d = (values[i] for i in range(4))
    if (source, target) == ("xywh", "xyxy"):
        return F.array(a, b, a + c, b + d)
    if (source, target) == ("xyxy", "xywh"):
        return F.array(a, b, c - a, d - b)
    raise ValueError(f"no conversion from {source} to {target}")


def area(b: Column) -> Column:
    """Area of a box."""
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share; 0 if they only touch."""
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def touches(a: Column, b: Column) -> Column:
    """Whether two boxes share a point; a common edge or corner is enough."""
    return (a["x1"] <= b["x2"]) & (a["x2"] >= b["x1"]) & (a["y1"] <= b["y2"]) & (a["y2"] >= b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if that is empty."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def degenerate(b: Column) -> Column:
    """Whether a box has no width or no height."""
    return (b["x1"] == b["x2"]) | (b["y1"] == b["y2"])


def shift(b: Column, row: Column, column: Column) -> Column:
    """A tile's box in its image.  The first and third number move by the row, the others by the column."""
    return box(b["x1"] + row, b["y1"] + column, b["x2"] + row, b["y2"] + column)


def crop(b: Column, height: Column, width: Column) -> Column:
    """A box clamped to an image.  The first and third number are bound by the height, the others by the width."""

    def clamp(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, most.cast("double")))

    return box(clamp(b["x1"], height), clamp(b["y1"], width), clamp(b["x2"], height), clamp(b["y2"], width))


def extended(b: Column, height: Column, width: Column, margin: float = 0.1, rounded: bool = True) -> Column:
    """A box with a margin on all sides, clamped to the image.

    The margin is a share of the box's own extent, rounded half to even (or cut off).
    """
    whole = (lambda v: F.rint(v)) if rounded else (lambda v: v.cast("int").cast("double"))
    dx, dy = whole((b["x2"] - b["x1"]) * margin), whole((b["y2"] - b["y1"]) * margin)
    return box(
        F.greatest(F.lit(0.0), b["x1"] - dx),
        F.greatest(F.lit(0.0), b["y1"] - dy),
        F.least(width.cast("double"), b["x2"] + dx),
        F.least(height.cast("double"), b["y2"] + dy),
    )


def crop_scale(extent: Column, size: int = 224) -> Column:
    """Factor that brings an extent to ``size``; NULL for an empty extent."""
    return F.try_divide(F.lit(float(size)), extent)
