"""How far the directions of a predicted outline are from those of the truth.

The outline is walked in steps of about ``spacing``; every point is moved to the nearest point of
the true polygon (points inside it stay), or of its rings if ``on_rings`` (then all points move).  Steps that vanish or are stretched by ``max_stretch`` or
more are left out; the largest angle between a step and its image counts, over all outlines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrat.operators.kernels import _xy


def walk(ring: np.ndarray, spacing: float) -> np.ndarray:
    """Points along a closed ring: per edge its length over the spacing in steps, halves to even, at least one."""
    ahead = np.roll(ring, -1, axis=0)
    steps = np.maximum(1, np.rint(np.hypot(*(ahead - ring).T) / spacing).astype(int))
    edge = np.repeat(np.arange(len(ring)), steps)
    share = (np.arange(len(edge)) - np.repeat(np.cumsum(steps) - steps, steps)) / steps[edge]
    points = ring[edge] + (ahead - ring)[edge] * share[:, None]
    return np.vstack([points, ring[:1]])


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether points lie in an odd number of rings."""
    odd = np.zeros(len(points), bool)
    x, y = points[:, :1], points[:, 1:]
    for a in rings:
        b = np.roll(a, -1, axis=0)
        crossed = (a[:, 1] <= y) != (b[:, 1] <= y)
        rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / rise
        odd ^= (crossed & (x < at)).sum(1) % 2 == 1
    return odd


def nearest_on(points: np.ndarray, rings: list[np.ndarray], on_rings: bool = False) -> np.ndarray:
    """The nearest point of a polygon for each point, itself if it lies inside; of its rings if ``on_rings``."""
    a = np.vstack(rings)
    d = np.vstack([np.roll(r, -1, axis=0) - r for r in rings])
    size = np.maximum((d**2).sum(1), np.finfo(float).tiny)
    share = np.clip(((points[:, None] - a) * d).sum(2) / size, 0, 1)
    feet = a + share[:, :, None] * d
    best = ((feet - points[:, None]) ** 2).sum(2).argmin(1)
    nearest = feet[np.arange(len(points)), best]
    return nearest if on_rings else np.where(inside(points, rings)[:, None], points, nearest)


def tangent_angle_error(truth: list[np.ndarray], predicted: list[np.ndarray], spacing: float = 1.0, max_stretch: float = 2.0, on_rings: bool = False) -> float | None:
    """The largest angle in radians; None if no step can be compared."""
    if not truth or min(map(len, truth)) < 3:
        return None
    least = None
    for ring in predicted:
        if len(ring) < 2:
            continue
        points = walk(ring, spacing)
        images = np.vstack([nearest_on(points[k : k + 4096], truth, on_rings) for k in range(0, len(points), 4096)])
        step, moved = np.diff(points, axis=0), np.diff(images, axis=0)
        p, q = np.hypot(*step.T), np.hypot(*moved.T)
        good = (p * q > 0) & (p < max_stretch * q) & (q < max_stretch * p)
        if good.any():
            cosine = np.abs((step[good] * moved[good]).sum(1) / (p[good] * q[good])).min()
            least = cosine if least is None else min(least, cosine)
    return None if least is None else float(np.arccos(min(1.0, least)))


def with_tangent_angle_error(df: DataFrame, truth: str, predicted: str, spacing: float = 1.0, max_stretch: float = 2.0) -> DataFrame:
    """``df`` plus ``angle_error`` of two ring columns; NULL if a ring is, or if nothing compares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [None if a is None or b is None else tangent_angle_error([_xy(a)], [_xy(b)], spacing, max_stretch) for a, b in zip(batch[truth], batch[predicted])]
            yield batch.assign(angle_error=pd.Series(found, index=batch.index, dtype=float))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("angle_error", T.DoubleType())]))


def contour_errors(truth: DataFrame, predicted: DataFrame, least_precision: float = 0.5, spacing: float = 1.0, max_stretch: float = 2.0) -> DataFrame:
    """``image, target, angle_error`` of each predicted polygon against all true ones of its image.

    ``truth`` has ``image, ref, ref_ring`` and ``predicted`` has ``image, target, target_ring``.  A prediction
    counts if all truths together (true polygons of an image don't overlap) share more than
    ``least_precision`` of its area; its points are moved to the nearest true ring.
    """
    from pyspark.sql import functions as F

    from quadrat.functions import geometry as g
    from quadrat.operators.kernels import with_polygon_iou

    pairs = predicted.join(truth, "image")
    shared = with_polygon_iou(pairs, "target_ring", "ref_ring").groupBy("image", "target").agg(F.sum("inter").alias("inter"), F.first("target_ring").alias("target_ring"), F.collect_list("ref_ring").alias("refs"))
    good = shared.where(F.try_divide("inter", g.area(F.col("target_ring"))) > least_precision).select("image", "target", "target_ring", "refs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tangent_angle_error([_xy(r) for r in refs], [_xy(p)], spacing, max_stretch, True) for refs, p in zip(batch["refs"], batch["target_ring"])]
            yield pd.DataFrame({"image": batch["image"], "target": batch["target"], "angle_error": pd.Series(found, index=batch.index, dtype=float)})

    return good.mapInPandas(run, "image bigint, target bigint, angle_error double")
