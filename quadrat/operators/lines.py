"""Operators on lines whose vertices are rows: ``keys, ord, x, y``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def explode_ring(rings: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """One row per vertex."""
    return rings.select(*keys, F.posexplode(ring).alias("ord", "_p")).select(*keys, "ord", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def edge_vectors(vertices: DataFrame, keys: list[str], cyclic: bool = True) -> DataFrame:
    """``dx, dy`` to the next vertex; the last one's successor is the first, or there is none."""
    w = W.partitionBy(*keys).orderBy("ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if cyclic else F.lead(c).over(w)
    out = vertices.withColumn("dx", after("x") - F.col("x")).withColumn("dy", after("y") - F.col("y"))
    return out if cyclic else out.where("dx is not null")


def turning_angles(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Signed angle between the edge before and the edge after a vertex of a closed line."""
    w = W.partitionBy(*keys).orderBy("ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = edge_vectors(vertices, keys)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    e = e.withColumn("_px", before("dx")).withColumn("_py", before("dy"))
    dot, det = F.col("_px") * F.col("dx") + F.col("_py") * F.col("dy"), F.col("_px") * F.col("dy") - F.col("_py") * F.col("dx")
    return e.withColumn("angle", F.atan2(det, dot)).drop("_px", "_py")


def corners(angles: DataFrame, least: float) -> DataFrame:
    """Whether a vertex turns by more than ``least`` radians."""
    return angles.withColumn("is_corner", (F.abs("angle") > least).cast("int"))


def frame_corners(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a vertex of a closed line changes direction of the frame field.

    ``vertices`` has the unit directions ``ux, uy`` and ``vx, vy`` of the field at each vertex.
    An edge follows u or v, whichever it is closer to; a vertex whose two edges follow different
    ones, both by its own field, is a corner.
    """
    w = W.partitionBy(*keys).orderBy("ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = edge_vectors(vertices, keys)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    e = e.withColumn("_px", before("dx")).withColumn("_py", before("dy"))
    follows_u = lambda x, y: F.abs(x * F.col("ux") + y * F.col("uy")) > F.abs(x * F.col("vx") + y * F.col("vy"))
    return e.withColumn("is_corner", (follows_u(F.col("_px"), F.col("_py")) != follows_u(F.col("dx"), F.col("dy"))).cast("int")).drop("_px", "_py")


def subpaths(vertices: DataFrame, keys: list[str], flag: str = "is_corner") -> DataFrame:
    """Number of the piece that a vertex belongs to: each flagged vertex begins a piece.

    On a closed line whose first vertex is no corner, the piece before the first corner goes on
    from the last one, and gets its number.
    """
    w = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = vertices.withColumn("piece", F.sum(flag).over(w))
    most = F.max("piece").over(W.partitionBy(*keys))
    return out.withColumn("piece", F.when(F.col("piece") == 0, most).otherwise(F.col("piece")))


def junction_order(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges around a junction by angle, each with its successor: ``edge`` to ``next_edge``."""
    w = W.partitionBy(*keys).orderBy(F.atan2("dy", "dx"), "edge")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return edges.withColumn("rank", F.row_number().over(w)).withColumn("next_edge", F.coalesce(F.lead("edge").over(w), F.first("edge").over(whole)))


def segment_sums(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and maximum of a segment beside each of its members (segmented reduce and gather)."""
    w = W.partitionBy(*keys)
    return values.withColumn("seg_sum", F.sum(value).over(w)).withColumn("seg_max", F.max(value).over(w))


def without_repeats(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1
    return rows.withColumn("_new", first | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")


def alignment_energy(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Mean frame-field error, length and curvature of closed lines.

    ``vertices`` has the field's coefficients ``c0, c2`` (complex structs) at each vertex; an edge's
    direction is checked against the field where it starts.
    """
    from quadrat.functions import rasters as c

    e = turning_angles(vertices, keys)
    size = F.hypot("dx", "dy")
    z = c.cx(F.coalesce(F.try_divide("dx", size), F.lit(0.0)), F.coalesce(F.try_divide("dy", size), F.lit(0.0)))
    return e.withColumn("_e", c.align_error(F.col("c0"), F.col("c2"), z)).groupBy(*keys).agg(F.avg("_e").alias("align"), F.sum(size).alias("length"), F.avg(F.pow("angle", F.lit(2.0))).alias("curvature"))
