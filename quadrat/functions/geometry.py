"""Column functions on rings: ``array<struct<x double, y double>>`` without the closing vertex."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    """A vertex."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*xy: tuple[Column, Column]) -> Column:
    """A ring from its vertices."""
    return F.array(*[point(x, y) for x, y in xy])


def from_flat(values: Column) -> Column:
    """A ring from numbers run together, x before y."""
    return F.transform(F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1), lambda i: point(values[i * 2], values[i * 2 + 1]))


def opened(r: Column) -> Column:
    """A ring without a repeated closing vertex."""
    return let(r, lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def closed(r: Column) -> Column:
    """A ring with its first vertex repeated at the end."""
    return let(r, lambda r: F.concat(r, F.slice(r, 1, 1)))


def edges(r: Column) -> Column:
    """The edges ``struct<a, b>`` of a ring."""

    def paired(r: Column) -> Column:
        after = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))), F.slice(r, 1, 1))
        return F.zip_with(r, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(r, paired)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, v: s + v)


def signed_area(r: Column) -> Column:
    """Area by the shoelace formula, positive if counter-clockwise."""
    return _sum(F.transform(edges(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(r: Column) -> Column:
    """Area of a ring."""
    return F.abs(signed_area(r))


def length(r: Column) -> Column:
    """Length of a ring."""
    return _sum(F.transform(edges(r), lambda e: F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"])))


def bounds(r: Column) -> Column:
    """The box around a ring."""
    box = lambda r: F.struct(F.array_min(r["x"]).alias("x1"), F.array_min(r["y"]).alias("y1"), F.array_max(r["x"]).alias("x2"), F.array_max(r["y"]).alias("y2"))
    return let(r, box)


def vertices(r: Column) -> Column:
    """Distinct vertices in order of first appearance."""
    return F.array_distinct(r)


def without_holes(rings: Column) -> Column:
    """A polygon's outer ring only."""
    return F.slice(rings, 1, 1)


def affine(r: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """``x' = a x + b y + c``, ``y' = d x + e y + f``."""
    return F.transform(r, lambda p: point(a * p["x"] + b * p["y"] + c, d * p["x"] + e * p["y"] + f))


def affine_inverse(r: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """The inverse of :func:`affine`; NULL vertices if it has none."""
    det = a * e - b * d
    return F.transform(
        r,
        lambda p: point(F.try_divide(e * (p["x"] - c) - b * (p["y"] - f), det), F.try_divide(a * (p["y"] - f) - d * (p["x"] - c), det)),
    )


def densify(r: Column, density: float) -> Column:
    """Points along a ring: per edge ``max(1, round(length / density))`` steps, halves to even, joints once."""

    def along(e: Column) -> Column:
        size = F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"])
        steps = F.greatest(F.lit(1), F.rint(size / density).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), steps - 1),
            lambda i: point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / steps, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / steps),
        )

    return closed(F.flatten(F.transform(edges(r), along)))


def scale_back(r: Column, scale_w: Column, scale_h: Column, min_col: Column, min_row: Column) -> Column:
    """A crop's ring in its image."""
    return F.transform(r, lambda p: point(p["x"] / scale_w + min_col, p["y"] / scale_h + min_row))


def crop_to_tile(r: Column, scale_w: Column, scale_h: Column, min_col: Column, min_row: Column, most: float = 223.0) -> Column:
    """A ring in a tile's coordinates, clamped to the tile."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(most), v))
    return F.transform(r, lambda p: point(clamp((p["x"] - min_col) * scale_w), clamp((p["y"] - min_row) * scale_h)))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def nearest_point(p: Column, r: Column) -> Column:
    """The point of a ring's line that is nearest to ``p``, the first on ties."""

    def foot(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        x, y = e["a"]["x"] + t * dx, e["a"]["y"] + t * dy
        return F.struct(F.hypot(p["x"] - x, p["y"] - y).alias("d"), x.alias("x"), y.alias("y"))

    feet = F.transform(edges(r), foot)

    def first_least(feet: Column) -> Column:
        least = F.array_min(feet["d"])
        return F.get(F.filter(feet, lambda f: f["d"] == least), F.lit(0))

    return let(feet, first_least)


def _to_line(points: Column, r: Column) -> Column:
    """Distance of each point to the line of a ring."""
    return F.transform(points, lambda p: F.array_min(F.transform(edges(r), lambda e: segment_distance(p, e["a"], e["b"]))))


def polis(a: Column, b: Column) -> Column:
    """Mean distance of the vertices to the other ring, made symmetric.

    A side of n vertices is divided by ``2 (n + 1)``: the closing vertex counts in the divisor only.
    """
    side = lambda p, q: _sum(_to_line(p, q)) / (2.0 * (F.size(p) + 1))
    return side(a, b) + side(b, a)


def batch_polis(a: Column, b: Column) -> Column:
    """``polis``, 0 if a ring has fewer than three vertices."""
    return F.when((F.size(a) < 3) | (F.size(b) < 3), 0.0).otherwise(polis(a, b))


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance of a vertex to the other ring's line."""
    return F.greatest(F.array_max(_to_line(a, b)), F.array_max(_to_line(b, a)))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance of two rings, closing vertices included."""
    return let(F.struct(closed(a).alias("p"), closed(b).alias("q")), lambda both: _coupled(both["p"], both["q"]))


def _coupled(p: Column, q: Column) -> Column:
    def row(before: Column, u: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            v = q[j]
            d = F.hypot(u["x"] - v["x"], u["y"] - v["y"])
            # least and greatest skip NULL, so the borders of the table need no case of their own
            return F.array_append(done, F.greatest(d, F.least(F.get(before, j), F.get(before, j - 1), F.get(done, j - 1))))

        return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.array().cast("array<double>"), cell)

    table = F.aggregate(p, F.array().cast("array<double>"), row)
    return F.try_element_at(table, F.lit(-1))


def _half_plane(r: Column, inside, cross) -> Column:
    """The part of a ring on one side of a line."""

    def keep(e: Column) -> Column:
        a, b = e["a"], e["b"]
        out, into = inside(a), inside(b)
        return (
            F.when(out & into, F.array(b))
            .when(out & ~into, F.array(cross(a, b)))
            .when(~out & into, F.array(cross(a, b), b))
            .otherwise(F.array().cast(RING))
        )

    return F.flatten(F.transform(edges(r), keep))


def clip(r: Column, x1: float | Column, y1: float | Column, x2: float | Column, y2: float | Column) -> Column:
    """The part of a ring inside a rectangle, half-plane by half-plane; empty if there is none.

    A ring that falls apart comes out as one ring with edges along the border, of the same area.
    """
    x1, y1, x2, y2 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x1, y1, x2, y2))

    def at_x(v: Column):
        return lambda a, b: point(v, a["y"] + (b["y"] - a["y"]) * F.coalesce(F.try_divide(v - a["x"], b["x"] - a["x"]), F.lit(0.0)))

    def at_y(v: Column):
        return lambda a, b: point(a["x"] + (b["x"] - a["x"]) * F.coalesce(F.try_divide(v - a["y"], b["y"] - a["y"]), F.lit(0.0)), v)

    r = _half_plane(r, lambda p: p["x"] >= x1, at_x(x1))
    r = _half_plane(r, lambda p: p["x"] <= x2, at_x(x2))
    r = _half_plane(r, lambda p: p["y"] >= y1, at_y(y1))
    return _half_plane(r, lambda p: p["y"] <= y2, at_y(y2))


def canonical(r: Column) -> Column:
    """The same ring, however it starts and turns: counter-clockwise from its smallest vertex."""

    def from_least(r: Column) -> Column:
        at = F.array_position(r, F.array_min(r)).cast("int")
        return F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1))

    return let(let(r, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)), from_least)


def coerce_vertices(flat: Column) -> Column:
    """Kind of geometry that a flat list of coordinates stands for, and its vertices."""
    n = (F.size(flat) / 2).cast("int")
    kind = F.when(n <= 1, "POINT").when(n == 2, "LINE").otherwise("POLYGON")
    return F.struct(kind.alias("kind"), F.when(n < 1, F.array(point(F.lit(0.0), F.lit(0.0)))).otherwise(from_flat(flat)).alias("vertices"))


def to_wkt(r: Column) -> Column:
    """A ring as well-known text."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed(r), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def to_geojson(r: Column) -> Column:
    """A ring as a GeoJSON polygon."""
    coordinates = F.array(F.transform(closed(r), lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")))


def handled(kind: str, r: Column) -> Column:
    """A ring as lines (its boundary), points (its distinct vertices) or itself."""
    if kind == "LINE":
        return closed(r)
    if kind == "POINT":
        return vertices(r)
    if kind == "POLYGON":
        return r
    raise ValueError(f"unknown kind of geometry {kind}")


def image_box(box: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """A world box as ``struct<x, y, w, h>`` in pixels: both corners are floored by the inverse affine."""
    corners = affine_inverse(ring((box["x1"], box["y1"]), (box["x2"], box["y2"])), a, b, c, d, e, f)

    def bounds_of(r: Column) -> Column:
        x = F.transform(r, lambda p: F.floor(p["x"]).cast("double"))
        y = F.transform(r, lambda p: F.floor(p["y"]).cast("double"))
        return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("w"), (F.array_max(y) - F.array_min(y)).alias("h"))

    return let(corners, bounds_of)
