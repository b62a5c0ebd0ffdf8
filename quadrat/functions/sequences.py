"""Rings as token sequences on a grid, and back.

A token is ``x + y * grid`` of a cell; ``grid**2`` ends a sequence, the next two numbers mark the
padding's start.  Sequences are arrays of INT; the one-hot form is never built.  Quantising is
done in 32-bit floats, as cell borders fall differently in 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.geometry import closed, point

#: Extent of the tile that a ring lies in.
TILE = 224
#: Grid whose marks fill what follows the end of a sequence, whatever the grid of the vertices.
PAD_GRID = 28


def cells(ring: Column, grid: int) -> Column:
    """The cell of each vertex, ``struct<x int, y int>``."""
    whole = lambda v: F.floor(((v.cast("float") + F.lit(0.5).cast("float")) / F.lit(float(TILE)).cast("float")).cast("float") * F.lit(float(grid)).cast("float")).cast("int")
    return F.transform(ring, lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y")))


def encode(ring: Column, length: int = 60, grid: int = 28, pad_grid: int | None = PAD_GRID, count: Column | None = None) -> Column:
    """Token sequence of ``length``: two leading zeros, the vertices, then end mark and padding.

    A ring of fewer than ``length - 3`` vertices is repeated behind its end, with end mark and both
    pad marks between; a longer one is thinned out evenly.  ``pad_grid`` None takes the grid itself
    for what follows the end.  ``count`` is the number of vertices that decides on thinning and on
    the period of the padding, if it isn't that of ``ring`` (which may hold the closing vertex).
    """
    pad = grid if pad_grid is None else pad_grid
    c, m = cells(ring, grid), F.size(ring)
    n = m if count is None else count
    period = n + 3

    def padded(k: Column) -> Column:
        r = k % period
        cell = F.get(c, r - 2)
        repeat = cell["y"] * pad + cell["x"]
        mark = F.when(r == n + 2, pad * pad).when(r == 0, pad * pad + 1).when(r == 1, pad * pad + 2).otherwise(repeat)
        return F.when(k < 2, 0).when(k < m + 2, F.get(c, k - 2)["x"] + F.get(c, k - 2)["y"] * grid).when(k == m + 2, pad * pad).otherwise(mark)

    def thinned(k: Column) -> Column:
        at = F.floor((k - 2) * (n.cast("double") / (length - 3))).cast("int")
        return F.when(k < 2, 0).when(k < length - 1, F.get(c, at)["x"] + F.get(c, at)["y"] * grid).otherwise(grid * grid)

    steps = F.sequence(F.lit(0), F.lit(length - 1))
    return F.when(n < length - 3, F.transform(steps, padded)).otherwise(F.transform(steps, thinned))


def decode(tokens: Column, grid: int = 28, scale_w: Column | None = None, scale_h: Column | None = None, min_col: Column | None = None, min_row: Column | None = None) -> Column:
    """Cell centres of the tokens before the end mark, scaled and moved into the image."""
    sw, sh, mc, mr = (c if c is not None else F.lit(v) for c, v in ((scale_w, 1.0), (scale_h, 1.0), (min_col, 0.0), (min_row, 0.0)))
    end = F.array_position(tokens, F.lit(grid * grid).cast("int"))
    own = F.when(end > 0, F.slice(tokens, 1, end.cast("int") - 1)).otherwise(tokens)
    return F.transform(own, lambda t: point(((t % grid) * 8.0 + 4) / sw + mc, (F.floor(t / grid) * 8.0 + 4) / sh + mr))


def decode_to_mark(tokens: Column, grid: int = 28, scale_w: Column | None = None, scale_h: Column | None = None, min_col: Column | None = None, min_row: Column | None = None) -> Column:
    """Cell centres of the tokens before the largest one if that is a mark, scaled and moved into the image; the last two are dropped.

    Made for sequences with padding, whose largest token stands two places behind the end mark.
    """
    sw, sh, mc, mr = (c if c is not None else F.lit(v) for c, v in ((scale_w, 1.0), (scale_h, 1.0), (min_col, 0.0), (min_row, 0.0)))
    most = F.array_max(tokens)
    own = F.when(most >= grid * grid, F.slice(tokens, 1, F.array_position(tokens, most).cast("int") - 1)).otherwise(tokens)
    kept = F.slice(own, 1, F.greatest(F.size(own) - 2, F.lit(0)))
    return F.transform(kept, lambda t: point(F.floor((t % grid + 0.5) / grid * TILE) / sw + mc, F.floor((F.floor(t / grid) + 0.5) / grid * TILE) / sh + mr))


def decode_plain(tokens: Column, grid: int = 28, cell: float = 8.0) -> Column:
    """The older decoding: column and row times the cell, where a row is a true quotient (not rounded down)."""
    end = F.array_position(tokens, F.lit(grid * grid).cast("int"))
    own = F.when(end > 0, F.slice(tokens, 1, end.cast("int") - 1)).otherwise(tokens)
    return F.transform(own, lambda t: point((t % grid) * cell, t / F.lit(float(grid)) * cell))


def merged_targets(rows: Column) -> Column:
    """An array of maps of arrays as one map: each key's arrays joined in the order of the rows."""
    keys = F.array_distinct(F.flatten(F.transform(rows, lambda m: F.map_keys(m))))
    of = lambda k: F.flatten(F.transform(F.filter(rows, lambda m: F.map_contains_key(m, k)), lambda m: F.element_at(m, k)))
    return F.map_from_arrays(keys, F.transform(keys, of))


def token_accuracy(a: Column, b: Column) -> Column:
    """Share of equal tokens behind the two leading ones."""
    same = F.aggregate(F.zip_with(F.slice(a, 3, F.size(a)), F.slice(b, 3, F.size(b)), lambda s, t: (s == t).cast("int")), F.lit(0), lambda n, v: n + v)
    return same / (F.size(a) - 2)


def ring_accuracy(a: Column, b: Column, length: int = 60, grid: int = 28) -> Column:
    """Token accuracy of two rings, encoded with their closing vertices."""
    return token_accuracy(*[encode(closed(r), length, grid, count=F.size(r)) for r in (a, b)])


def views(tokens: Column) -> Column:
    """The four views used to train on a sequence: first token, inputs, shifted inputs, targets."""
    n = F.size(tokens)
    return F.struct(
        tokens[2].alias("first"),
        F.slice(tokens, 1, n - 2).alias("inputs"),
        F.slice(tokens, 2, n - 2).alias("shifted"),
        F.slice(tokens, 3, n - 2).alias("targets"),
    )
