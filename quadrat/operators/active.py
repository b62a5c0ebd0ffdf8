"""Outlines that are fitted to probability rasters and frame fields by gradient descent.

Contours of the raster are moved so that they run along its level line, stay short and follow
the frame field.  Per step: the level term pulls a vertex along the raster's gradient, the length
term pulls it towards its neighbours, and the alignment term turns its edges; the gradient is
clamped to one pixel.  Afterwards outlines are cut at their corners, simplified piece by piece,
and filtered by area and mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrat.operators.kernels import _closed_contours, fill, ring_area, simplify_line
from quadrat.session import spread

SCHEMA = "image bigint, poly bigint, area double, probability double, ring array<struct<x:double,y:double>>, error string"
#: Rasters whose outlines descend together.
TOGETHER = 128


def sample(raster: np.ndarray, points: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values of (a stack of) rasters at points (x, y), and their gradients along x and y.

    With ``of``, the first axis counts rasters, and each point is read in the raster that ``of`` names.
    """
    height, width = raster.shape[-2:]
    x, y = np.clip(points[:, 0], 0, width - 1.001), np.clip(points[:, 1], 0, height - 1.001)
    c, r = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - c, y - r
    at = (lambda r, c: raster[..., r, c]) if of is None else (lambda r, c: np.moveaxis(raster[of, ..., r, c], 0, -1))
    a, b, d, e = at(r, c), at(r, c + 1), at(r + 1, c), at(r + 1, c + 1)
    value = a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + d * (1 - fx) * fy + e * fx * fy
    return value, np.stack([(b - a) * (1 - fy) + (e - d) * fy, (d - a) * (1 - fx) + (e - b) * fx], -1)


def alignment(edges: np.ndarray, c0: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Frame-field error of each edge's direction, with complex coefficients."""
    z = edges[:, 0] + 1j * edges[:, 1]
    z = z / np.maximum(np.abs(z), 1e-9)
    return np.abs(z**4 + c2 * z**2 + c0) ** 2


def descend_all(rings: list[np.ndarray], of: list[int], pixels: np.ndarray, fields: np.ndarray | None, level: float = 0.5, steps: int = 500, rate: float = 0.1, weights: tuple[float, float, float] = (1.0, 0.1, 0.5)) -> list[np.ndarray]:
    """The rings after ``steps`` of descent, all at once; ``of`` names the raster of each.

    ``pixels`` is n x height x width; ``fields`` holds c0 and c2 (complex, n x 2 x height x width).
    """
    if not rings:
        return []
    sizes = np.array([len(line) for line in rings])
    ends = np.cumsum(sizes)
    ring, raster = np.concatenate(rings), np.repeat(of, sizes)
    follow, precede = np.arange(len(ring)) + 1, np.arange(len(ring)) - 1
    follow[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    precede[(ends - sizes)[sizes > 0]] = ends[sizes > 0] - 1
    for k in range(steps):
        value, slope = sample(pixels, ring, raster)
        grad = weights[0] * 2 * (value - level)[:, None] * slope
        after, before = ring[follow], ring[precede]
        for other in (after, before):
            d = ring - other
            grad += weights[1] * d / np.maximum(np.hypot(*d.T), 1e-9)[:, None]
        if fields is not None:
            edges = after - ring
            middle = (ring + after) / 2
            c0, c2 = sample(fields, middle, raster)[0]
            turn = np.stack([(alignment(edges + h, c0, c2) - alignment(edges - h, c0, c2)) / 2e-4 for h in (np.array([1e-4, 0]), np.array([0, 1e-4]))], 1)
            grad += weights[2] * (turn[precede] - turn)
        ring = ring - rate * (1 - k / steps) * np.clip(grad, -1, 1)
    return np.split(np.clip(ring, 0, [pixels.shape[2] - 1, pixels.shape[1] - 1]), ends[:-1])


def descend(ring: np.ndarray, pixels: np.ndarray, field: np.ndarray | None, level: float = 0.5, steps: int = 500, rate: float = 0.1, weights: tuple[float, float, float] = (1.0, 0.1, 0.5)) -> np.ndarray:
    """The ring after ``steps`` of descent; ``field`` holds c0 and c2 (complex, 2 x height x width)."""
    return descend_all([ring], [0], pixels[None], None if field is None else field[None], level, steps, rate, weights)[0]


def corner_mask(ring: np.ndarray, field: np.ndarray | None, least: float = 0.7) -> np.ndarray:
    """Vertices where the outline changes direction of the frame field, or turns sharply if there is none."""
    ahead = np.roll(ring, -1, axis=0) - ring
    back = np.roll(ahead, 1, axis=0)
    if field is None:
        angle = np.arctan2(back[:, 0] * ahead[:, 1] - back[:, 1] * ahead[:, 0], (back * ahead).sum(1))
        return np.abs(angle) > least
    c0, c2 = sample(field, ring)[0]
    root = np.sqrt(c2 * c2 - 4 * c0)
    u, v = np.sqrt(-(c2 + root) / 2), np.sqrt(-(c2 - root) / 2)
    follows = lambda d: np.abs(d[:, 0] * u.real + d[:, 1] * u.imag) > np.abs(d[:, 0] * v.real + d[:, 1] * v.imag)
    return follows(back) != follows(ahead)


def simplify_between(ring: np.ndarray, corners: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring with the pieces between its corners simplified; a piece may wrap around."""
    at = np.flatnonzero(corners)
    if len(at) < 2:
        return simplify_line(np.vstack([ring, ring[:1]]), tolerance)[:-1]
    turned = np.roll(ring, -at[0], axis=0)
    stops = np.append(at - at[0], len(ring))
    closed = np.vstack([turned, turned[:1]])
    return np.vstack([simplify_line(closed[a : b + 1], tolerance)[:-1] for a, b in zip(stops, stops[1:])])


def active_contours(rasters: DataFrame, height: int, width: int, level: float = 0.5, tolerance: float = 1.0, min_area: float = 10.0, min_probability: float = 0.5, steps: int = 500) -> DataFrame:
    """Fitted polygons of ``image, pixels`` and, if there is one, ``field``.

    ``field`` is an array of the real and imaginary parts of c0 and of c2, four rasters long.  A raster
    that fails gives one row with its error.
    """
    has_field = "field" in rasters.columns

    def started(values, parts) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]:
        pixels = np.array(values, float).reshape(height, width)
        field = None
        if parts is not None:
            f = np.array(parts, float).reshape(4, height, width)
            field = np.stack([f[0] + 1j * f[1], f[2] + 1j * f[3]])
        return pixels, field, [line[:-1] for line in _closed_contours(pixels, level)]

    def fitted(work: list[tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]]) -> list[list[np.ndarray]]:
        """The outlines of each raster after the descent; rasters without a field go apart."""
        out: list[list[np.ndarray]] = [[] for _ in work]
        for with_field in (False, True):
            own = [i for i, (_, field, _) in enumerate(work) if (field is not None) == with_field]
            lines = [(k, line) for k, i in enumerate(own) for line in work[i][2]]
            if lines:
                fields = np.stack([work[i][1] for i in own]) if with_field else None
                moved = descend_all([line for _, line in lines], [k for k, _ in lines], np.stack([work[i][0] for i in own]), fields, level, steps)
                for (k, _), ring in zip(lines, moved):
                    out[own[k]].append(ring)
        return out

    def finished(image: int, pixels: np.ndarray, field: np.ndarray | None, outlines: list[np.ndarray]) -> list[tuple]:
        rows: list[tuple] = []
        for ring in outlines:
            area = ring_area(ring)
            if not area > min_area:
                continue
            mask = fill([ring + 0.5], height, width)
            probability = float(pixels[mask].mean()) if mask.any() else 0.0
            if probability > min_probability:
                s = simplify_between(ring, corner_mask(ring, field), tolerance)
                rows.append((image, len(rows), area, probability, [{"x": float(x), "y": float(y)} for x, y in s], None))
        return rows

    def several(images: list[int], values: list, parts: list) -> Iterator[tuple]:
        """Rows of some rasters, which descend together; if that fails, each descends alone."""
        try:
            work = [started(v, p) for v, p in zip(values, parts)]
            rows = [row for image, (pixels, field, _), outlines in zip(images, work, fitted(work)) for row in finished(image, pixels, field, outlines)]
        except Exception as error:
            if len(images) == 1:
                rows = [(images[0], None, None, None, None, f"{type(error).__name__}: {error}")]
            else:
                rows = [row for image, v, p in zip(images, values, parts) for row in several([image], [v], [p])]
        yield from rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images, values, parts = list(batch["image"]), list(batch["pixels"]), list(batch["field"]) if has_field else [None] * len(batch)
            rows = [row for k in range(0, len(batch), TOGETHER) for row in several(images[k : k + TOGETHER], values[k : k + TOGETHER], parts[k : k + TOGETHER])]
            yield pd.DataFrame(rows, columns=["image", "poly", "area", "probability", "ring", "error"]).astype({"poly": "Int64"})

    return spread(rasters.select("image", "pixels", *(["field"] if has_field else [])), "image").mapInPandas(run, SCHEMA)
