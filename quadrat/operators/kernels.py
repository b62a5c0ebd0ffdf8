"""Kernels that no composition of built-in expressions gives: greedy and iterative ones.

All are numpy behind Arrow batches.  Greedy ones run per image, many images per batch; an image's
objects are few by nature, and images are spread by their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.operators.grouped import map_groups

DETECTION = "image bigint, det bigint, x1 double, y1 double, x2 double, y2 double, score double, label int"
_COLUMNS = ["image", "det", "x1", "y1", "x2", "y2", "score", "label"]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that box ``a`` shares with the boxes ``b``."""
    width = np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])
    height = np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1])
    return np.maximum(width, 0) * np.maximum(height, 0)


def _area(b: np.ndarray) -> np.ndarray:
    return (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])


def _per_image(detections: DataFrame, kernel) -> DataFrame:
    """``kernel`` over the detections of each image, best first."""
    return map_groups(detections.select(*_COLUMNS), "image", [F.col("score").desc(), "det"], kernel, DETECTION)


def _corners(part: dict[str, np.ndarray]) -> np.ndarray:
    return np.trunc(np.stack([part[c] for c in ("x1", "y1", "x2", "y2")], 1).astype(float))


def suppress(boxes: np.ndarray, threshold: float = 0.5, metric: str = "IOU") -> np.ndarray:
    """Which of the boxes, best first, stay: one goes if a better one overlaps it by more than the threshold."""
    keep = np.ones(len(boxes), bool)
    for i in range(len(boxes)):
        if not keep[i] or i + 1 == len(boxes):
            continue
        rest = boxes[i + 1 :]
        shared = _shared(boxes[i], rest)
        over = _area(boxes[i]) + _area(rest) - shared if metric == "IOU" else np.minimum(_area(boxes[i]), _area(rest))
        keep[i + 1 :] &= ~(np.divide(shared, over, out=np.zeros(len(rest)), where=over > 0) > threshold)
    return keep


def nms(detections: DataFrame, threshold: float = 0.5, metric: str = "IOU") -> DataFrame:
    """Non-maximum suppression per image over boxes cut to whole numbers (``IOU`` or ``IOS``)."""
    if metric not in ("IOU", "IOS"):
        raise ValueError(f"unknown metric {metric}")

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keep = suppress(_corners(part), threshold, metric)
        return {c: part[c][keep] for c in _COLUMNS}

    return _per_image(detections, run)


def unite(boxes: np.ndarray, scores: np.ndarray, threshold: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """Boxes, best first, merged greedily: a box grows over what overlaps it by more than the threshold."""
    left = list(range(len(boxes)))
    out = []
    while left:
        box, score = boxes[left[0]].copy(), scores[left[0]]
        rest = []
        for i in left[1:]:
            shared = _shared(box, boxes[i : i + 1])[0]
            over = _area(box) + _area(boxes[i]) - shared
            if over > 0 and shared / over > threshold:
                box = np.concatenate((np.minimum(box[:2], boxes[i][:2]), np.maximum(box[2:], boxes[i][2:])))
                score = max(score, scores[i])
            else:
                rest.append(i)
        out.append((box, score))
        left = rest
    return out


def union_merge(detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Overlapping detections merged per image; labels don't keep boxes apart, the best one's counts."""

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        merged = unite(_corners(part), part["score"], threshold)
        boxes = np.array([box for box, _ in merged])
        out = {"image": np.repeat(part["image"][:1], len(merged)), "det": np.arange(len(merged))}
        out |= {c: boxes[:, k] for k, c in enumerate(("x1", "y1", "x2", "y2"))}
        return out | {"score": np.array([s for _, s in merged]), "label": np.repeat(part["label"][:1], len(merged))}

    return _per_image(detections, run)


# Polygon areas: signed fans of triangles, clipped pair by pair.


def _clip_triangles(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Area that each of n pairs of counter-clockwise triangles (n, 3, 2) shares."""
    n = len(subject)
    shape, count, lane = np.ascontiguousarray(subject.transpose(2, 1, 0)), np.full(n, 3), np.arange(n)  # shape: x and y by slot

    def next_of(values: np.ndarray) -> np.ndarray:
        after = np.roll(values, -1, axis=-2)
        after[..., np.maximum(count - 1, 0), lane] = values[..., 0, :]
        return after

    for k in range(3):
        a, b = clip[:, k], clip[:, (k + 1) % 3]
        edge = b - a
        s = edge[:, 0] * (shape[1] - a[:, 1]) - edge[:, 1] * (shape[0] - a[:, 0])
        t, after = next_of(s), next_of(shape)
        live = np.arange(shape.shape[1])[:, None] < count
        crossing = live & ((s >= 0) != (t >= 0))
        entering = live & (t >= 0)
        ratio = np.divide(s, s - t, out=np.zeros_like(s), where=(s - t) != 0)
        cut = shape + (after - shape) * ratio
        ends = np.cumsum(crossing.astype(np.intp) + entering, axis=0)
        count = ends[-1]
        shape = np.zeros((2, max(1, int(count.max(initial=0))), n))
        for points, emitted, to in ((cut, crossing, ends - entering - 1), (after, entering, ends - 1)):
            slot, at = np.nonzero(emitted)
            shape[:, to[slot, at], at] = points[:, slot, at]
    after = next_of(shape)
    live = np.arange(shape.shape[1])[:, None] < count
    cross = np.zeros((n, max(8, shape.shape[1])))
    cross[:, : shape.shape[1]] = ((shape[0] * after[1] - shape[1] * after[0]) * live).T
    return np.abs(cross.sum(1)) / 2


def ring_area(r: np.ndarray) -> float:
    """Area of a ring (n, 2)."""
    return abs(float(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1)))) / 2 if len(r) > 2 else 0.0


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two simple rings share: the signed sum over all pairs of fan triangles."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    origin = a.mean(0)

    def fan(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = r - origin
        t = np.stack([np.repeat(r[:1], len(r) - 2, 0), r[1:-1], r[2:]], 1)
        s = (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])
        return np.where((s < 0)[:, None, None], t[:, ::-1], t), np.sign(s)

    (ta, sa), (tb, sb) = fan(a), fan(b)
    total = 0.0
    for begin in range(0, len(ta), max(1, 20_000 // len(tb))):
        part = slice(begin, begin + max(1, 20_000 // len(tb)))
        left, right = np.repeat(ta[part], len(tb), 0), np.tile(tb, (len(ta[part]), 1, 1))
        total += float((np.repeat(sa[part], len(tb)) * np.tile(sb, len(ta[part])) * _clip_triangles(left, right)).sum())
    return abs(total)


def first_crossing(ring: np.ndarray, at_once: int = 1 << 20) -> tuple[int, int, np.ndarray] | None:
    """The first two edges, in order, that cross within both of them, and where; None for a ring without."""
    n = len(ring)
    d = np.roll(ring, -1, axis=0) - ring
    step = max(1, at_once // max(n, 1))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for begin in range(0, n, step):
            i = np.arange(begin, min(n, begin + step))[:, None]
            gap = ring[None] - ring[i[:, 0], None]
            det = d[i[:, 0], None, 0] * d[None, :, 1] - d[i[:, 0], None, 1] * d[None, :, 0]
            t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / det
            u = (gap[..., 0] * d[i[:, 0], None, 1] - gap[..., 1] * d[i[:, 0], None, 0]) / det
            j = np.arange(n)[None]
            apart = (j >= i + 2) & ((i > 0) | (j < n - 1)) & (det != 0)
            found = np.argwhere(apart & (t > 0) & (t < 1) & (u > 0) & (u < 1))
            if len(found):
                k, m = found[0]
                return int(begin + k), int(m), ring[begin + k] + t[k, m] * d[begin + k]
    return None


def simple_parts(r: np.ndarray) -> list[np.ndarray]:
    """A ring cut where it crosses itself: simple rings with an area."""
    work, out = [r], []
    while work:
        ring = work.pop()
        found = first_crossing(ring) if len(ring) > 3 else None
        if found is None:
            if ring_area(ring) > 0:
                out.append(ring)
            continue
        i, j, p = found
        work.append(np.vstack([ring[: i + 1], [p], ring[j + 1 :]]))
        work.append(np.vstack([[p], ring[i + 1 : j + 1]]))
    return out


def ring_overlap(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """IoU, intersection and union of two rings.

    A ring that crosses itself is cut into parts; then the three numbers are each summed over
    the pairs of parts, and if a side has no part they are 0, 0 and the other side's area.
    """
    pa, pb = simple_parts(a), simple_parts(b)
    if not pa or not pb:
        return 0.0, 0.0, float(sum(map(ring_area, pa + pb)))
    total = np.zeros(3)
    for x in pa:
        for y in pb:
            both = shared_area(x, y)
            uni = ring_area(x) + ring_area(y) - both
            total += (both / uni if uni > 0 else 0.0, both, uni)
    return float(total[0]), float(total[1]), float(total[2])


def first_crossings(rings: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first_crossing`` of each of the rings (k, n, 2): the two edges (-1 without) and where."""
    k, n = rings.shape[:2]
    first, second, where = np.full(k, -1), np.full(k, -1), np.zeros((k, 2))
    if n * n > at_once:
        for row, found in enumerate(map(first_crossing, rings)):
            if found is not None:
                first[row], second[row], where[row] = found
        return first, second, where
    i, j = np.triu_indices(n, 2)
    apart = (i > 0) | (j < n - 1)
    i, j = i[apart], j[apart]
    step = max(1, at_once // max(len(i), 1))
    for begin in range(0, k if len(i) else 0, step):
        r = rings[begin : begin + step]
        d = np.roll(r, -1, axis=1) - r
        (dx, dy), (ex, ey), (gx, gy) = (np.moveaxis(v, 2, 0) for v in (d[:, i], d[:, j], r[:, j] - r[:, i]))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            det = dx * ey - dy * ex
            t, u = (gx * ey - gy * ex) / det, (gx * dy - gy * dx) / det
            found = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        row = np.flatnonzero(found.any(1))
        pair = found[row].argmax(1)
        first[begin + row], second[begin + row] = i[pair], j[pair]
        where[begin + row] = r[row, i[pair]] + t[row, pair, None] * d[row, i[pair]]
    return first, second, where


def _areas(rings: np.ndarray) -> np.ndarray:
    """Areas of rings (k, n, 2)."""
    x, y = rings[..., 0], rings[..., 1]
    return np.abs(np.vecdot(x, np.roll(y, -1, axis=1)) - np.vecdot(y, np.roll(x, -1, axis=1))) / 2


def _parts_of(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """``simple_parts`` of many rings, those with the same number of vertices together.

    Per part the ring that it is of (ascending, parts in order), its area, its number of vertices and
    its place among the parts with that number, which the last value holds.
    """
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    sizes = np.array([len(r) for r in rings], np.intp)
    for n in np.unique(sizes[sizes > 2]).tolist():
        own = np.flatnonzero(sizes == n)
        waiting[n] = [(own, np.zeros_like(own), np.stack([rings[k] for k in own]))]
    done: dict[int, np.ndarray] = {}
    rows = [np.zeros((4, 0))]
    while waiting:
        n = max(waiting)  # what is cut off has fewer vertices
        own, at, xy = (np.concatenate(v) for v in zip(*waiting.pop(n)))
        i, j, p = first_crossings(xy)
        area = _areas(xy)
        whole = np.flatnonzero((i < 0) & (area > 0))
        done[n] = xy[whole]
        rows.append(np.stack([own[whole], at[whole], area[whole], np.full(len(whole), n)]))
        for a, b in np.unique(np.stack([i, j], 1)[i >= 0], axis=0).tolist():
            k = np.flatnonzero((i == a) & (j == b))
            # a ring of n vertices has n - 2 parts at most, so the inner side takes the places up to b - a - 1
            waiting.setdefault(b - a + 1, []).append((own[k], at[k], np.concatenate([p[k, None], xy[k, a + 1 : b + 1]], 1)))
            waiting.setdefault(n - b + a + 1, []).append((own[k], at[k] + b - a - 1, np.concatenate([xy[k, : a + 1], p[k, None], xy[k, b + 1 :]], 1)))
    place = np.concatenate([np.arange(r.shape[1]) for r in rows])
    own, at, area, n = np.concatenate(rows, axis=1)
    order = np.lexsort((at, own))
    return own[order].astype(np.intp), area[order], n[order].astype(np.intp), place[order], done


def _shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``shared_area`` of each pair of the rings (k, n, 2) and (k, m, 2)."""
    k, n, m = len(a), a.shape[1] - 2, b.shape[1] - 2
    origin = a.mean(1, keepdims=True)

    def fan(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = r - origin
        t = np.stack([np.repeat(r[:, :1], r.shape[1] - 2, 1), r[:, 1:-1], r[:, 2:]], 2)
        u, v = t[:, :, 1] - t[:, :, 0], t[:, :, 2] - t[:, :, 0]
        s = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
        return np.where((s < 0)[..., None, None], t[:, :, ::-1], t), np.sign(s)

    (ta, sa), (tb, sb) = fan(a), fan(b)
    both = _clip_triangles(np.repeat(ta, m, 1).reshape(-1, 3, 2), np.tile(tb, (1, n, 1, 1)).reshape(-1, 3, 2))
    return np.abs((np.repeat(sa, m, 1) * np.tile(sb, (1, n)) * both.reshape(k, n * m)).sum(1))


def ring_overlaps(left: list[np.ndarray], right: list[np.ndarray], vertices: int = 1 << 16, pairs: int = 1 << 14, triangles: int = 20_000) -> np.ndarray:
    """``ring_overlap`` of each pair of rings, as rows of three.

    Pairs of parts with the same numbers of vertices are computed together, over arrays of a bounded
    size: so many vertices, pairs of parts and pairs of triangles at once.
    """
    held = np.cumsum([len(a) + len(b) for a, b in zip(left, right)]) // vertices
    bounds = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(left)]
    return np.concatenate([np.zeros((0, 3)), *[_overlaps(left[a:b], right[a:b], pairs, triangles) for a, b in zip(bounds[:-1], bounds[1:])]])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: int, triangles: int) -> np.ndarray:
    total = np.zeros((len(left), 3))
    (own_a, area_a, n_a, at_a, rings_a), (own_b, area_b, n_b, at_b, rings_b) = _parts_of(left), _parts_of(right)
    many_a, many_b = (np.bincount(own, minlength=len(left)) for own in (own_a, own_b))
    for own, area in ((own_a, area_a), (own_b, area_b)):
        alone = (many_a * many_b)[own] == 0
        np.add.at(total[:, 2], own[alone], area[alone])
    begin_a, begin_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    ends = np.cumsum(many_a * many_b)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, pairs):
        pair = np.arange(begin, min(begin + pairs, int(ends[-1])))
        row = np.searchsorted(ends, pair, side="right")
        i, j = np.divmod(pair - (ends - many_a * many_b)[row], many_b[row])
        i, j = i + begin_a[row], j + begin_b[row]
        both = np.zeros(len(pair))
        for n, m in np.unique(np.stack([n_a[i], n_b[j]], 1), axis=0).tolist():
            same = np.flatnonzero((n_a[i] == n) & (n_b[j] == m))
            a, b, most = rings_a[n], rings_b[m], triangles // ((n - 2) * (m - 2))
            if most:
                for k in (same[c : c + most] for c in range(0, len(same), most)):
                    both[k] = _shared_areas(a[at_a[i[k]]], b[at_b[j[k]]])
            else:
                both[same] = [shared_area(a[x], b[y]) for x, y in zip(at_a[i[same]], at_b[j[same]])]
        uni = area_a[i] + area_b[j] - both
        np.add.at(total, row, np.stack([np.divide(both, uni, out=np.zeros_like(uni), where=uni > 0), both, uni], 1))
    return total


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) if ring is not None else np.zeros((0, 2))


_RING_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y")]))


def rings_of(column: pa.Array) -> list[np.ndarray]:
    """Vertices (n, 2) of every ring of an Arrow column of rings, without a Python object per vertex; none for NULL."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, begin = len(column), column.offset
    bounds = np.frombuffer(column.buffers()[1], np.int32)[begin : begin + n + 1] if n else np.zeros(1, np.int32)
    xy = np.stack([column.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1) if n else np.zeros((0, 2))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return [xy[a:b] if ok else xy[:0] for a, b, ok in zip(bounds[:-1], bounds[1:], there)]


def column_of(rings: list[np.ndarray | None]) -> pa.Array:
    """An Arrow column of rings."""
    sizes = [0 if r is None else len(r) for r in rings]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    xy = np.vstack([np.zeros((0, 2)), *[r for r in rings if r is not None]])
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([r is None for r in rings], pa.bool_()))


def with_polygon_iou(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` plus ``iou, inter, uni`` of two ring columns; NULL rings are empty.

    A map over Arrow batches: a user-defined function can't take the result of a lambda.  Other
    columns pass through untouched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ring_overlaps(rings_of(batch.column(a)), rings_of(batch.column(b)))
            out = pa.Table.from_batches([batch])
            for k, name in enumerate(("iou", "inter", "uni")):
                out = out.append_column(name, pa.array(np.ascontiguousarray(found[:, k])))
            yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("iou", "inter", "uni")]]))


def _to_outline(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distance of points (k, n, 2) to the outlines of rings (k, m, 2)."""
    best = np.full(points.shape[:2], np.inf)
    for j in range(ring.shape[1]):
        a, d = ring[:, j, None], (ring[:, (j + 1) % ring.shape[1]] - ring[:, j])[:, None]
        size = (d**2).sum(2)
        along = ((points - a) * d).sum(2)
        t = np.clip(np.divide(along, size, out=np.zeros_like(along), where=size > 0), 0, 1)
        off = points - (a + t[..., None] * d)
        best = np.minimum(best, np.hypot(off[..., 0], off[..., 1]))
    return best


def hausdorff_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hausdorff distances of pairs of rings (k, n, 2) and (k, m, 2), by their vertices and outlines."""
    return np.maximum(_to_outline(a, b).max(1), _to_outline(b, a).max(1))


def frechet_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Fréchet distances of pairs of closed rings (k, n, 2) and (k, m, 2)."""
    a, b = np.concatenate([a, a[:, :1]], 1), np.concatenate([b, b[:, :1]], 1)
    row: list[np.ndarray] = []
    for i in range(a.shape[1]):
        above, row = row, []
        for j in range(b.shape[1]):
            gap = np.hypot(a[:, i, 0] - b[:, j, 0], a[:, i, 1] - b[:, j, 1])
            before = [*above[j : j + 1], *(above[j - 1 : j] if j else []), *row[j - 1 : j]] if i or j else []
            row.append(np.maximum(gap, np.minimum.reduce(before)) if before else gap)
    return row[-1]


DISTANCES = {"hausdorff": hausdorff_of, "frechet": frechet_of}


def with_ring_distance(df: DataFrame, a: str, b: str, kind: str, name: str = "distance") -> DataFrame:
    """``df`` plus the distance of two ring columns; NULL if a ring is NULL or empty.

    Pairs with the same numbers of vertices are computed together, over arrays of a bounded size.
    """
    kernel = DISTANCES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = rings_of(batch.column(a)), rings_of(batch.column(b))
            shape = np.array([(len(x), len(y)) for x, y in zip(left, right)]).reshape(-1, 2)
            out = np.full(len(shape), np.nan)
            for n, m in np.unique(shape[shape.min(1) > 0], axis=0).tolist() if len(shape) else ():
                rows = np.flatnonzero((shape == (n, m)).all(1))
                step = max(1, (1 << 20) // (n * m))
                for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                    out[part] = kernel(np.stack([left[i] for i in part]), np.stack([right[i] for i in part]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification of an open line."""
    if len(points) < 3 or tolerance <= 0:
        return points
    keep, stack = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, b, p = points[i], points[j], points[i + 1 : j]
        d = b - a
        size = float(d @ d)
        t = np.clip(((p - a) @ d) / size, 0, 1) if size > 0 else np.zeros(len(p))
        off = np.hypot(*(p - (a + t[:, None] * d)).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def simplify(df: DataFrame, ring: str, tolerance: float) -> DataFrame:
    """``df`` with simplified rings; one that would collapse stays as it is, NULL stays NULL."""

    def one(r: np.ndarray) -> np.ndarray:
        s = simplify_line(np.vstack([r, r[:1]]), tolerance)[:-1] if len(r) > 2 else r
        return s if len(s) > 2 else r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(ring).is_valid().to_pylist()
            found = column_of([one(r) if ok else None for r, ok in zip(rings_of(batch.column(ring)), there)])
            columns = [found if name == ring else column for name, column in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, _RING_TYPE) if f.name == ring else f for f in df.schema.fields]))


def repair(df: DataFrame, ring: str) -> DataFrame:
    """One row per simple part of a ring, numbered ``part``; a ring without area has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[[{"x": float(x), "y": float(y)} for x, y in p] for p in simple_parts(_xy(r))] if r is not None else [] for r in batch[ring]]
            out = batch.loc[batch.index.repeat([len(p) for p in parts])].copy()
            out[ring] = pd.Series([p for many in parts for p in many], index=out.index, dtype=object)
            out["part"] = np.array([k for many in parts for k in range(len(many))], np.int32)
            yield out

    return df.mapInPandas(run, T.StructType([*[T.StructField(f.name, _RING_TYPE) if f.name == ring else f for f in df.schema.fields], T.StructField("part", T.IntegerType())]))


# Rasterising.  A pixel belongs to a polygon if its centre does (even-odd rule).


def fill(rings: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Mask of the pixels whose centre lies inside an odd number of rings."""
    mask = np.zeros((height, width), bool)
    xs = np.arange(width) + 0.5
    for ring in rings:
        a, b = ring, np.roll(ring, -1, axis=0)
        for row in range(max(0, int(np.floor(ring[:, 1].min() - 0.5))), min(height, int(np.ceil(ring[:, 1].max() + 0.5)))):
            y = row + 0.5
            hit = (a[:, 1] <= y) != (b[:, 1] <= y)
            if hit.any():
                p, q = a[hit], b[hit]
                crossings = np.sort(p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
                mask[row] ^= (np.searchsorted(crossings, xs) % 2).astype(bool)
    return mask


def edge_distances(ring: np.ndarray, height: int, width: int) -> np.ndarray:
    """Squared distance of each pixel centre to each edge of a ring: edges x height x width."""
    ys, xs = np.arange(height)[None, :, None] + 0.5, np.arange(width)[None, None, :] + 0.5
    a, d = ring[:, :, None, None], (np.roll(ring, -1, axis=0) - ring)[:, :, None, None]
    size = d[:, 0] ** 2 + d[:, 1] ** 2
    along = (xs - a[:, 0]) * d[:, 0] + (ys - a[:, 1]) * d[:, 1]
    t = np.clip(np.divide(along, size, out=np.zeros_like(along), where=size > 0), 0, 1)
    return (xs - a[:, 0] - t * d[:, 0]) ** 2 + (ys - a[:, 1] - t * d[:, 1]) ** 2


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest one of the mask, exact; infinite if the mask is empty.

    Squared distances along the columns first, then the lower envelope along the rows, offset by
    offset until no offset can be nearer.
    """
    height, width = mask.shape
    rows = np.arange(height)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -np.inf), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, np.inf)[::-1], axis=0)[::-1]
    column = np.minimum(rows - above, below - rows) ** 2
    best = column.copy()
    for k in range(1, width):
        if k * k >= best.max():
            break
        best[:, k:] = np.minimum(best[:, k:], column[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], column[:, k:] + k * k)
    return np.sqrt(best)


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask grown by a disc."""
    height, width = mask.shape
    out = np.zeros_like(mask)
    for dy in range(-radius, radius + 1):
        reach = int(np.sqrt(radius * radius - dy * dy))
        for dx in range(-reach, reach + 1):
            out[max(0, dy) : height + min(0, dy), max(0, dx) : width + min(0, dx)] |= mask[max(0, -dy) : height + min(0, -dy), max(0, -dx) : width + min(0, -dx)]
    return out


def window_of(ring: np.ndarray, height: int, width: int, margin: float) -> tuple[slice, slice] | None:
    """Rows and columns that a ring with a margin reaches; None if it lies outside."""
    low, high = ring.min(0), ring.max(0)
    top, left = (max(0, int(np.floor(low[k]) - margin)) for k in (1, 0))
    bottom, right = (min(n, int(np.ceil(high[k]) + margin)) for k, n in ((1, height), (0, width)))
    return (slice(top, bottom), slice(left, right)) if top < bottom and left < right else None


def direction_codes(ring: np.ndarray) -> np.ndarray:
    """Direction of each edge in 0..255 for angles 0..pi from the vertical: 0 (or 255) upright, 128 level."""
    d = np.roll(ring, -1, axis=0) - ring
    angle = np.arctan2(d[:, 0], d[:, 1])
    return np.rint(np.where(angle < 0, angle + np.pi, angle) * 255 / np.pi).astype(np.uint8)


def masks_of(polygons: list[list[np.ndarray] | np.ndarray], height: int, width: int, line: int = 3, field_line: int = 2) -> dict[str, np.ndarray]:
    """All masks of an image's polygons (a ring, or an outer ring and its holes).

    ``polygon`` holds the interiors, ``boundary`` lines of width ``line`` without those in a frame
    along the border, ``vertex`` discs of that diameter, ``crossfield`` the directions of the edges as
    lines of width ``field_line``.  What a polygon draws is its mask: ``distance`` is the sum of the
    distances to the nearest and the second nearest mask over height + width, and ``size`` the
    polygon's share of the image on its mask grown by ``line`` (1 elsewhere).  Only the window around
    a polygon is drawn, and only the two smallest distances are held at a time.  Polygons without area
    only draw directions.
    """
    out = {k: np.zeros((height, width), np.uint8) for k in ("polygon", "boundary", "vertex", "crossfield")}
    first, second = np.full((height, width), np.inf), np.full((height, width), np.inf)
    size = np.ones((height, width))
    for polygon in polygons:
        rings = [r for r in (polygon if isinstance(polygon, list) else [polygon]) if len(r) > 1]
        window = window_of(rings[0], height, width, 2 * line) if rings else None
        if window is None:
            continue
        rows, columns = window
        shape = (rows.stop - rows.start, columns.stop - columns.start)
        moved = [r - [columns.start, rows.start] for r in rings]
        near = [edge_distances(r, *shape) for r in moved]
        for edges, ring in zip(near, rings):
            for edge, code in zip(edges, direction_codes(ring)):
                out["crossfield"][window][edge <= field_line * field_line / 4] = code
        area = ring_area(rings[0]) - sum(map(ring_area, rings[1:]))
        if area <= 0:
            continue
        inside = fill(moved, *shape)
        edge = np.min([edges.min(0) for edges in near], axis=0) <= line * line / 4
        ys, xs = np.mgrid[0 : shape[0], 0 : shape[1]] + 0.5
        corner = np.zeros(shape, bool)
        for x, y in np.vstack(moved):
            corner |= (xs - x) ** 2 + (ys - y) ** 2 <= line * line / 4
        for name, drawn in (("polygon", inside), ("boundary", edge), ("vertex", corner)):
            out[name][window][drawn] = 255
        own = np.zeros((height, width), bool)
        own[window] = inside | edge | corner
        gap = distance_to(own)
        second = np.minimum(second, np.maximum(first, gap))
        first = np.minimum(first, gap)
        size[window][dilated(own[window], line)] = area / (height * width)
    frame = np.ones((height, width), bool)
    frame[line:-line, line:-line] = False
    out["boundary"][frame] = 0
    total = np.where(np.isinf(first), 0, first) + np.where(np.isinf(second), 0, second)
    return out | {"distance": total / (height + width), "size": size}


def rasterize(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """``image, mask, pixels`` from ``image, pos, ring``: one row per image and kind of mask.

    With a column ``holes`` (rings) polygons are drawn with their holes.
    """
    holed = "holes" in polygons.columns

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        holes = part["holes"] if holed else [None] * len(part["ring"])
        rings = [[_xy(r), *(_xy(x) for x in (h if h is not None else []))] for r, h in zip(part["ring"], holes)]
        found = masks_of([r for r in rings if len(r[0]) > 2], height, width)
        pixels = np.empty(len(found), object)
        pixels[:] = [m.astype(float).ravel() for m in found.values()]
        return {"image": np.repeat(part["image"][:1], len(found)), "mask": np.array(list(found), object), "pixels": pixels}

    return map_groups(polygons.select("image", "pos", "ring", *(["holes"] if holed else [])), "image", ["pos"], run, "image bigint, mask string, pixels array<double>")


# Contours.


def contours(pixels: np.ndarray, level: float) -> list[np.ndarray]:
    """Lines (x, y) where a raster crosses ``level``, high values to the left; saddles are joined low.

    Marching squares: each square of four pixels gives up to two directed segments between
    interpolated edge points; segments are linked end to begin.
    """
    height, width = pixels.shape
    after: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    high = pixels > level
    rows, cols = np.nonzero((high[:-1, :-1] != high[:-1, 1:]) | (high[:-1, :-1] != high[1:, :-1]) | (high[1:, 1:] != high[:-1, 1:]) | (high[1:, 1:] != high[1:, :-1]))
    for r, c in zip(rows.tolist(), cols.tolist()):
        top, left, bottom, right = (0, r, c), (1, r, c), (0, r + 1, c), (1, r, c + 1)
        a, b, d, e = high[r, c], high[r, c + 1], high[r + 1, c], high[r + 1, c + 1]
        # walking the square clockwise from its upper left corner: where it falls a line begins, where it rises one ends
        ring = [(a, b, top), (b, e, right), (e, d, bottom), (d, a, left)]
        falls = [k for k, (p, q, _) in enumerate(ring) if p and not q]
        rises = [k for k, (p, q, _) in enumerate(ring) if q and not p]
        for k in falls:
            end = max(rises, key=lambda m: (m - k) % 4 if len(rises) == 1 else -((k - m) % 4))
            after[ring[k][2]] = ring[end][2]

    def place(edge: tuple[int, int, int]) -> tuple[float, float]:
        kind, r, c = edge
        p, q = pixels[r, c], pixels[r, c + 1] if kind == 0 else pixels[r + 1, c]
        t = (level - p) / (q - p) if q != p else 0.5
        return (c + t, float(r)) if kind == 0 else (float(c), r + t)

    ends = set(after.values())
    lines = []
    for begin in sorted(set(after) - ends) + sorted(after):
        if begin not in after:
            continue
        line, now = [begin], begin
        while now in after:
            now = after.pop(now)
            line.append(now)
        lines.append(np.array([place(e) for e in line]))
    return lines


def _closed_contours(pixels: np.ndarray, level: float) -> list[np.ndarray]:
    """Contours of a raster with a low frame around it, so that all are closed."""
    low = np.pad(pixels, 1, constant_values=min(float(pixels.min()), level) - 1)
    low[0, :] = low[-1, :] = low[:, 0] = low[:, -1] = np.nextafter(level, -np.inf)
    return [np.clip(line - 1, 0, [pixels.shape[1] - 1, pixels.shape[0] - 1]) for line in contours(low, level)]


def polygonize(rasters: DataFrame, height: int, width: int, level: float = 0.5, tolerance: float = 1.0, min_area: float = 10.0, min_probability: float = 0.5) -> DataFrame:
    """Polygons of probability rasters: ``image, poly, area, probability, ring, error``.

    Contours at ``level``, of more than ``min_area`` and a mean probability above
    ``min_probability``, simplified.  A raster that fails gives one row with its error instead.
    """
    columns = ["image", "poly", "area", "probability", "ring", "error"]

    def one(image: int, values) -> Iterator[tuple]:
        try:
            pixels = np.array(values, float).reshape(height, width)
            k = 0
            for line in _closed_contours(pixels, level):
                ring = line[:-1] if len(line) > 1 and (line[0] == line[-1]).all() else line
                area = ring_area(ring)
                if not area > min_area:
                    continue
                mask = fill([ring + 0.5], height, width)
                probability = float(pixels[mask].mean()) if mask.any() else 0.0
                if probability > min_probability:
                    s = simplify_line(np.vstack([ring, ring[:1]]), tolerance)[:-1]
                    yield image, k, area, probability, [{"x": float(x), "y": float(y)} for x, y in s], None
                    k += 1
        except Exception as error:  # one bad raster must not lose the others
            yield image, None, None, None, None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for image, values in zip(batch["image"], batch["pixels"]) for row in one(image, values)]
            yield pd.DataFrame(rows, columns=columns).astype({"poly": "Int64"})

    return rasters.select("image", "pixels").mapInPandas(run, "image bigint, poly bigint, area double, probability double, ring array<struct<x:double,y:double>>, error string")


def crop_to_boxes(polygons: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each polygon cut by the boxes of its image one after the other: a cut goes on from the last.

    ``polygons`` has ``image, poly, ring``; ``boxes`` has ``image, box, x1, y1, x2, y2``.  A box
    that misses what is left is passed over; equal pieces of an image come out once.
    """

    def cut(r: np.ndarray, b: np.ndarray) -> np.ndarray:
        for axis, bound, sign in ((0, b[0], 1), (0, b[2], -1), (1, b[1], 1), (1, b[3], -1)):
            if not len(r):
                return r
            after = np.roll(r, -1, axis=0)
            s, t = sign * (r[:, axis] - bound), sign * (after[:, axis] - bound)
            out = []
            for p, q, u, v in zip(r, after, s, t):
                if (u >= 0) != (v >= 0):
                    out.append(p + (q - p) * (u / (u - v)))
                if v >= 0:
                    out.append(q)
            r = np.array(out).reshape(-1, 2)
        return r

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, seen = [], set()
        corners = right.sort_values("box")[["box", "x1", "y1", "x2", "y2"]].to_numpy(float)
        for poly, ring in left.sort_values("poly")[["poly", "ring"]].itertuples(index=False):
            r = _xy(ring)
            for number, *b in corners:
                piece = cut(r, np.array(b))
                if ring_area(piece) <= 0:
                    continue
                r = piece
                turned = piece[::-1] if np.dot(piece[:, 0], np.roll(piece[:, 1], -1)) < np.dot(piece[:, 1], np.roll(piece[:, 0], -1)) else piece
                start = np.lexsort((turned[:, 1], turned[:, 0]))[0]
                name = np.roll(turned, -start, axis=0).round(9).tobytes()
                if name not in seen:
                    seen.add(name)
                    rows.append((key[0], poly, int(number), [{"x": float(x), "y": float(y)} for x, y in piece]))
        return pd.DataFrame(rows, columns=["image", "poly", "box", "ring"])

    return polygons.groupBy("image").cogroup(boxes.groupBy("image")).applyInPandas(run, "image bigint, poly bigint, box bigint, ring array<struct<x:double,y:double>>")
