"""Skeletons of masks as normalised tables, instead of packed coordinate and pointer arrays.

``node(image, node, y, x, degree)`` and ``path_vertex(image, path, ord, node)`` hold what compressed
rows hold; :func:`from_csr` and :func:`to_csr` convert.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel-wide skeleton of a mask (two-pass parallel thinning by Zhang and Suen)."""
    m = np.pad(mask.astype(bool), 1)
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            n = np.stack([np.roll(m, (-r, -c), (0, 1)) for r, c in _AROUND]).astype(int)
            count = n.sum(0)
            rises = ((n == 0) & (np.roll(n, -1, axis=0) == 1)).sum(0)
            up, right, down, left = n[0], n[2], n[4], n[6]
            sides = (up * right * down == 0) & (right * down * left == 0) if first else (up * right * left == 0) & (up * down * left == 0)
            gone = m & (count >= 2) & (count <= 6) & (rises == 1) & sides
            changed |= bool(gone.any())
            m = m & ~gone
    return m[1:-1, 1:-1]


def trace(skeleton: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Nodes (y, x), their degrees, and paths between ends and junctions (closed ones begin anywhere)."""
    nodes = np.argwhere(skeleton)
    index = {tuple(p): k for k, p in enumerate(nodes.tolist())}
    links = [[index[q] for r, c in _AROUND if (q := (y + r, x + c)) in index] for y, x in nodes.tolist()]
    degree = np.array([len(v) for v in links], int)
    used: set[tuple[int, int]] = set()
    paths = []

    def follow(a: int, b: int) -> list[int]:
        path = [a, b]
        used.update(((a, b), (b, a)))
        while degree[path[-1]] == 2:
            ahead = next((k for k in links[path[-1]] if (path[-1], k) not in used), None)
            if ahead is None:
                break
            used.update(((path[-1], ahead), (ahead, path[-1])))
            path.append(ahead)
        return path

    for start in [*np.flatnonzero(degree != 2), *np.flatnonzero(degree == 2)]:
        for b in links[start]:
            if (start, b) not in used:
                paths.append(follow(int(start), b))
    return nodes, degree, paths


def skeleton_paths(masks: DataFrame, height: int, width: int) -> DataFrame:
    """``image, path, ord, node, y, x, degree`` of the skeletons of ``image, pixels`` masks."""
    columns = ["image", "path", "ord", "node", "y", "x", "degree"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image, pixels in zip(batch["image"], batch["pixels"]):
                nodes, degree, paths = trace(thin(np.array(pixels, float).reshape(height, width) > 0))
                rows += [(image, p, o, k, int(nodes[k][0]), int(nodes[k][1]), int(degree[k])) for p, path in enumerate(paths) for o, k in enumerate(path)]
            yield pd.DataFrame(rows, columns=columns)

    return masks.select("image", "pixels").mapInPandas(run, "image bigint, path int, ord int, node int, y int, x int, degree int")


def from_csr(packed: DataFrame) -> DataFrame:
    """``image, path, ord, node`` from ``image, indices, indptr``."""
    bounds = F.transform(F.sequence(F.lit(1), F.size("indptr") - 1), lambda k: F.struct(F.get("indptr", k - 1).alias("a"), F.get("indptr", k).alias("b")))
    rows = packed.where("size(indptr) > 1").select("image", "indices", F.posexplode(bounds).alias("path", "s"))
    part = F.slice("indices", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    return rows.select("image", "path", F.posexplode(part).alias("ord", "node"))


def to_csr(paths: DataFrame) -> DataFrame:
    """``image, indices, indptr`` from ``image, path, ord, node``."""
    whole = paths.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("path", "ord", "node"))).alias("v"))
    sizes = F.transform(F.sequence(F.lit(0), F.array_max(F.col("v.path"))), lambda p: F.size(F.filter("v", lambda e: e["path"] == p)))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    return whole.select("image", F.col("v.node").alias("indices"), ends.alias("indptr"))
