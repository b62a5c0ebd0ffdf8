"""Whole workflows as plans: annotations to masks, scores to polygons, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.operators import kernels, logs, manifests, matching, spatial

Scorer = Callable[[np.ndarray], np.ndarray]


def build_masks(extents: DataFrame, features: DataFrame, height: int, width: int, cell: float = 1000.0) -> DataFrame:
    """Masks of each image from the features in its extent.

    ``extents`` has ``image, extent_box`` and the affine ``ta..tf`` from pixels to the world;
    ``features`` has ``feature, ring``.
    """
    known = features.withColumn("feature_box", g.bounds(F.col("ring")))
    near = spatial.join_extents(extents, known, cell)
    t = [F.col(f"t{k}") for k in "abcdef"]
    pixels = near.select("image", F.col("feature").alias("pos"), g.affine_inverse(F.col("ring"), *t).alias("ring"))
    return kernels.rasterize(pixels, height, width)


def mask_manifest(images: DataFrame, masks: DataFrame, root: str) -> DataFrame:
    """The manifest of built masks: a path per kind that an image has, else NULL."""
    have = masks.groupBy("image").agg(F.collect_set("mask").alias("kinds"))
    kinds = ("polygon", "boundary", "vertex", "crossfield", "distance", "size")
    path = lambda k: F.when(F.array_contains("kinds", k), F.concat(F.lit(f"{root}/{k}_masks/"), F.col("image").cast("string"), F.lit(".png"))).alias(f"{k}_mask")
    return images.join(have, "image", "left").select(*images.columns, *[path(k) for k in kinds])


def predict(tiles: DataFrame, scorer: Scorer, height: int, width: int) -> DataFrame:
    """Scores of tiles by a model that callers give; a tile that fails keeps its error.

    ``tiles`` has ``image, row0, col0, pixels``; ``scorer`` maps tiles x height x width to the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = batch[["image", "row0", "col0"]].copy()
            try:
                scores = scorer(np.array(batch["pixels"].tolist(), float).reshape(-1, height, width)).reshape(len(batch), -1)
                yield frame.assign(pixels=list(scores.tolist()), error=None)
            except Exception:  # the whole batch failed: tile by tile, so that one bad tile doesn't lose the others
                rows = []
                for pixels in batch["pixels"]:
                    try:
                        rows.append((scorer(np.array(pixels, float).reshape(1, height, width)).ravel().tolist(), None))
                    except Exception as error:
                        rows.append((None, f"{type(error).__name__}: {error}"))
                yield frame.assign(pixels=[p for p, _ in rows], error=[e for _, e in rows])

    return tiles.select("image", "row0", "col0", "pixels").mapInPandas(run, "image bigint, row0 int, col0 int, pixels array<double>, error string")


def evaluate(refs: DataFrame, targets: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Matches of rings with their metrics, what is left on both sides, and the mean per image.

    ``refs`` has ``image, ref, ref_ring``, ``targets`` has ``image, target, target_ring``.
    """
    a = refs.withColumn("ref_box", g.bounds(F.col("ref_ring")))
    b = targets.withColumn("target_box", g.bounds(F.col("target_ring")))
    pairs = kernels.with_polygon_iou(matching.candidates(a, b), "ref_ring", "target_ring")
    m = matching.first_wins(pairs, "iou", True, threshold)
    r, t = F.col("ref_ring"), F.col("target_ring")
    m = m.withColumns({"polis": g.polis(r, t), "hausdorff": g.hausdorff(r, t), "frechet": g.frechet(r, t)})
    return {
        "matches": m,
        "unmatched_refs": matching.unmatched(refs, m, "ref"),
        "unmatched_targets": matching.unmatched(targets, m, "target"),
        "per_image": m.groupBy("image").agg(F.avg("iou").alias("iou"), F.avg("polis").alias("polis"), F.count("*").alias("n")).join(logs.micro_iou(m, ["image"], "inter", "uni"), "image"),
    }


def predict_missing(manifest: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """What is still to predict, the largest shapes first (``rank``)."""
    left = manifests.missing_outputs(manifest, outputs, key)
    return left.join(manifests.shape_groups(left).select("width", "height", "rank"), ["width", "height"])


def polygonize_tokens(sequences: DataFrame, min_area: float = 0.0, tolerance: float = 0.0, grid: int = 28) -> DataFrame:
    """Polygons of decoded token sequences (``tokens, scale_w, scale_h, min_col, min_row`` and other columns).

    Three vertices at least; parts of an area of ``min_area`` or more; simplified unless ``tolerance`` is 0.
    """
    from quadrat.functions import sequences as s

    ring = s.decode(F.col("tokens"), grid, F.col("scale_w"), F.col("scale_h"), F.col("min_col"), F.col("min_row"))
    parts = kernels.repair(sequences.withColumn("ring", ring).where("size(ring) > 2"), "ring").where(g.area(F.col("ring")) >= min_area)
    return kernels.simplify(parts, "ring", tolerance) if tolerance else parts
