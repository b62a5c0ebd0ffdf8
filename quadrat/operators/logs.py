"""Aggregates over step logs, and the metrics of whole epochs.

A log is a long table ``split, epoch, step, metric, value`` (any further keys may be grouped by).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators.manifests import numbered


def epoch_means(log: DataFrame, keys: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Mean of every logged metric per epoch; names get the prefix ``avg_``."""
    return log.groupBy(*keys, F.concat(F.lit("avg_"), name).alias(name)).agg(F.avg(value).alias(value))


def micro_iou(steps: DataFrame, keys: list[str], inter: str, uni: str) -> DataFrame:
    """Sum of intersections over sum of unions; NULL if the union is empty."""
    return steps.groupBy(*keys).agg(F.try_divide(F.sum(inter), F.sum(uni)).alias("micro_iou"))


def last_value(log: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """The value of the last step (the norm that a warm-up pass leaves)."""
    return log.groupBy(*keys).agg(F.max_by(value, step).alias("norm"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys of two tables, NULL keys being equal."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column], block: int = 100_000) -> DataFrame:
    """``rows`` plus running sums per key in the given order, and ``_place``, the row's number from 1 within its key.

    Rows are numbered in range partitions and summed in blocks; what a block begins with comes from the
    sums of the blocks before it.  So a key that holds all rows is many blocks, and no task.
    """
    placed = numbered(rows, [*keys, *order], "_pos").withColumn("_block", F.floor(F.col("_pos") / block))
    placed = placed.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    own = [*keys, "_block"]
    totals = placed.groupBy(*own).agg(F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*own, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inner = W.partitionBy(*own).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.select(*rows.columns, "_block", F.row_number().over(inner).alias("_k"), *[F.sum(f"_v_{n}").over(inner).alias(f"_s_{n}") for n in values])
    joined = summed.join(totals, _same(summed, totals, own))
    sums = [(F.coalesce(f"_s_{n}", F.lit(0)) + F.col(f"_b_{n}")).alias(n) for n in values]
    return joined.select(*[summed[c] for c in rows.columns], (F.col("_k") + F.col("_n_before")).alias("_place"), *sums)


def running_average(log: DataFrame, keys: list[str], step: str, value: str, weight: str | None = None) -> DataFrame:
    """Weighted mean of all steps so far; steps without a value add their weight only."""
    n = F.col(weight) if weight else F.lit(1.0)
    sums = running_sums(log, keys, [step], {"_total": F.col(value) * n, "_weight": n})
    return sums.select(*log.columns, F.try_divide("_total", "_weight").alias("running"))


def decaying_average(log: DataFrame, keys: list[str], step: str, value: str, decay: float) -> DataFrame:
    """``avg <- (1 - decay) * value + decay * avg`` from 0, per key.

    The recursion unrolls to a weighted sum: a step's weight follows from the number of steps behind
    it, which comes from the places of :func:`running_sums`.
    """
    placed = running_sums(log, keys, [step], {})
    sizes = log.groupBy(*keys).agg(F.count("*").alias("_n"))
    weight = (1 - decay) * F.pow(F.lit(decay), F.col("_n") - F.col("_place"))
    both = placed.join(sizes, _same(placed, sizes, keys)).select(*[placed[k] for k in keys], (placed[value] * weight).alias("_part"))
    return both.groupBy(*keys).agg(F.sum("_part").alias("decaying"))


def interpolated_weight(epoch: Column, points: list[tuple[float, float]]) -> Column:
    """Weight at an epoch, linear between (epoch, weight) points, constant beyond the ends."""
    points = sorted(points)
    out = F.lit(float(points[-1][1]))
    for (a, x), (b, y) in reversed(list(zip(points, points[1:]))):
        out = F.when(epoch < b, x + (y - x) * (epoch - a) / float(b - a)).otherwise(out)
    return F.when(epoch <= points[0][0], float(points[0][1])).otherwise(out)


def weighted_loss(log: DataFrame, keys: list[str], weights: dict[str, Column], norms: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Sum of ``weight * value / norm`` over the losses of a step."""
    weight = F.lit(None).cast("double")
    for metric, w in weights.items():
        weight = F.when(F.col(name) == metric, w).otherwise(weight)
    joined = log.join(norms, name).withColumn("_part", weight * F.try_divide(value, F.col("norm")))
    return joined.groupBy(*keys).agg(F.sum("_part").alias("loss"))


def confusion(predictions: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Counts and accuracy, precision, recall, F1 and IoU of a binary prediction."""
    counts = predictions.groupBy(*keys).agg(
        F.count_if(predicted & truth).alias("tp"),
        F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"),
        F.count_if(~predicted & ~truth).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("iou"))


def average_precision(scored: DataFrame, totals: DataFrame, keys: list[str], score: str, hit: str, order: str) -> DataFrame:
    """Average precision per key by the interpolated curve at 101 recalls.

    ``scored`` has a detection's score and whether it is a hit; ``totals`` the number of truths
    (``n_truth``) per key.
    """
    curve = running_sums(scored, keys, [F.col(score).desc(), F.col(order)], {"_tp": F.col(hit).cast("int")})
    curve = curve.join(totals, keys).withColumn("precision", F.col("_tp") / F.col("_place")).withColumn("recall", F.try_divide(F.col("_tp"), F.col("n_truth")))
    best = curve.groupBy(*keys, F.floor(F.col("recall") * 100 + 1e-9).cast("int").alias("r")).agg(F.max("precision").alias("p"))
    later = W.partitionBy(*keys).orderBy(F.col("r").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = best.withColumn("p", F.max("p").over(later)).withColumn("_before", F.lag("r").over(W.partitionBy(*keys).orderBy("r")))
    width = F.col("r") - F.coalesce("_before", F.lit(-1))
    return totals.join(steps.groupBy(*keys).agg((F.sum(F.col("p") * width) / 101).alias("ap")), keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def weight_histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation per key, with the mean as a share of 255."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.avg(value) / 255).alias("class_freq"))
