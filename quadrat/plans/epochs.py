"""Log and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators import lines, logs
from quadrat.plans.derived import STEPS_SQL, steps
from quadrat.session import table


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each metric per split and epoch."""
    s = steps(spark, sf_dir).select(F.lit("run").alias("run"), "epoch", F.col("split").alias("metric"), "value")
    return logs.epoch_means(s, ["run", "epoch"]).select("run", "epoch", "metric", F.round("value", 6).alias("value"))


def epoch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and means per split and epoch, with totals."""
    return steps(spark, sf_dir).rollup("split", "epoch").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


def micro_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of intersections over sum of unions per epoch."""
    s = steps(spark, sf_dir).withColumn("uni", F.col("value") + 1 + F.col("step") % 5)
    return logs.micro_iou(s, ["split", "epoch"], "value", "uni").select("split", "epoch", F.round("micro_iou", 6).alias("micro_iou"))


def loss_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step's value per split."""
    return logs.last_value(steps(spark, sf_dir), ["split"], "step", "value")


def running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean so far at each step, per split and epoch."""
    s = steps(spark, sf_dir).withColumn("n", (F.col("step") % 4 + 1).cast("double"))
    return logs.running_average(s, ["split", "epoch"], "step", "value", "n").select("split", "step", F.round(F.col("running") + 1e-9, 6).alias("running"))


def decaying_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially decaying mean of each split and epoch after its last step."""
    return logs.decaying_average(steps(spark, sf_dir), ["split", "epoch"], "step", "value", 0.9).select("split", "epoch", F.round(F.col("decaying") + 1e-9, 6).alias("decaying"))


def interp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss weight that rises, holds and falls over epochs."""
    day = F.datediff(F.col("epoch").cast("date"), F.lit("2024-01-01").cast("date"))
    w = logs.interpolated_weight(day, [(5, 0.0), (10, 1.0), (20, 0.25)])
    return steps(spark, sf_dir).select("epoch").distinct().select("epoch", F.round(w, 6).alias("weight"))


def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of normed losses per epoch; the splits stand in for the losses."""
    s = steps(spark, sf_dir).withColumnRenamed("split", "metric")
    norms = logs.last_value(s, ["metric"], "step", "value")
    names = ["click", "view", "purchase", "signup", "error"]
    return logs.weighted_loss(s, ["epoch"], {m: F.lit(1.0 + k) for k, m in enumerate(names)}, norms).select("epoch", F.round("loss", 4).alias("loss"))


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary metrics per event type: a high value as prediction, an even user as truth."""
    e = table(spark, sf_dir, "events")
    c = logs.confusion(e, ["event_type"], F.col("value") > 40, F.col("user_id") % 2 == 0)
    return c.select("event_type", "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in ("accuracy", "precision", "recall", "f1", "iou")])


def subpath_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events cut where the value is high: sum and maximum beside each event."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), "value", (F.col("value") > 80).cast("int").alias("is_corner"))
    p = lines.subpaths(e, ["user_id"])
    s = lines.segment_sums(p, ["user_id", "piece"], "value")
    return s.select(F.col("ord").alias("event_id"), F.col("piece").cast("bigint").alias("piece"), F.round("seg_sum", 6).alias("seg_sum"), "seg_max")


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user whose type differs from the one before."""
    return lines.without_repeats(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


def two_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the two smallest values of a user (one term if there is only one)."""
    w = W.partitionBy("user_id").orderBy("value", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("combined"))


QUERIES = {
    f.__name__: f
    for f in (epoch_means, epoch_rollup, micro_iou, loss_norm, running_average, decaying_average, interp_weights, weighted_loss, confusion_metrics, subpath_segments, without_repeats, two_smallest)
}

_RATIO = "coalesce(({0})::DOUBLE / nullif({1}, 0), 0)"
SQL = {
    "epoch_means": STEPS_SQL + "SELECT 'run' AS run, epoch, 'avg_' || split AS metric, round(avg(value), 6) AS value FROM steps GROUP BY ALL",
    "epoch_rollup": STEPS_SQL + "SELECT split, epoch, count(*) AS n, round(avg(value), 6) AS value FROM steps GROUP BY ROLLUP (split, epoch)",
    "micro_iou": STEPS_SQL + "SELECT split, epoch, round(sum(value) / nullif(sum(value + 1 + step % 5), 0), 6) AS micro_iou FROM steps GROUP BY ALL",
    "loss_norm": STEPS_SQL + "SELECT split, arg_max(value, step) AS norm FROM steps GROUP BY split",
    "running_average": STEPS_SQL + "SELECT split, step, round(sum(value * (step % 4 + 1)) OVER w / sum(step % 4 + 1) OVER w + 1e-9, 6) AS running FROM steps WINDOW w AS (PARTITION BY split, epoch ORDER BY step ROWS UNBOUNDED PRECEDING)",
    "decaying_average": STEPS_SQL
    + ", k AS (SELECT *, row_number() OVER (PARTITION BY split, epoch ORDER BY step) AS k, count(*) OVER (PARTITION BY split, epoch) AS n FROM steps) SELECT split, epoch, round(sum(value * 0.1::DOUBLE * pow(0.9::DOUBLE, n - k)) + 1e-9, 6) AS decaying FROM k GROUP BY ALL",
    "interp_weights": STEPS_SQL
    + ", d AS (SELECT DISTINCT epoch, date_diff('day', DATE '2024-01-01', epoch::DATE) AS k FROM steps) SELECT epoch, round(CASE WHEN k <= 5 THEN 0 WHEN k < 10 THEN (k - 5) / 5.0::DOUBLE WHEN k < 20 THEN 1 - 0.75::DOUBLE * (k - 10) / 10.0::DOUBLE ELSE 0.25::DOUBLE END, 6) AS weight FROM d",
    "weighted_loss": STEPS_SQL
    + ", n AS (SELECT split, arg_max(value, step) AS norm FROM steps GROUP BY split), w AS (SELECT * FROM (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('signup', 4), ('error', 5)) t(split, w)) SELECT epoch, round(sum(w * value / nullif(norm, 0)), 4) AS loss FROM steps JOIN n USING (split) LEFT JOIN w USING (split) GROUP BY epoch",
    "confusion_metrics": "WITH c AS (SELECT event_type, count(*) FILTER (value > 40 AND user_id % 2 = 0) AS tp, count(*) FILTER (value > 40 AND user_id % 2 <> 0) AS fp, count(*) FILTER (NOT value > 40 AND user_id % 2 = 0) AS fn, count(*) FILTER (NOT value > 40 AND user_id % 2 <> 0) AS tn FROM events GROUP BY 1) SELECT *, "
    + ", ".join(f"round({_RATIO.format(a, b)}, 6) AS {n}" for n, a, b in (("accuracy", "tp + tn", "tp + fp + fn + tn"), ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1", "2 * tp", "2 * tp + fp + fn"), ("iou", "tp", "tp + fp + fn")))
    + " FROM c",
    "subpath_segments": "WITH p AS (SELECT *, sum((value > 80)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), q AS (SELECT *, CASE WHEN k = 0 THEN max(k) OVER (PARTITION BY user_id) ELSE k END::BIGINT AS piece FROM p) SELECT event_id, piece, round(sum(value) OVER (PARTITION BY user_id, piece), 6) AS seg_sum, max(value) OVER (PARTITION BY user_id, piece) AS seg_max FROM q",
    "without_repeats": "SELECT user_id, event_id, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w",
    "two_smallest": "SELECT user_id, round(sum(value), 6) AS combined FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) <= 2) GROUP BY user_id",
}
