"""Boxes, rings, rasters and step logs derived from the common tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import boxes, geometry
from quadrat.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_quantity", "l_discount", "l_tax")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("bigint")
    return lines.select(
        F.col("l_orderkey").alias("image"),
        n.alias("n"),
        (F.col("l_partkey") % 200).cast("double").alias("x"),
        (F.col("l_suppkey") % 100).cast("double").alias("y"),
        F.col("l_quantity").alias("w"),
        (1 + F.col("l_quantity") / 2).alias("h"),
        F.col("l_discount").alias("d"),
        F.col("l_tax").alias("t"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, ref, ref_box``: every line of an order."""
    return _lines(spark, sf_dir).select("image", F.col("n").alias("ref"), boxes.from_xywh(*[F.col(c) for c in "xywh"]).alias("ref_box"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, target, target_box``: the same boxes moved in two ways, so that they contend."""
    moved = F.explode(
        F.array(
            F.struct(F.col("n").alias("target"), (F.col("x") + 100 * F.col("d")).alias("x"), (F.col("y") + 100 * F.col("t")).alias("y")),
            F.struct((F.col("n") + 100).alias("target"), (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y")),
        )
    )
    lines = _lines(spark, sf_dir).select("image", "w", "h", moved.alias("m"))
    return lines.select("image", "m.target", boxes.from_xywh(F.col("m.x"), F.col("m.y"), F.col("w"), F.col("h")).alias("target_box"))


BOXES_SQL = """WITH lines AS (SELECT * FROM (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
 (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y, l_quantity AS w, 1 + l_quantity / 2 AS h, l_discount AS d, l_tax AS t FROM lineitem)),
refs AS (SELECT image, n AS ref, x AS rx1, y AS ry1, x + w AS rx2, y + h AS ry2 FROM lines),
tgts AS (SELECT image, n AS target, x + 100 * d AS tx1, y + 100 * t AS ty1, x + 100 * d + w AS tx2, y + 100 * t + h AS ty2 FROM lines
 UNION ALL SELECT image, n + 100, x + 1, y + 1, x + 1 + w, y + 1 + h FROM lines),
cand AS (SELECT *, greatest(least(rx2, tx2) - greatest(rx1, tx1), 0) * greatest(least(ry2, ty2) - greatest(ry1, ty1), 0) AS inter FROM refs JOIN tgts USING (image) WHERE rx1 <= tx2 AND rx2 >= tx1 AND ry1 <= ty2 AND ry2 >= ty1),
scored AS (SELECT *, inter / ((rx2 - rx1) * (ry2 - ry1) + (tx2 - tx1) * (ty2 - ty1) - inter) AS iou FROM cand),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY image, target ORDER BY iou DESC, ref) = 1),
matches AS (SELECT * FROM (SELECT * FROM best WHERE iou > 0.5) QUALIFY row_number() OVER (PARTITION BY image, ref ORDER BY target) = 1)
"""


def rings(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """``id, a, b, x0, y0, w, h``: two quadrilaterals per part."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        ((F.col("p_partkey") % 50) * scale).cast("double").alias("x0"),
        ((F.col("p_size") % 20) * scale).cast("double").alias("y0"),
        ((5 + F.col("p_size") % 7) * scale).cast("double").alias("w"),
        ((4 + F.col("p_partkey") % 5) * scale).cast("double").alias("h"),
    )
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    a = geometry.ring((x, y), (x + w, y), (x + w + 1, y + h), (x, y + h))
    b = geometry.ring((x + 1, y + 1), (x + w + 2, y), (x + w, y + h + 2), (x - 1, y + h))
    return p.withColumn("a", a).withColumn("b", b)


def rings_sql(scale: float = 1.0) -> str:
    """The same vertices as tables ``va`` and ``vb`` (id, ord, x, y) with edges ``ea`` and ``eb``."""
    a = ["x0, y0", "x0 + w, y0", "x0 + w + 1, y0 + h", "x0, y0 + h"]
    b = ["x0 + 1, y0 + 1", "x0 + w + 2, y0", "x0 + w, y0 + h + 2", "x0 - 1, y0 + h"]
    sides = [
        f"v{n} AS (" + " UNION ALL ".join(f"SELECT id, {k} AS ord, {xy.split(', ')[0]} AS x, {xy.split(', ')[1]} AS y FROM base" for k, xy in enumerate(v)) + ")"
        for n, v in (("a", a), ("b", b))
    ]
    edge = [f"e{n} AS (SELECT p.id, p.ord, p.x, p.y, q.x AS nx, q.y AS ny FROM v{n} p JOIN v{n} q ON q.id = p.id AND q.ord = (p.ord + 1) % 4)" for n in "ab"]
    return (
        f"WITH base AS (SELECT p_partkey AS id, ((p_partkey % 50) * {scale}::DOUBLE) AS x0, ((p_size % 20) * {scale}::DOUBLE) AS y0, ((5 + p_size % 7) * {scale}::DOUBLE) AS w, ((4 + p_partkey % 5) * {scale}::DOUBLE) AS h FROM part), "
        + ", ".join(sides + edge)
        + " "
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, label, pixels``: 8 x 8 rasters."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


PIXELS_SQL = "WITH px AS (SELECT vec_id AS image, label, i, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS v, embedding[64 - i]::DOUBLE AS u FROM embeddings, range(64) t(i)) "


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, epoch, step, value``: a training log."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), F.col("event_id").alias("step"), "value")


STEPS_SQL = "WITH steps AS (SELECT event_type AS split, strftime(ts, '%Y-%m-%d') AS epoch, event_id AS step, value FROM events) "
