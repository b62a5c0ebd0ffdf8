"""Queries over annotation files and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.plans.derived import rings
from quadrat.sources import annotations, manifest, sinks
from quadrat.session import table


def boxes_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of orders' lines, written as JSON and read again."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.lit(1).alias("class"),
        (F.col("l_partkey") % 200).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"), (F.col("l_quantity") - 5).alias("w"), F.col("l_quantity").alias("h"),
    )
    got = annotations.explode_boxes(sinks.boxes_json(lines, "image"), "image")
    return got.groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("h")), 6).alias("area"))


def polygons_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon lists of parts, written as JSON and read again."""
    p = rings(spark, sf_dir).select(F.floor(F.col("id") / 7).cast("bigint").alias("image"), F.lit(571).alias("width"), F.lit(572).alias("height"), F.col("id").alias("pos"), F.lit(1).alias("class"), F.col("a").alias("ring"))
    got = annotations.explode_polygons(sinks.polygons_json(p, "image"), "image")
    return got.groupBy("image", "width", "height").agg(F.count("*").alias("n"), F.round(F.sum(g.area(F.col("ring"))), 6).alias("area"))


def feature_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features per GeoJSON text of a block of parts."""
    p = rings(spark, sf_dir).select(F.floor(F.col("id") / 7).cast("bigint").alias("layer"), F.col("a").alias("ring"))
    got = sinks.feature_collections(p, "layer")
    return got.select("layer", F.json_array_length(F.get_json_object("value", "$.features")).cast("bigint").alias("n"), F.get_json_object("value", "$.type").alias("type"))


def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of bracketed lists, written from the rasters and read again."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "), F.lit("]")).alias("t"))
    n = e.select("image", manifest.number_list(F.col("t")).alias("n"))
    return n.select("image", F.size("n").cast("bigint").alias("size"), F.round(F.aggregate("n", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of the events' JSON properties, per event type."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


QUERIES = {f.__name__: f for f in (boxes_explode, polygons_roundtrip, feature_collections, number_lists, event_properties)}

_AREA = "((p.w + p.w + 1) / 2 * p.h)"
_PARTS = "WITH p AS (SELECT p_partkey AS id, (5 + p_size % 7)::DOUBLE AS w, (4 + p_partkey % 5)::DOUBLE AS h FROM part) "
SQL = {
    "boxes_explode": "SELECT l_orderkey AS image, count(*) AS n, round(sum((l_quantity - 5) * l_quantity), 6) AS area FROM lineitem WHERE l_quantity > 5 GROUP BY 1",
    "polygons_roundtrip": _PARTS + f"SELECT (id // 7)::BIGINT AS image, 571 AS width, 572 AS height, count(*) AS n, round(sum{_AREA}, 6) AS area FROM p GROUP BY 1",
    "feature_collections": _PARTS + "SELECT (id // 7)::BIGINT AS layer, count(*) AS n, 'FeatureCollection' AS type FROM p GROUP BY 1",
    "number_lists": "SELECT vec_id AS image, len(embedding)::BIGINT AS size, round(list_reduce(embedding::DOUBLE[], lambda a, b: a + b), 6) AS total FROM embeddings",
    "event_properties": "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1",
}
