"""Relational and spatial-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import boxes, geometry, paths
from quadrat.operators import manifests, spatial
from quadrat.plans.derived import BOXES_SQL, references, rings
from quadrat.session import table


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("ref_box")
    ring = geometry.ring((b["x1"], b["y1"]), (b["x2"], b["y1"]), (b["x2"], b["y2"]), (b["x1"], b["y2"]))
    return references(spark, sf_dir).select("image", "ref", ring.alias("ring"), b["x1"].alias("minx"), b["y1"].alias("miny"), b["x2"].alias("maxx"), b["y2"].alias("maxy"))


def bbox_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that meet a window."""
    return spatial.select_window(_features(spark, sf_dir), "ring", 50, 120, 20, 70).select("image", "ref", F.round(geometry.area(F.col("ring")), 6).alias("area"))


def clip_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features clipped to a window, of an area above 100 after that."""
    got = spatial.select_window(_features(spark, sf_dir), "ring", 50, 120, 20, 70, clip=True, min_area=100.0)
    return got.select("image", "ref", F.round(geometry.area(F.col("ring")), 6).alias("area"))


def extent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and area of the features of each raster extent."""
    k = F.col("n_nationkey")
    extents = table(spark, sf_dir, "nation").select(k.alias("extent"), boxes.from_xywh(k * 8 % 45, k * 4 % 18, F.lit(12), F.lit(9)).alias("extent_box"))
    features = rings(spark, sf_dir).select("id", geometry.bounds(F.col("a")).alias("feature_box"))
    joined = spatial.join_extents(extents, features, 16.0)
    return joined.groupBy("extent").agg(F.count("*").alias("n_features"), F.round(F.sum(boxes.intersection(F.col("extent_box"), F.col("feature_box"))), 6).alias("shared"))


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the non-null values of their latest orders."""
    first = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("p"), F.max("o_orderpriority").alias("q"))
    second = newest.select("c_custkey", F.when(F.col("p") > 200000, F.col("p")).alias("c_acctbal"), F.when(F.col("q") != "5-LOW", F.col("q")).alias("c_mktsegment"), F.lit(1).alias("extra"))
    return manifests.merge_manifests(first, second, "c_custkey")


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return manifests.missing_outputs(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


def group_by_shape_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images per shape, the largest first."""
    got = manifests.shape_groups(table(spark, sf_dir, "dsg_dataset").where("width is not null and height is not null"))
    return got.select("width", "height", "n", F.col("area").cast("bigint").alias("area"), F.col("rank").cast("bigint").alias("rank"))


def padded_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest width and height in multiples of 448."""
    return manifests.padded_extent(table(spark, sf_dir, "dsg_dataset"), "width", "height", 448)


def first_n_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred images by their first row (a top-k report)."""
    return manifests.first_keys(table(spark, sf_dir, "dsg_dataset").where("image is not null"), "image", "row_id", 100)


def cycle_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with a supplier; suppliers start over when they end."""
    c = manifests.numbered(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    s = manifests.numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    return manifests.cycle_zip(c, s).select("pos", "c_custkey", "s_suppkey")


def nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and first key of each order's lines, orders without lines kept."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    got = manifests.nested_objects(orders, lines, "l_orderkey", "l_partkey")
    return got.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("objects").isNull(), 0).otherwise(F.size("objects")).cast("bigint").alias("n"), F.get("objects", F.lit(0))["l_partkey"].alias("first_part"))


def manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest paths below a root, relative to their folder, and their stem."""
    image = F.col("image")
    return table(spark, sf_dir, "dsg_dataset").select(
        "row_id",
        paths.under_root("/data", image).alias("full_path"),
        paths.relative_to(image, "images/").alias("relative"),
        paths.stem(image).alias("stem"),
    )


def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the masks of each listed image go."""
    tiles = table(spark, sf_dir, "selected_tiles").select("id", F.col("image_path").alias("image")).where("image is not null")
    return manifests.planned_paths(tiles, "image", "/out", ["polygon_masks", "vertex_masks"]).drop("image")


def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above a score."""
    return table(spark, sf_dir, "events").where("value > 50").select("event_id", "value")


QUERIES = {
    f.__name__: f
    for f in (bbox_select, clip_area_filter, extent_features, manifest_merge, skip_existing, group_by_shape_desc, padded_extent, first_n_images, cycle_zip, nested_objects, manifest_paths, output_plan, score_threshold)
}

_WINDOW = "FROM refs WHERE rx1 <= 120 AND rx2 >= 50 AND ry1 <= 70 AND ry2 >= 20"
SQL = {
    "bbox_select": BOXES_SQL + f"SELECT image, ref, round((rx2 - rx1) * (ry2 - ry1), 6) AS area {_WINDOW}",
    "clip_area_filter": BOXES_SQL + f"SELECT * FROM (SELECT image, ref, round((least(rx2, 120) - greatest(rx1, 50)) * (least(ry2, 70) - greatest(ry1, 20)), 6)::DOUBLE AS area {_WINDOW}) WHERE area > 100",
    "extent_features": "WITH e AS (SELECT n_nationkey AS extent, n_nationkey * 8 % 45 AS ex, n_nationkey * 4 % 18 AS ey FROM nation), "
    "f AS (SELECT p_partkey AS id, (p_partkey % 50)::DOUBLE AS x1, (p_size % 20)::DOUBLE AS y1, (p_partkey % 50 + 5 + p_size % 7 + 1)::DOUBLE AS x2, (p_size % 20 + 4 + p_partkey % 5)::DOUBLE AS y2 FROM part) "
    "SELECT extent, count(*) AS n_features, round(sum(greatest(least(x2, ex + 12) - greatest(x1, ex), 0) * greatest(least(y2, ey + 9) - greatest(y1, ey), 0)), 6) AS shared FROM e JOIN f ON x1 <= ex + 12 AND x2 >= ex AND y1 <= ey + 9 AND y2 >= ey GROUP BY extent",
    "manifest_merge": "WITH n AS (SELECT o_custkey, max(o_totalprice) AS p, max(o_orderpriority) AS q FROM orders GROUP BY 1) SELECT c_custkey, coalesce(CASE WHEN p > 200000 THEN p END, c_acctbal) AS c_acctbal, coalesce(CASE WHEN q <> '5-LOW' THEN q END, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN n ON o_custkey = c_custkey",
    "skip_existing": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "group_by_shape_desc": "SELECT width, height, count(*) AS n, (width * height)::BIGINT AS area, row_number() OVER (ORDER BY width * height DESC, width, height) AS rank FROM dsg_dataset WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY width, height",
    "padded_extent": "SELECT (ceil(max(width) / 448.0::DOUBLE) * 448)::BIGINT AS pad_width, (ceil(max(height) / 448.0::DOUBLE) * 448)::BIGINT AS pad_height FROM dsg_dataset",
    "first_n_images": "SELECT image, min(row_id) AS first FROM dsg_dataset WHERE image IS NOT NULL GROUP BY image ORDER BY 2, 1 LIMIT 100",
    "cycle_zip": "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier) SELECT pos, c_custkey, s_suppkey FROM c JOIN s ON pos % n = k",
    "nested_objects": "SELECT o_orderkey, count(l_orderkey) AS n, min(l_partkey) AS first_part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "manifest_paths": r"SELECT row_id, '/data/' || regexp_replace(image, '^/', '') AS full_path, string_split(image, 'images/')[-1] AS relative, regexp_replace(string_split(image, '/')[-1], '(.)\.[^.]*$', '\1') AS stem FROM dsg_dataset",
    "output_plan": "SELECT id, "
    + ", ".join(
        rf"'/out/{k}/' || CASE WHEN regexp_extract(image_path, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(image_path, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || regexp_replace(string_split(image_path, '/')[-1], '(.)\.[^.]*$', '\1') || '.png' AS {k}_path"
        for k in ("polygon_masks", "vertex_masks")
    )
    + " FROM selected_tiles WHERE image_path IS NOT NULL",
    "score_threshold": "SELECT event_id, value FROM events WHERE value > 50",
}
