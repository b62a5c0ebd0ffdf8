"""Queries that write files of the tables to the shared folder and read them by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import rasters as r
from quadrat.functions import sequences as s
from quadrat.operators import kernels, spatial
from quadrat.plans import pipelines
from quadrat.plans.derived import PIXELS_SQL, rasters, rings, rings_sql
from quadrat.sources import annotations, images, manifest, sinks, vectors
from quadrat.session import kept, shared_folder, spread, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def csv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows written as CSV and scanned with typed lists."""
    path = _folder(spark)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image"), F.lit(8).alias("width"), F.col("label").alias("height"), F.col("embedding").cast("array<double>").alias("bands_means"))
    sinks.write_manifest(e, path)
    got = manifest.read_manifest(spark, path)
    return got.select(F.col("image").cast("bigint").alias("image"), "width", "height", F.size("bands_means").alias("size"), F.round(F.aggregate("bands_means", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), "mask_is_single_band")


def csv_image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image paths of a CSV list below a root."""
    path = _folder(spark)
    table(spark, sf_dir, "part").select(F.concat(F.lit("/tiles/"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("image")).write.option("header", True).csv(path)
    return manifest.images_of_csv(spark, path, "image", "/data/")


def geojson_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of parts as GeoJSON files, read as a layer: parts, vertices and area."""
    path = _folder(spark)
    sinks.feature_collections(rings(spark, sf_dir).select(F.floor(F.col("id") / 50).alias("layer"), F.col("a").alias("ring")), "layer").select("value").write.option("maxRecordsPerFile", 1).text(path)
    got = vectors.read_geojson(spark, path)
    flat = got.select("kind", F.explode("rings").alias("ring"))
    return flat.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("ring")).alias("n_vertices"), F.round(F.sum(g.area(F.col("ring"))), 4).alias("area"))


def _coco(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """COCO files of 50 images each: an image per seven parts, an annotation per part; every tenth names no image."""
    path = _folder(spark)
    p = rings(spark, sf_dir).select("id", "a", F.floor(F.col("id") / 7).cast("bigint").alias("image"))
    flat = F.flatten(F.transform("a", lambda v: F.array(v["x"], v["y"])))
    image = F.struct(F.col("image").alias("id"), F.concat(F.col("image").cast("string"), F.lit(".tif")).alias("file_name"))
    known = F.when(F.col("id") % 10 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("image"))
    note = F.struct("id", known.alias("image_id"), F.lit(1).cast("bigint").alias("category_id"), F.array(flat).alias("segmentation"))
    doc = p.groupBy(F.floor(F.col("image") / 50).alias("file")).agg(F.collect_set(image).alias("images"), F.collect_list(note).alias("annotations"))
    doc.select(F.to_json(F.struct("images", "annotations"))).write.option("maxRecordsPerFile", 1).text(path)
    return vectors.read_coco(spark, path)


def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of COCO files, those of unknown images with the reason."""
    notes = _coco(spark, sf_dir)["annotations"]
    return notes.select("id", "image_id", F.round(g.area(F.col("ring")), 6).alias("area"), "error")


def coco_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The COCO layer's features that meet a window, clipped."""
    layer = vectors.coco_layer(_coco(spark, sf_dir)).select("feature", F.col("rings")[0].alias("ring"))
    b = g.bounds(F.col("ring"))
    boxed = layer.select("*", b["x1"].alias("minx"), b["x2"].alias("maxx"), b["y1"].alias("miny"), b["y2"].alias("maxy"))
    return spatial.select_window(boxed, "ring", 10.0, 14.0, -100.0, 100.0).select("feature")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written as PNG files and read again, as three bands."""
    folder = _folder(spark).removeprefix("file:")
    made = rasters(spark, sf_dir).select("image", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("bands"), F.transform("pixels", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v * 100 + 100)))).alias("pixels"))
    images.write_images(made, folder).write.format("noop").mode("overwrite").save()
    got = images.read_images(spark, f"file://{folder}", rgb=True)
    name = F.regexp_extract("image", r"(\d+)\.png$", 1).cast("bigint")
    return got.select(name.alias("image"), "width", "height", "bands", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"), "error")


def binary_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three binary masks of each raster, stacked as one."""
    p = rasters(spark, sf_dir)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(t)).alias("t")) for k, t in (("polygon", 0.0), ("boundary", 0.1), ("vertex", 0.2))])).alias("k")
    p = p.select("image", F.lit(8).alias("width"), F.lit(8).alias("height"), "pixels", kinds)
    p = p.select("image", "width", "height", "k.kind", F.transform("pixels", lambda v: (v > F.col("k.t")).cast("double")).alias("pixels"))
    got = images.stacked_masks(p, "image", ["polygon", "boundary", "vertex"])
    return got.select("image", "bands", F.size("pixels").alias("n"), F.aggregate(F.zip_with("pixels", F.sequence(F.lit(1), F.size("pixels")), lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v).alias("total"))


def keypoints_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of parts as keypoint JSON, read again."""
    points = F.to_json(F.array(F.transform("a", lambda v: F.array(v["x"], v["y"]))))
    got = rings(spark, sf_dir).select("id", annotations.keypoints_of(points).alias("k"))
    return got.select("id", F.size("k").alias("n_objects"), F.col("k")[0][2]["x"].alias("x"), F.col("k")[0][2]["y"].alias("y"))


def crossed_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves, cut into simple parts."""
    p = rings(spark, sf_dir)
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    bow = p.select("id", g.ring((x, y), (x + w, y + h), (x + w, y), (x, y + h)).alias("ring"))
    return kernels.repair(bow, "ring").groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(g.area(F.col("ring"))), 6).alias("area"))


def crossed_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of a ring that crosses itself with the square around it."""
    p = spread(rings(spark, sf_dir), "id")
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    p = p.select("id", g.ring((x, y), (x + w, y + h), (x + w, y), (x, y + h)).alias("p"), g.ring((x, y), (x + w, y), (x + w, y + h), (x, y + h)).alias("q"))
    got = kernels.with_polygon_iou(p, "p", "q")
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("iou", "inter", "uni")])


def ring_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings scaled back to their image, without holes, coerced from flat lists, and a world box in pixels."""
    p = rings(spark, sf_dir)
    back = g.scale_back(F.col("a"), F.lit(2.0), F.lit(4.0), F.col("w"), F.col("h"))
    flat = F.flatten(F.transform("a", lambda v: F.array(v["x"], v["y"])))
    coerced = g.coerce_vertices(F.when(F.col("id") % 3 == 0, F.slice(flat, 1, 2)).when(F.col("id") % 3 == 1, F.slice(flat, 1, 4)).otherwise(flat))
    box = g.image_box(g.bounds(F.col("a")), *[F.lit(v) for v in (2.0, 0.0, -10.0, 0.0, -2.0, 200.0)])
    return p.select(
        "id", F.round(g.area(back), 6).alias("area"), back[0]["x"].alias("x"), F.size(g.without_holes(F.array("a", "b"))).alias("n_rings"),
        coerced["kind"].alias("kind"), F.size(coerced["vertices"]).alias("n_vertices"), F.round(g.batch_polis(F.col("a"), F.slice("a", 1, 2)), 6).alias("batch_polis"),
        box["x"].alias("box_x"), box["y"].alias("box_y"), box["w"].alias("box_w"), box["h"].alias("box_h"),
    )


def token_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences by the decoder for padded sequences and by the older one."""
    t = rings(spark, sf_dir, 3.0).select("id", s.encode(F.col("a")).alias("t"))
    marked, plain = s.decode_to_mark(F.col("t"), scale_w=F.lit(2.0), scale_h=F.lit(4.0), min_col=F.lit(5.0), min_row=F.lit(7.0)), s.decode_plain(F.col("t"))
    return t.select("id", F.size(marked).alias("n_marked"), F.round(marked[2]["x"], 6).alias("x"), F.round(marked[2]["y"], 6).alias("y"), F.size(plain).alias("n_plain"), F.round(plain[2]["x"], 6).alias("plain_x"), F.round(plain[2]["y"], 6).alias("plain_y"))


def token_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of the decoded token sequences."""
    t = rings(spark, sf_dir, 3.0).select("id", s.encode(F.col("a")).alias("t"), F.lit(2.0).alias("scale_w"), F.lit(4.0).alias("scale_h"), F.lit(5.0).alias("min_col"), F.lit(7.0).alias("min_row"))
    written = kept(t.withColumn("tokens", F.slice("t", 3, 58)).drop("t"))  # sequences are data, and not made again in each use
    got = pipelines.polygonize_tokens(written, min_area=1.0)
    return got.select("id", F.round(g.area(F.col("ring")), 6).alias("area"))


def raster_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and denormalised rasters, frame-field coefficients of an angle, valid crops."""
    p = rasters(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    scaled = r.normalize(F.col("pixels"), F.lit(0.1), F.lit(0.5))
    field = r.crossfield_from_angle(F.col("pixels")[0])
    valid = r.valid_crop(F.col("pixels"), F.when(F.col("label") == 0, 0.0).when(F.col("label") == 1, 1.0).otherwise(0.5))
    return p.select("image", F.round(total(scaled), 5).alias("scaled"), F.round(total(r.denormalize(scaled, F.lit(0.1), F.lit(0.5))), 5).alias("back"), (F.round(field["c0"]["re"], 6) + 0.0).alias("c0_re"), (F.round(field["c0"]["im"], 6) + 0.0).alias("c0_im"), valid.alias("valid"))


def merged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of each order's lines as one map of lists."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.create_map(F.lit("area"), F.array("l_quantity"), F.col("l_returnflag"), F.array("l_tax")).alias("m"))
    got = lines.groupBy("l_orderkey").agg(s.merged_targets(F.collect_list("m")).alias("m"))
    entry = got.select("l_orderkey", F.explode("m").alias("key", "v"))
    return entry.select(F.col("l_orderkey").alias("image"), "key", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (csv_manifest, csv_image_list, geojson_layers, coco_annotations, coco_window, image_files, binary_masks, keypoints_read, crossed_rings, crossed_iou, ring_transforms, token_decoders, token_polygons, raster_functions, merged_targets)
}

_PART = "WITH b AS (SELECT p_partkey AS id, (p_partkey % 50)::DOUBLE AS x0, (p_size % 20)::DOUBLE AS y0, (5 + p_size % 7)::DOUBLE AS w, (4 + p_partkey % 5)::DOUBLE AS h FROM part) "
_RING_AREA = "(w + w + 1) / 2 * h"
_CELLS = rings_sql(3.0) + ", c AS (SELECT id, ord, floor((x + 0.5::DOUBLE) / 224 * 28)::BIGINT AS cx, floor((y + 0.5::DOUBLE) / 224 * 28)::BIGINT AS cy FROM va) "
SQL = {
    "csv_manifest": "SELECT vec_id AS image, 8 AS width, label AS height, len(embedding)::INT AS size, round(list_reduce(embedding::DOUBLE[], lambda a, b: a + b), 6) AS total, false AS mask_is_single_band FROM embeddings",
    "csv_image_list": "SELECT '/data/tiles/' || p_partkey || '.tif' AS image FROM part",
    "geojson_layers": _PART + f"SELECT 'POLYGON' AS kind, count(*) AS n, 4 * count(*) AS n_vertices, round(sum({_RING_AREA}), 4) AS area FROM b",
    "coco_annotations": _PART + f"SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE id // 7 END AS image_id, CASE WHEN id % 10 <> 0 THEN round({_RING_AREA}, 6) END AS area, CASE WHEN id % 10 = 0 THEN 'unknown image' END AS error FROM b",
    "coco_window": _PART + "SELECT id AS feature FROM b WHERE id % 10 <> 0 AND x0 <= 14 AND x0 + w + 1 >= 10",
    "image_files": PIXELS_SQL + "SELECT image, 8 AS width, 8 AS height, 3 AS bands, 3 * sum(greatest(0, least(255, round_even(v * 100 + 100, 0)))) AS total, NULL::VARCHAR AS error FROM px GROUP BY image",
    "binary_masks": PIXELS_SQL + "SELECT image, 3 AS bands, 192 AS n, sum((v > 0)::INT * (i + 1) + (v > 0.1::DOUBLE)::INT * (i + 65) + (v > 0.2::DOUBLE)::INT * (i + 129))::DOUBLE AS total FROM px GROUP BY image",
    "keypoints_read": _PART + "SELECT id, 1 AS n_objects, x0 + w + 1 AS x, y0 + h AS y FROM b",
    "crossed_rings": _PART + "SELECT id, 2::BIGINT AS n, round(w * h / 2, 6) AS area FROM b",
    "crossed_iou": _PART + "SELECT id, 0.5::DOUBLE AS iou, round(w * h / 2, 6) AS inter, round(2 * w * h, 6) AS uni FROM b",
    "ring_transforms": _PART
    + f"SELECT id, round({_RING_AREA} / 8, 6) AS area, x0 / 2 + w AS x, 1 AS n_rings, CASE id % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINE' ELSE 'POLYGON' END AS kind, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS n_vertices, 0::DOUBLE AS batch_polis, "
    "floor((x0 + 10) / 2) AS box_x, floor((y0 + h - 200) / -2) AS box_y, floor((x0 + w + 1 + 10) / 2) - floor((x0 + 10) / 2) AS box_w, floor((y0 - 200) / -2) - floor((y0 + h - 200) / -2) AS box_h FROM b",
    "token_decoders": _CELLS
    + "SELECT id, 6::INT AS n_marked, round(floor((cx + 0.5::DOUBLE) / 28 * 224) / 2 + 5, 6) AS x, round(floor((cy + 0.5::DOUBLE) / 28 * 224) / 4 + 7, 6) AS y, 6::INT AS n_plain, round(((cx + 28 * cy) % 28) * 8::DOUBLE, 6) AS plain_x, round((cx + 28 * cy) / 28::DOUBLE * 8, 6) AS plain_y FROM c WHERE ord = 0",
    "token_polygons": _CELLS
    + ", d AS (SELECT id, ord, (cx * 8 + 4) / 2::DOUBLE + 5 AS x, (cy * 8 + 4) / 4::DOUBLE + 7 AS y FROM c), a AS (SELECT p.id, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area FROM d p JOIN d q ON q.id = p.id AND q.ord = (p.ord + 1) % 4 GROUP BY p.id) SELECT id, round(area, 6) AS area FROM a WHERE area >= 1",
    "raster_functions": PIXELS_SQL
    + "SELECT image, round(sum((v - 0.1::DOUBLE) / 0.5::DOUBLE), 5) AS scaled, round(sum(v), 5) AS back, round(-cos(4 * max(v) FILTER (i = 0)), 6) + 0.0::DOUBLE AS c0_re, round(-sin(4 * max(v) FILTER (i = 0)), 6) + 0.0::DOUBLE AS c0_im, CASE max(label) WHEN 0 THEN max(v) <= 0 WHEN 1 THEN min(v) > 0 ELSE true END AS valid FROM px GROUP BY image",
    "merged_targets": "SELECT l_orderkey AS image, key, count(*)::INT AS n, round(sum(v), 6) AS total FROM (SELECT l_orderkey, 'area' AS key, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_returnflag, l_tax FROM lineitem) GROUP BY ALL",
}
