import json
import sqlite3
import struct

import numpy as np
from pyspark.sql import functions as F

from quadrat.sources import annotations, images, manifest, sinks, vectors
from quadrat.streaming import manifests as streaming

RING = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0], [0.0, 0.0]]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('image,width,height,bands_means,class_freq,is_extra\na.tif,5,6,"[56.5, 66.3]",[0.22  0.26],1\nb.tif,,x,,"[]",2\n')
    rows = manifest.read_manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [(r["image"], r["width"], r["height"], r["bands_means"], r["class_freq"], r["mask_is_single_band"]) for r in rows] == [("a.tif", 5, 6, [56.5, 66.3], [0.22, 0.26], False), ("b.tif", None, None, None, [], False)]
    assert manifest.read_manifest(spark, str(tmp_path / "m.csv"), n_first_rows=1).count() == 1
    assert manifest.read_manifest(spark, str(tmp_path / "m.csv"), keys={"is_extra": "polygon_mask"}).first()["polygon_mask"] == "1"
    assert manifest.images_of_csv(spark, str(tmp_path / "m.csv"), "image", "/r").first()[0] == "/r/a.tif"
    sinks.write_manifest(manifest.read_manifest(spark, str(tmp_path / "m.csv")), str(tmp_path / "out"))
    assert manifest.read_manifest(spark, str(tmp_path / "out")).where("image = 'a.tif'").first()["bands_means"] == [56.5, 66.3]


def test_geojson(spark, tmp_path):
    shapes = [{"type": "Polygon", "coordinates": [RING]}, {"type": "MultiPolygon", "coordinates": [[RING], [RING]]}, {"type": "Point", "coordinates": [1, 2]}]
    shapes += [{"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1], [0, 0]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]]]}, {"type": "GeometryCollection"}]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": s, "properties": {"id": k, "nome": None}} for k, s in enumerate(shapes)]}
    (tmp_path / "one.geojson").write_text(json.dumps(body))
    rows = vectors.read_geojson(spark, str(tmp_path / "*.geojson")).orderBy("feature", "part").collect()
    assert [(r["layer_key"], r["feature"], r["part"], len(r["rings"][0])) for r in rows if r["kind"] == "POLYGON"] == [("one", 0, 0, 4), ("one", 1, 0, 4), ("one", 1, 1, 4)]
    assert [(r["feature"], r["part"], r["kind"], len(r["rings"][0])) for r in rows[3:]] == [(2, 0, "POINT", 1), (3, 0, "POINT", 1), (3, 1, "POINT", 1), (4, 0, "LINE", 3), (5, 0, "LINE", 2)]
    assert rows[0]["properties"]["id"] == "0"
    assert vectors.layer(vectors.read_geojson(spark, str(tmp_path)), "two").count() == 0
    df = spark.createDataFrame([("k", rows[0]["rings"][0]), ("k", None)], "name string, ring array<struct<x:double,y:double>>")
    sinks.write_geojson(df, str(tmp_path / "out"), "name")
    back = vectors.read_geojson(spark, str(tmp_path / "out" / "name=k"))
    assert back.first()["rings"] == rows[0]["rings"]


def test_coco(spark, tmp_path):
    ann = [{"id": 1, "image_id": 7, "segmentation": [[0, 0, 4, 0, 4, 3]]}, {"id": 2, "image_id": 9, "segmentation": [[0, 0, 4, 0, 4, 3]]}, {"id": 3, "image_id": 7, "segmentation": [[0, 0, 1, 1, 2, 0], [5, 5, 6, 6, 7, 5]]}, {"id": 4, "image_id": 7, "segmentation": {"counts": [1], "size": [1, 1]}}]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 7, "file_name": "a.jpg", "width": 3, "height": 3}], "categories": [{"id": 1, "name": "x"}], "annotations": ann}))
    coco = vectors.read_coco(spark, str(tmp_path / "c.json"))
    rows = {r["id"]: (r["error"], r["ring"] and len(r["ring"])) for r in coco["annotations"].collect()}
    assert rows == {1: (None, 3), 2: ("unknown image", None), 3: ("not exactly one polygon", None), 4: ("not exactly one polygon", None)}
    assert coco["images"].count() == coco["categories"].count() == 1
    assert [(r["layer_key"], r["feature"], r["properties"]["image_id"]) for r in vectors.coco_layer(coco).collect()] == [("c/a", 1, "7")]


def test_coco_ids_belong_to_their_file(spark, tmp_path):
    ring = {"segmentation": [[0, 0, 4, 0, 4, 3]]}
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "x.jpg"}], "annotations": [{"id": 1, "image_id": 1, **ring}, {"id": 2, "image_id": 2, **ring}]}))
    (tmp_path / "b.json").write_text(json.dumps({"images": [{"id": 2, "file_name": "y.jpg"}], "annotations": [{"id": 1, "image_id": 2, **ring}]}))
    rows = vectors.read_coco(spark, str(tmp_path / "*.json"))["annotations"].collect()
    assert sorted((r["layer_key"], r["id"], r["error"]) for r in rows) == [("a", 1, None), ("a", 2, "unknown image"), ("b", 1, None)]


def test_database_geometry(spark):
    df = spark.createDataFrame([(1, bytearray(wkb(RING)), "a"), (2, None, "b")], "id bigint, wkb binary, rings_of string")
    (row,) = vectors.with_rings(df, "wkb").collect()
    assert (row["id"], row["part"], len(row["rings"][0]), row["rings_of"]) == (1, 0, 4, "a")


def wkb(ring):
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)


def test_binary_layers(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "layer.gpkg")
    base.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    base.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom')")
    base.execute("CREATE TABLE t (fid INTEGER, nome TEXT, geom BLOB)")
    base.execute("INSERT INTO t VALUES (1, 'x', ?), (2, 'y', NULL)", (b"GP\x00\x01" + struct.pack("<i", 4326) + wkb(RING),))
    base.commit()
    base.close()
    points = [*RING[::-1]]
    record = struct.pack("<i4d2i", 5, 0, 0, 4, 3, 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "shape.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(record) // 2) + record)
    fields = struct.pack("<11sc4xBB14x", b"nome", b"C", 6, 0) + struct.pack("<11sc4xBB14x", b"area", b"N", 4, 1)
    (tmp_path / "shape.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, 1, 32 + len(fields) + 1, 11) + fields + b"\r" + b" " + "rú".encode().ljust(6) + b" 2.5")
    got = {r["layer_key"]: r for r in vectors.read_vector_files(spark, str(tmp_path)).collect()}
    assert got["shape"]["properties"] == {"record": "1", "nome": "rú", "area": "2.5"}
    assert len(got["layer"]["rings"][0]) == len(got["shape"]["rings"][0]) == 4
    assert got["layer"]["properties"]["nome"] == "x"


def test_rasters(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "a.ppm").write_bytes(images.encode_pnm(a))
    (tmp_path / "b.ppm").write_bytes(b"P6 nonsense")
    rows = {r["image"].rsplit("/", 1)[1]: r for r in images.read_rasters(spark, str(tmp_path), "*.ppm").collect()}
    assert (rows["a.ppm"]["bands"], rows["a.ppm"]["height"], rows["a.ppm"]["width"]) == (3, 3, 4)
    assert rows["a.ppm"]["pixels"][:24] == a.ravel().tolist() and sum(rows["a.ppm"]["pixels"][24:]) == 0
    assert rows["b.ppm"]["error"] is not None
    long = images.band_rows(images.read_rasters(spark, str(tmp_path), "a.ppm"))
    assert long.where("band = 1 and row = 2 and col = 3").first()["v"] == 23
    assert images.read_rasters(spark, str(tmp_path), "a.ppm", mask=True).select(F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v)).first()[0] == 11
    assert manifest.images_of_folder(spark, str(tmp_path), "ppm").count() == 2


def test_annotation_bodies(spark):
    df = spark.createDataFrame([("a", json.dumps([{"class": 1, "bbox": [1, 2, 3, 4]}, {"class": 1, "bbox": [1, 2, 0, 4]}])), ("b", "{"), ("c", None)], "k string, body string")
    assert [tuple(r) for r in annotations.explode_boxes(df, "k").collect()] == [("a", 0, 1, 1.0, 2.0, 3.0, 4.0)]
    body = json.dumps({"imgWidth": 5, "imgHeight": 6, "objects": [{"class": 2, "polygon": [[0, 0], [1, 0], [1, 1]]}]})
    got = annotations.explode_polygons(spark.createDataFrame([("a", body)], "k string, body string"), "k")
    assert got.first()["ring"][2]["x"] == 1
    assert json.loads(sinks.polygons_json(got, "k").first()["body"]) == json.loads(body)


def test_keypoints(spark):
    df = spark.createDataFrame([("[[[1, 2], [3, 4]], []]",), ("{",)], "body string").select(annotations.keypoints_of(F.col("body")).alias("k"))
    assert [[[(p["x"], p["y"]) for p in o] for o in r["k"]] if r["k"] is not None else None for r in df.collect()] == [[[(1, 2), (3, 4)], []], None]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 2.0), (2, "2024-01-01 00:20:00", "a", 4.0)], "id int, ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_table(spark, str(tmp_path / "in"), "id int, ts timestamp, k string, v double")
    streaming.run_batches(stream, lambda b: b.groupBy("k").agg(F.sum("v").alias("v")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()] == [("a", 6.0)]
    counts = streaming.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["k"], "v")
    assert [(r["k"], r["n"], r["mean"]) for r in counts.collect()] == [("a", 2, 3.0)]


def test_exports(spark):
    import pytest

    with pytest.raises(ValueError, match="unknown sink"):
        sinks.export("os.system", spark.range(1))


def test_image_files(spark, tmp_path):
    rng = np.random.RandomState(1)
    rows = [(f"i{bands}", 5, 4, bands, rng.randint(0, 256, bands * 20).astype(float).tolist()) for bands in (1, 2, 3, 4)] + [("none", 5, 4, 1, None)]
    df = spark.createDataFrame(rows, "image string, width int, height int, bands int, pixels array<double>")
    folder = str(tmp_path / "out")
    assert images.write_images(df, folder).count() == images.write_images(df, folder).count() == 4
    (tmp_path / "out" / "broken.png").write_bytes(b"no image")
    got = {r["image"].rsplit("/", 1)[1]: r for r in images.read_images(spark, folder).collect()}
    assert got["i1.png"]["pixels"] == rows[0][4] and got["i3.png"]["pixels"] == rows[2][4] and got["i4.png"]["bands"] == 4
    assert got["i2.png"]["pixels"] == rows[1][4] + [0.0] * 20 and got["broken.png"]["error"]
    assert images.read_images(spark, folder, rgb=True).where("image like '%i1.png'").first()["pixels"] == rows[0][4] * 3
    assert set(images.read_images(spark, folder, mask=True).where("image like '%i3.png'").first()["pixels"]) <= {0.0, 1.0}


def test_stacked_masks(spark):
    df = spark.createDataFrame([(1, "a", 2, 1, [1.0, 0.0]), (1, "b", 2, 1, [0.0, 1.0]), (2, "a", 2, 1, [1.0, 1.0])], "image bigint, kind string, width int, height int, pixels array<double>")
    got = {r["image"]: r["pixels"] for r in images.stacked_masks(df, "image", ["b", "a"]).collect()}
    assert got == {1: [0.0, 1.0, 1.0, 0.0], 2: None}
