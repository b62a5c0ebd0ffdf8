"""Vector layers: GeoJSON, COCO, GeoPackage and shapefiles, and databases by JDBC.

A layer is a table ``layer_key, feature, part, rings, properties``: one row per polygon part,
rings as arrays of vertices (the outer one first, without the closing vertex).
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import geometry as g
from quadrat.functions.paths import stem
from quadrat.session import spread

_PART = "array<array<array<double>>>"
_LAYER = "layer_key string, feature bigint, part int, rings array<array<struct<x:double,y:double>>>, properties map<string,string>"


def _rings(part) -> F.Column:
    return F.transform(part, lambda r: g.opened(F.transform(r, lambda p: g.point(p[0], p[1]))))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files, single and multiple; ``path`` may be a glob.

    The layer's columns and ``kind`` (POLYGON, LINE or POINT); lines and points have their vertices as the
    only ring.  A part of a multiple geometry is a row.
    """
    text = spark.read.option("wholetext", True).text(path).select(stem(F.input_file_name()).alias("layer_key"), F.from_json("value", "features array<string>").alias("d"))
    rows = text.select("layer_key", F.posexplode("d.features").alias("feature", "f"))
    rows = rows.select("layer_key", F.col("feature").cast("bigint").alias("feature"), F.from_json("f", "geometry struct<type:string,coordinates:string>, properties map<string,string>").alias("f"))
    at = F.col("f.geometry.coordinates")
    kind = F.regexp_replace("f.geometry.type", "^Multi", "")
    depth = {"Polygon": _PART, "LineString": "array<array<double>>", "Point": "array<double>"}
    lift = {"Polygon": lambda p: p, "LineString": lambda p: F.array(p), "Point": lambda p: F.array(F.array(p))}
    parts = F.lit(None).cast(f"array<{_PART}>")
    for name, schema in depth.items():
        single, many = F.array(F.from_json(at, schema)) if name != "Point" else F.array(F.from_json(at, schema)), F.from_json(at, f"array<{schema}>")
        held = F.transform(F.when(F.col("f.geometry.type") == name, single).otherwise(many), lift[name])
        parts = F.when(kind == name, held).otherwise(parts)
    rows = rows.select("layer_key", "feature", F.posexplode(parts).alias("part", "p"), F.col("f.properties").alias("properties"), kind.alias("kind"))
    ring = F.when(F.col("kind") == "Polygon", _rings(F.col("p"))).otherwise(F.transform("p", lambda r: F.transform(r, lambda x: g.point(x[0], x[1]))))
    names = F.when(F.col("kind") == "Polygon", "POLYGON").when(F.col("kind") == "LineString", "LINE").otherwise("POINT")
    return rows.select("layer_key", "feature", "part", ring.alias("rings"), "properties", names.alias("kind"))


_COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int,license:int>>, "
    "categories array<struct<id:bigint,name:string,supercategory:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,segmentation:string,area:double,bbox:array<double>,iscrowd:int>>"
)


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Images, categories and annotations of COCO documents, each with the ``layer_key`` of its file.

    Ids belong to their file.  Annotations get ``ring`` and ``error``: those whose segmentation isn't
    exactly one polygon, or whose image the file doesn't have, are kept with the reason instead of a
    ring.  A document is one row while its lists are split; their rows are spread over all cores.
    """
    doc = spark.read.option("wholetext", True).text(path).select(stem(F.input_file_name()).alias("layer_key"), F.from_json("value", _COCO).alias("d"))
    images = doc.select("layer_key", F.inline("d.images"))
    categories = doc.select("layer_key", F.inline("d.categories"))
    flat = F.from_json("segmentation", "array<array<double>>")
    annotations = spread(doc.select("layer_key", F.inline("d.annotations")), "layer_key", "id").withColumn("_s", flat)
    known = images.select("layer_key", F.col("id").alias("image_id"), F.lit(True).alias("_known")).distinct()
    annotations = annotations.join(known, ["layer_key", "image_id"], "left")
    error = F.when(F.col("_known").isNull(), "unknown image").when(F.col("_s").isNull() | (F.size("_s") != 1), "not exactly one polygon")
    ring = F.when(error.isNull(), g.from_flat(F.col("_s")[0]))
    annotations = annotations.withColumn("error", error).withColumn("ring", ring).drop("_s", "_known")
    return {"images": images, "categories": categories, "annotations": annotations}


def coco_layer(coco: dict[str, DataFrame]) -> DataFrame:
    """The annotations of COCO documents as a layer: a feature per annotation, keyed by file and image name."""
    images = coco["images"].select("layer_key", F.col("id").alias("image_id"), "file_name").dropDuplicates(["layer_key", "image_id"])
    good = coco["annotations"].where("error is null").join(images, ["layer_key", "image_id"])
    key = F.concat_ws("/", "layer_key", stem(F.col("file_name")))
    properties = F.create_map(F.lit("category_id"), F.col("category_id").cast("string"), F.lit("image_id"), F.col("image_id").cast("string"))
    return good.select(key.alias("layer_key"), F.col("id").alias("feature"), F.lit(0).alias("part"), F.array("ring").alias("rings"), properties.alias("properties"))


def read_database(
    spark: SparkSession, url: str, sql: str, user: str, password: str, geometry_column: str = "geom", key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str
) -> DataFrame:
    """A database layer by its own SQL, which the database runs; the geometry comes as well-known binary.

    With a numeric column ``key`` and its ``bounds``, ``parts`` tasks read ranges of it side by side.
    The columns of the SQL are kept, and ``rings`` and ``part`` are added, a row per polygon part.
    """
    table = f"(SELECT q.*, ST_AsBinary(q.{geometry_column}) AS wkb FROM ({sql}) q) layer"
    settings = {"url": url, "dbtable": table, "user": user, "password": password, **options}
    if key is not None and bounds is not None:
        settings |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    rows = spark.read.format("jdbc").options(**settings).load()
    return with_rings(rows.drop(geometry_column), "wkb")


def with_rings(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the polygon parts of a well-known-binary column, one row each, as ``part`` and ``rings``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parts_of_wkb(bytes(b)) if b is not None else [] for b in batch[column]]
            out = batch.drop(columns=column).loc[batch.index.repeat([len(f) for f in found])].copy()
            out["part"] = np.array([k for f in found for k in range(len(f))], np.int32)
            out["rings"] = pd.Series([[[{"x": x, "y": y} for x, y in r] for r in part] for f in found for part in f], index=out.index, dtype=object)
            yield out

    kept = [f for f in df.schema.fields if f.name != column]
    shape = T.ArrayType(T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in "xy"])))
    return df.mapInPandas(run, T.StructType([*kept, T.StructField("part", T.IntegerType()), T.StructField("rings", shape)]))


# Well-known binary, GeoPackage and shapefiles.


def parts_of_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygon parts of a geometry in well-known binary; other kinds have none."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        dims = 2 + (1 if kind & 0x80000000 or 1000 <= kind % 0x20000000 < 2000 or 2000 <= kind % 0x20000000 < 3000 else 0) + (1 if kind & 0x40000000 else 0)
        at += 5
        if kind & 0x20000000:
            at += 4
        base = kind & 0xFFFF
        base %= 1000
        if base == 3:
            (rings,) = struct.unpack_from(order + "I", data, at)
            at += 4
            out = []
            for _ in range(rings):
                (n,) = struct.unpack_from(order + "I", data, at)
                values = struct.unpack_from(f"{order}{n * dims}d", data, at + 4)
                at += 4 + 8 * n * dims
                points = [(values[i], values[i + 1]) for i in range(0, n * dims, dims)]
                out.append(points[:-1] if len(points) > 1 and points[0] == points[-1] else points)
            return [out], at
        if base == 6:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            parts = []
            for _ in range(n):
                found, at = read(at)
                parts += found
            return parts, at
        return [], len(data)

    return read(0)[0]


def _rows(layer: str, features: Iterator[tuple[list, dict]]) -> Iterator[tuple]:
    for number, (parts, properties) in enumerate(features):
        for k, part in enumerate(parts):
            yield layer, number, k, [[{"x": x, "y": y} for x, y in ring] for ring in part], {c: str(v) for c, v in properties.items() if v is not None}


def _geopackage(content: bytes) -> Iterator[tuple[list, dict]]:
    base = sqlite3.connect(":memory:")
    base.deserialize(content)
    for name, column in base.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
        rows = base.execute(f'SELECT * FROM "{name}"')
        columns = [d[0] for d in rows.description]
        for row in rows:
            values = dict(zip(columns, row))
            blob = values.pop(column)
            if blob:
                envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
                yield parts_of_wkb(blob[8 + envelope :]), values


def _shapefile(content: bytes) -> Iterator[tuple[list, dict]]:
    at = 100
    while at + 8 <= len(content):
        number, size = struct.unpack_from(">ii", content, at)
        (kind,) = struct.unpack_from("<i", content, at + 8)
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<ii", content, at + 44)
            starts = [*struct.unpack_from(f"<{n_parts}i", content, at + 52), n_points]
            values = struct.unpack_from(f"<{2 * n_points}d", content, at + 52 + 4 * n_parts)
            points = list(zip(values[::2], values[1::2]))
            rings = [points[a:b] for a, b in zip(starts, starts[1:])]
            parts: list = []
            for ring in rings:  # outer rings run clockwise; holes follow their outer ring
                turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
                ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
                if turn < 0 or not parts:
                    parts.append([ring])
                else:
                    parts[-1].append(ring)
            yield parts, {"record": number}
        at += 8 + 2 * size


def _attributes(content: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """Number and attributes of the records of a shapefile's table (dBase)."""
    count, head, size = struct.unpack_from("<IHH", content, 4)
    columns, at = [], 32
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("latin-1")
        columns.append((name, content[at + 16]))
        at += 32
    for k in range(count):
        at, values = head + k * size + 1, {}
        for name, width in columns:
            text = content[at : at + width]
            try:
                value = text.decode("utf-8").strip()
            except UnicodeDecodeError:
                value = text.decode("latin-1").strip()
            if value.strip("\0"):
                values[name] = value
            at += width
        yield k + 1, values


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """Layers of GeoPackages and shapefiles with their attributes, told by their suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, layer, content in zip(batch["path"], batch["layer_key"], batch["content"]):
                found = _geopackage(content) if name.lower().endswith(".gpkg") else _shapefile(content)
                rows = pd.DataFrame(list(_rows(layer, found)), columns=["layer_key", "feature", "part", "rings", "properties"])
                yield rows.assign(base=name.rpartition(".")[0])

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(name.rpartition(".")[0], str(k), v) for k, v in _attributes(content)], columns=["base", "record", "more"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    layers = files.where(suffix.isin("gpkg", "shp")).select("path", stem(F.col("path")).alias("layer_key"), "content").mapInPandas(run, _LAYER + ", base string")
    more = files.where(suffix == "dbf").select("path", "content").mapInPandas(tables, "base string, record string, more map<string,string>")
    rows = layers.withColumn("record", F.try_element_at("properties", F.lit("record"))).join(more, ["base", "record"], "left")
    added = F.map_filter(F.coalesce("more", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("properties", k))
    return rows.select("layer_key", "feature", "part", "rings", F.map_concat("properties", added).alias("properties"))


def layer(layers: DataFrame, key: str) -> DataFrame:
    """One layer of a batch; empty if there is none of that name."""
    return layers.where(F.col("layer_key") == key)
