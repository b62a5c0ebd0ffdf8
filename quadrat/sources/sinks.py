"""Sinks.  Order is never kept; every sink is a partitioned write that a retried task may repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import geometry as g


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A manifest as CSV with a header; lists are written like ``[1.0, 2.0]``."""
    out = [F.concat(F.lit("["), F.array_join(F.col(f.name).cast("array<string>"), ", "), F.lit("]")).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*out).write.mode(mode).option("header", True).csv(path)


def feature(ring: Column, properties: Column | None = None) -> Column:
    """A GeoJSON feature."""
    coordinates = F.array(F.transform(g.closed(ring), lambda p: F.array(p["x"], p["y"])))
    shape = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), (properties if properties is not None else F.create_map().cast("map<string,string>")).alias("properties"))


def feature_collections(df: DataFrame, key: str, ring: str = "ring", per_file: int = 100_000) -> DataFrame:
    """``key, part, value``: GeoJSON texts with at most ``per_file`` features each; none for a key without features."""
    rows = df.where(F.size(ring) > 2).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(ring))) - 1).withColumn("part", F.floor(F.col("_n") / per_file).cast("int"))
    grouped = rows.groupBy(key, "part").agg(F.collect_list(feature(F.col(ring))).alias("features"))
    return grouped.select(key, "part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))


def write_geojson(df: DataFrame, path: str, key: str, ring: str = "ring", mode: str = "append") -> None:
    """GeoJSON files in a folder per key."""
    feature_collections(df, key, ring).select(key, "value").write.mode(mode).partitionBy(key).text(path)


def batch_names(df: DataFrame, name: str, extension: str) -> DataFrame:
    """Numbered output names ``name_00000000.ext`` per batch; empty batches count too."""
    return df.withColumn("file_name", F.format_string(f"{name}_%08d.{extension}", F.col("batch_id").cast("int")))


def write_database(df: DataFrame, url: str, table: str, user: str, password: str, ring: str = "ring", mode: str = "append") -> None:
    """A database table with the geometry as well-known text."""
    df.withColumn(ring, g.to_wkt(F.col(ring))).write.format("jdbc").options(url=url, dbtable=table, user=user, password=password).mode(mode).save()


def write_rasters(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rasters as partitioned Parquet, a folder per kind of mask."""
    df.write.mode(mode).partitionBy("mask").parquet(path)


def detections_json(df: DataFrame) -> DataFrame:
    """``image, value``: the detections of an image as a JSON list, best first."""
    item = F.struct((-F.col("score")).alias("_o"), "det", F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), "score", "label").alias("v"))
    return df.groupBy("image").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"])).alias("value"))


def write_detections(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The detections of each image as a JSON text, in a folder per image."""
    detections_json(df).write.mode(mode).partitionBy("image").text(path)


def write_image_files(df: DataFrame, folder: str, extension: str = "png") -> None:
    """Rasters or masks as image files in a shared folder."""
    from quadrat.sources.images import write_images

    write_images(df, folder, extension, extension).write.format("noop").mode("overwrite").save()


def boxes_json(df: DataFrame, key: str) -> DataFrame:
    """Box lists as they are read: ``[{"class": ..., "bbox": [x, y, w, h]}]``."""
    item = F.struct("pos", F.struct("class", F.array("x", "y", "w", "h").alias("bbox")).alias("v"))
    return df.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"])).alias("body"))


def polygons_json(df: DataFrame, key: str) -> DataFrame:
    """Polygon lists as they are read."""
    points = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    item = F.struct("pos", F.struct("class", points.alias("polygon")).alias("v"))
    return df.groupBy(key, "width", "height").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"]).alias("objects")).select(key, F.to_json(F.struct(F.col("width").alias("imgWidth"), F.col("height").alias("imgHeight"), "objects")).alias("body"))


#: What a pipeline may write, by name (an allow-list; nothing is imported by name).
EXPORTS: dict[str, Callable] = {"manifest": write_manifest, "geojson": write_geojson, "database": write_database, "rasters": write_rasters, "images": write_image_files, "detections": write_detections}


def export(kind: str, df: DataFrame, *args: str, **options: str) -> None:
    """Dispatch to a sink by name."""
    if kind not in EXPORTS:
        raise ValueError(f"unknown sink {kind}")
    EXPORTS[kind](df, *args, **options)
