"""Annotation files of images: boxes, polygons and keypoints as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g


def boxes_of(body: Column) -> Column:
    """Boxes ``struct<class, bbox>`` of a body; broken ones give NULL."""
    return F.from_json(body, "array<struct<class:int,bbox:array<double>>>")


def polygons_of(body: Column) -> Column:
    """``struct<imgWidth, imgHeight, objects>`` of a body, each object with class and polygon."""
    return F.from_json(body, "struct<imgWidth:int,imgHeight:int,objects:array<struct<class:int,polygon:array<array<double>>>>>")


def keypoints_of(body: Column) -> Column:
    """Keypoints of a body, a list of points per object; broken ones give NULL."""
    return F.transform(F.from_json(body, "array<array<array<double>>>"), lambda points: F.transform(points, lambda p: g.point(p[0], p[1])))


def polygon_of(body: Column) -> Column:
    """The ring of a cropped polygon's body."""
    return F.transform(F.from_json(body, "struct<polygon:array<array<double>>>")["polygon"], lambda p: g.point(p[0], p[1]))


def explode_boxes(files: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per box with some extent: ``key, pos, class, x, y, w, h``."""
    rows = files.select(key, F.posexplode(boxes_of(F.col(body))).alias("pos", "b")).where("size(b.bbox) = 4")
    return rows.select(key, "pos", "b.class", *[F.col("b.bbox")[i].alias(n) for i, n in enumerate("xywh")]).where("w > 0 and h > 0")


def explode_polygons(files: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per object: ``key, width, height, pos, class, ring``."""
    rows = files.select(key, polygons_of(F.col(body)).alias("d"))
    rows = rows.select(key, F.col("d.imgWidth").alias("width"), F.col("d.imgHeight").alias("height"), F.posexplode("d.objects").alias("pos", "o"))
    return rows.select(key, "width", "height", "pos", "o.class", F.transform("o.polygon", lambda p: g.point(p[0], p[1])).alias("ring"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as ``file_path, body``; ``path`` may be a glob."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file_path"), F.col("value").alias("body"))
