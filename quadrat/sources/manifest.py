"""Manifests and image lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.paths import under_root

#: One row per image, as manifests are written (list fields as text).
ENTRY = (
    "image string, width int, height int, polygon_mask string, bands_means string, bands_stds string, class_freq string, "
    "boundary_mask string, vertex_mask string, crossfield_mask string, distance_mask string, size_mask string, "
    "mask_is_single_band boolean, bounding_boxes string, polygon_lists string"
)
LISTS = ("bands_means", "bands_stds", "class_freq")


def number_list(text: Column) -> Column:
    """Numbers of a list written with brackets and with commas or blanks between; others are NULL."""
    bare = F.trim(F.regexp_replace(text, r"[\[\](),\s]+", " "))
    return F.when(text.isNull(), None).otherwise(F.transform(F.filter(F.split(bare, " "), lambda x: x != ""), lambda x: x.try_cast("double")))


def read_manifest(spark: SparkSession, path: str, n_first_rows: int | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """A manifest file with typed lists.

    Columns are taken by the file's header, whatever their order; missing ones are NULL.  ``keys``
    renames the file's columns to ours.  ``n_first_rows`` keeps the first lines of the file.
    """
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    for old, new in (keys or {}).items():
        raw = raw.withColumnRenamed(old, new)
    if n_first_rows is not None:
        raw = raw.limit(n_first_rows)
    out = []
    for field in spark.createDataFrame([], ENTRY).schema.fields:
        have = F.col(field.name) if field.name in raw.columns else F.lit(None)
        value = number_list(have.cast("string")) if field.name in LISTS else have.try_cast(field.dataType)
        out.append(value.alias(field.name))
    return raw.select(*out).withColumn("mask_is_single_band", F.coalesce("mask_is_single_band", F.lit(False)))


def images_of_csv(spark: SparkSession, path: str, key: str, root: str = "/", n_first_rows: int | None = None) -> DataFrame:
    """Image paths of a CSV file's column ``key``, below ``root``."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows if n_first_rows is None else rows.limit(n_first_rows)
    return rows.select(under_root(root, F.col(key)).alias("image"))


def images_of_folder(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Files with an extension below a folder, at any depth; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension.lstrip('.')}").load(folder)
    return files.select(F.col("path").alias("image"), "length", "modificationTime")


def single_image(spark: SparkSession, path: str) -> DataFrame:
    """A list of one image."""
    return spark.createDataFrame([(path,)], "image string")
