"""Relational operators on manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions.paths import stem
from quadrat.session import cut, small


def merge_manifests(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``first`` with the non-null values of ``second``; columns only in ``second`` are left out.

    Both sides are joined by ``key``, which must be unique in each (a positional update of two
    sorted files gives the same if the keys agree; use :func:`same_keys` to assert that).
    """
    shared = [c for c in first.columns if c in second.columns and c != key]
    news = second.select(key, *[F.col(c).alias(f"_new_{c}") for c in shared])
    value = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in shared}
    return first.join(news, key, "left").select(*[value.get(c, F.col(c)).alias(c) for c in first.columns])


def same_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys of only one side; empty if a merge is the same as a positional update."""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def as_boolean(number: Column) -> Column:
    """0 and 1 as booleans, whatever else as NULL."""
    return F.when(number == 0, False).when(number == 1, True)


def missing_outputs(manifest: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Rows whose output doesn't exist yet."""
    return manifest.join(outputs.select(key).distinct(), key, "left_anti")


def shape_groups(manifest: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Number of images per shape, the largest area first: ``rank`` is that order."""
    groups = manifest.where(F.col(width).isNotNull() & F.col(height).isNotNull()).groupBy(width, height).agg(F.count("*").alias("n"))
    area = F.col(width) * F.col(height)
    return groups.withColumn("area", area).withColumn("rank", F.row_number().over(W.orderBy(area.desc(), width, height)))


def first_keys(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct keys by their first appearance (a top-k: no full sort)."""
    return rows.groupBy(key).agg(F.min(order).alias("first")).orderBy("first", key).limit(n)


def padded_extent(manifest: DataFrame, width: str, height: str, unit: int) -> DataFrame:
    """Largest width and height, rounded up to multiples of ``unit``."""
    up = lambda c: (F.ceil(F.max(c) / F.lit(unit)) * unit).cast("bigint")
    return manifest.agg(up(width).alias("pad_width"), up(height).alias("pad_height"))


def numbered(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with consecutive numbers from 0 in the given order.

    Range partitions are numbered one by one and shifted by the rows before them, so that no
    task holds more than its partition.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(parts.withColumn("_id", F.monotonically_increasing_id()))  # range bounds are sampled, so the ids must be kept
    parts = parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id") - F.shiftleft("_part", 33))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return parts.join(small(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_id", "_part", "_in", "_before")


def cycle_zip(longer: DataFrame, shorter: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of the longer side with those of the shorter, which starts over when it ends."""
    size = shorter.agg(F.count("*").alias("_size"))
    a = longer.crossJoin(F.broadcast(size)).where("_size > 0").withColumn("_slot", F.col(pos) % F.col("_size")).drop("_size")
    return a.join(shorter.withColumnRenamed(pos, "_slot"), "_slot").drop("_slot")


def nested_objects(images: DataFrame, objects: DataFrame, key: str, pos: str, outer: bool = True) -> DataFrame:
    """Each image with the list of its objects in order; ``outer`` keeps images without any."""
    fields = [c for c in objects.columns if c != key]
    lists = objects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *[c for c in fields if c != pos]))).alias("objects"))
    return images.join(lists, key, "left" if outer else "inner")


def planned_paths(manifest: DataFrame, image: str, root: str, kinds: list[str]) -> DataFrame:
    """Output folders and files per kind of mask, laid out like the images."""
    folder = F.regexp_extract(image, r"^(.*)/[^/]*$", 1)
    return manifest.select("*", *[F.concat_ws("/", F.lit(root), F.lit(kind), F.when(folder != "", folder), F.concat(stem(F.col(image)), F.lit(".png"))).alias(f"{kind}_path") for kind in kinds])
