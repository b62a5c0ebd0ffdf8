"""Which tile a file name tells: the sheets it was cut from and its number.

A tile is a sheet and a number, a mosaic two sheets and a number; the order in which a mosaic
names its sheets doesn't matter.  Names are read after case, slashes, blanks and percent
encoding are made alike.  A sheet code may be written without its hyphens, with underscores, or
with ``l`` and ``o`` for ``1`` and ``0`` (and ``0`` for ``O`` in the quadrant).  The number
stands before a double underscore, behind the sheet, or is the first number of a file name that
has no sheet (then its folder tells the sheet).  What follows the number (``_rot90``, ``(1)``,
``_recorte2``) tells how a copy was made and is ignored.

A name without a sheet is looked up in the tile list: the label path listed for the same image
(same last folder and file name without suffix) tells the tile.  If listings disagree, the
smallest tile by sheets and number counts.  NULL and empty names tell nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.session import cut, small

_SHEET = r"([0-9lo]{4})[-_ ]?([1-4l])[-_ ]?([ns][eo0])(?![0-9a-z])"


def _clean(path: Column) -> Column:
    text = F.regexp_replace(F.lower(path), "%20|[\\s\u00a0]", " ")
    text = F.regexp_replace(F.regexp_replace(text, "%2b", "+"), r"%5c|%2f|\\", "/")
    return F.regexp_replace(F.trim(text), r"\.[a-z0-9]{2,4}$", "")


def _last(text: Column) -> Column:
    return F.regexp_extract(text, r"[^/]*$", 0)


def _codes(text: Column) -> Column:
    """Sheet codes in their usual form, sorted, each once."""
    found = F.regexp_extract_all(text, F.lit("(?<![0-9])" + _SHEET), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "[-_ ]", ""))
    usual = F.transform(
        bare,
        lambda x: F.concat(
            F.translate(F.substring(x, 1, 4), "lo", "10"),
            F.lit("-"),
            F.translate(F.substring(x, 5, 1), "l", "1"),
            F.lit("-"),
            F.upper(F.translate(F.substring(x, 6, 2), "0", "o")),
        ),
    )
    return F.array_sort(F.array_distinct(usual))


def tile_of(path: Column) -> Column:
    """``struct<sheets array<string>, number bigint>`` told by a path; empty sheets: it tells none."""
    clean = _clean(path)
    name = _last(clean)
    own = _codes(name)
    front = F.regexp_extract(name, r"^(\d+)__", 1)
    behind = F.regexp_extract(name, ".*(?<![0-9])" + _SHEET + r"[-_ ]+(\d+)", 4)
    any_number = F.regexp_extract(name, r"(\d+)", 1)
    named = F.size(own) > 0
    number = F.when(front != "", front).when(named, behind).otherwise(any_number)
    sheets = F.when(named, own).otherwise(_codes(clean))
    return F.struct(sheets.alias("sheets"), F.when(number != "", number).try_cast("bigint").alias("number"))


def image_key(path: Column) -> Column:
    """Last folder and file name without suffix: the same image under the habits of all offices."""
    return F.regexp_extract(F.regexp_replace(_clean(path), "/+", "/"), r"(?:[^/]*/)?[^/]*$", 0)


def located(rows: DataFrame, tile_list: DataFrame) -> DataFrame:
    """``rows`` (with ``path``) plus ``sheets`` and ``number``, looked up in ``tile_list`` if need be.

    ``tile_list`` has ``image_path`` and ``label_path``.  The result is cut from its lineage, as
    each use would parse all names again.  Only the few names that tell nothing are joined.
    """
    told = cut(rows.withColumn("tile", tile_of(F.col("path"))).withColumn("key", F.when(F.size("tile.sheets") < 1, image_key(F.col("path")))).drop("path"))
    labels = tile_list.select(image_key(F.col("image_path")).alias("key"), tile_of(F.col("image_path")).alias("own"), tile_of(F.col("label_path")).alias("label"))
    labels = cut(labels.where("size(own.sheets) < 1 and size(label.sheets) > 0").groupBy("key").agg(F.min("label").alias("label")))
    known = told.where("key is null").select("*", F.lit(None).cast("struct<sheets:array<string>,number:bigint>").alias("label"))
    asked = told.where("key is not null").join(small(labels), "key", "left")
    both = known.unionByName(asked)
    tile = F.when(F.col("key").isNull(), F.col("tile")).otherwise(F.col("label"))
    return both.withColumn("tile", tile).select(*[c for c in told.columns if c not in ("tile", "key")], F.coalesce("tile.sheets", F.array().cast("array<string>")).alias("sheets"), F.col("tile.number").alias("number"))
