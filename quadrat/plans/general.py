"""Queries of the general data problems (p1, p4, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.drift import schema_changes, unified_records
from quadrat.operators.nested import KINDS, flatten_annotations, node_table
from quadrat.operators.packed import explode_packed
from quadrat.operators.references import orphan_references, orphans_by_period
from quadrat.session import table

PACKED = ["bands_means", "bands_stds", "class_freq"]
REFERENCES = ["image", "polygon_mask", "boundary_mask", "polygon_lists"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed band value of the manifest."""
    return explode_packed(table(spark, sf_dir, "dsg_dataset"), "row_id", PACKED)


def p1_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and range of the values per field and band position."""
    return p1_found(spark, sf_dir).groupBy("field_name", "pos").agg(F.count("*").alias("n_values"), F.min("value_micro").alias("least"), F.max("value_micro").alias("most"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the annotation bodies with their parents."""
    return flatten_annotations(table(spark, sf_dir, "annotation_files"), payloads=False).select("file_id", "node_kind", "node_path", "parent_path")


def _typed(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return node_table(flatten_annotations(table(spark, sf_dir, "annotation_files")), kind)

    query.__name__ = {"category": "p4_categories", "box": "p4_boxes"}.get(kind, f"p4_{kind}s")
    query.__doc__ = f"The typed table of the kind {kind}."
    return query


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema changes of each manifest file against the one before it."""
    return schema_changes(table(spark, sf_dir, "manifest_records"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifest lines under one schema, whatever their file calls a field."""
    return unified_records(table(spark, sf_dir, "manifest_records"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, "dsg_dataset"), "row_id", REFERENCES, "listed_at", table(spark, sf_dir, "stored_files"), "file_path", "stored_at", "deleted_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the manifest to files that are not there."""
    return _orphans(spark, sf_dir).select("row_id", "ref_field", "reason")


def p6_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per field, month and reason."""
    return orphans_by_period(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_bands, p4_found, *map(_typed, KINDS), p5_found, p5_unified, p6_found, p6_by_period)}

_PATH = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./|/)+', '')"
_ORPHANS = (
    "WITH refs AS (SELECT row_id, listed_at, ref_field, "
    + _PATH.format("raw")
    + " AS path FROM ("
    + " UNION ALL ".join(f"SELECT row_id, listed_at, '{f}' AS ref_field, {f} AS raw FROM dsg_dataset WHERE {f} IS NOT NULL" for f in REFERENCES)
    + ")), keys AS (SELECT "
    + _PATH.format("file_path")
    + " AS path, stored_at, deleted_at FROM stored_files WHERE file_path IS NOT NULL), "
    "orphans AS (SELECT r.row_id, r.ref_field, r.listed_at, CASE WHEN count(k.path) = 0 THEN 'missing' WHEN max(k.stored_at) > r.listed_at THEN 'late' ELSE 'deleted' END AS reason, "
    "coalesce(bool_or(k.stored_at <= r.listed_at AND NOT coalesce(k.deleted_at <= r.listed_at, false)), false) AS there "
    "FROM refs r LEFT JOIN keys k ON k.path = r.path WHERE r.path NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', '-') "
    "GROUP BY r.row_id, r.ref_field, r.listed_at HAVING NOT there) "
)

SQL = {
    "p6_found": _ORPHANS + "SELECT row_id, ref_field, reason FROM orphans",
    "p6_by_period": _ORPHANS + "SELECT ref_field, strftime(listed_at, '%Y-%m') AS period, reason, count(*) AS n FROM orphans GROUP BY ALL",
}
