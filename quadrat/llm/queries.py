"""Queries of the problems on training text and training tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.leaks import leaked_items
from quadrat.llm.overlap import cross_split_pairs, overlap_report
from quadrat.llm.packing import fill_report, pack_documents
from quadrat.llm.splits import assign_splits, grouped
from quadrat.llm.subjects import document_subjects
from quadrat.session import table


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "dsg_dataset").select(F.col("row_id").alias("rec_id"), "split", "producer", F.col("image").alias("path"))
    tiles = table(spark, sf_dir, "selected_tiles").select(F.col("id").alias("rec_id"), "split", "producer", F.col("image_path").alias("path"))
    return manifest.unionByName(tiles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of sheets that each listed row must stay with."""
    return grouped(_listed(spark, sf_dir).select("rec_id", "path"), table(spark, sf_dir, "selected_tiles"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of each listed row, groups kept whole."""
    return assign_splits(p2_found(spark, sf_dir), table(spark, sf_dir, "split_plan"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training row and a held-out row that show the same tile."""
    pairs = cross_split_pairs(_listed(spark, sf_dir), table(spark, sf_dir, "selected_tiles"))
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-split overlaps counted per split and both producers."""
    return overlap_report(_listed(spark, sf_dir), table(spark, sf_dir, "selected_tiles"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of every capacity."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_pack(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items whose passage they give away."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents and leaked items per source and suite."""
    leaks = p8_found(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source").distinct(), "doc_id")
    suites = table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    return leaks.join(suites, "item_id").groupBy("source", "suite").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("item_id").alias("n_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of each document."""
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per subject and source."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p9_found(spark, sf_dir).join(sources, "doc_id").groupBy("subject", "source").agg(F.countDistinct("doc_id").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p3_found, p3_report, p7_pack, p7_fill, p8_found, p8_by_suite, p9_found, p9_composition)}

SQL: dict[str, str] = {}
