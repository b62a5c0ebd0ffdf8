"""The same or nearly the same record on both sides of a split.

A record is reduced to the canonical name of what it shows; its hash is joined between
evaluation and training records, and the names are compared behind the hash.  A name that
training holds very often is spread over several tasks.

Cases and their result
----------------------
* A record without split, with an unknown split, or whose name tells no tile takes no part.
* Repeated records pair each; validation and test records don't pair with each other.
* A record sent twice under two ids is two records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.tiles import located
from quadrat.session import cut, salted_join

#: Spellings of the splits after trimming and lower case.
TRAIN = ["train", "training", "treino", "treinamento"]
VAL = ["val", "valid", "validation", "validacao", "validação"]
TEST = ["test", "testing", "teste"]


def split_of(text: Column) -> Column:
    """``train``, ``val``, ``test`` or NULL, however the split is spelled."""
    plain = F.regexp_replace(F.lower(text), "^[\\s\u00a0]+|[\\s\u00a0]+$", "")
    return F.when(plain.isin(TRAIN), "train").when(plain.isin(VAL), "val").when(plain.isin(TEST), "test")


def _named(rows: DataFrame, tile_list: DataFrame) -> DataFrame:
    """``rec_id, split, producer, name`` of the rows with a split whose name tells a tile."""
    sided = rows.select("rec_id", split_of(F.col("split")).alias("split"), "producer", "path").where("split is not null")
    tiles = located(sided, tile_list).where("size(sheets) > 0 and number is not null")
    name = F.concat(F.array_join("sheets", "+"), F.lit("#"), F.col("number").cast("string"))
    return tiles.select("rec_id", "split", "producer", name.alias("name"))


def cross_split_pairs(rows: DataFrame, tile_list: DataFrame) -> DataFrame:
    """Evaluation and training rows that show the same tile.

    ``rows`` has ``rec_id, split, producer, path``.  Columns: ``eval_id, eval_split, eval_producer,
    train_id, train_producer``.
    """
    named = _named(rows, tile_list).withColumn("hash", F.xxhash64("name"))
    train = named.where("split = 'train'").select("hash", F.col("name").alias("train_name"), F.col("rec_id").alias("train_id"), F.col("producer").alias("train_producer"))
    held = named.where("split <> 'train'").select("hash", F.col("name").alias("eval_name"), F.col("rec_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("producer").alias("eval_producer"))
    return salted_join(train, held, ["hash"]).where("train_name = eval_name").select("eval_id", "eval_split", "eval_producer", "train_id", "train_producer")


def overlap_report(rows: DataFrame, tile_list: DataFrame) -> DataFrame:
    """Overlaps counted per split and both producers, without listing the pairs.

    ``eval_split, eval_producer, train_producer, n_pairs, n_rows``; ``n_rows`` are the evaluation
    rows with a partner of that training producer.  Rows are counted by tile, split and producer first
    (partial sums on the map side, so that a hot tile costs a few rows), and the counts are joined.
    """
    counts = cut(_named(rows, tile_list).groupBy("name", "split", "producer").agg(F.count("*").alias("n")))
    train = counts.where("split = 'train'").select("name", F.col("producer").alias("train_producer"), F.col("n").alias("n_train"))
    held = counts.where("split <> 'train'").select("name", F.col("split").alias("eval_split"), F.col("producer").alias("eval_producer"), "n")
    both = salted_join(train, held, ["name"])
    return both.groupBy("eval_split", "eval_producer", "train_producer").agg(F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"), F.sum("n").alias("n_rows"))
