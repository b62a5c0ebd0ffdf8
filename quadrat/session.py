"""Session helpers: reading tables, cutting lineage, size-checked broadcasts, joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for data between stages: the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may do without the setting (tests, a laptop); it gets a folder of
    its own.  What is written there goes when the driver ends.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quadrat-")
        context.setCheckpointDir(named)
    folder = context._jsc.sc().getCheckpointDir().get()
    _delete_on_exit(spark, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder by a checkpoint and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a compressed table, for large intermediate results."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df``, which must be cheap to read (cut), marked for broadcast if it holds at most ``most`` bytes.

    The bytes are measured, as text.  Larger tables are returned as they are, so that the join
    shuffles (and AQE splits skew).
    """
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` over at least all cores.

    The number is given, as adaptive execution would put a small input of a costly kernel into
    one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], per_slice: int = 20_000) -> DataFrame:
    """Inner join in which a hot key of either side is spread over several tasks.

    A key that ``left`` holds n times and ``right`` m times is cut into ceil(n / per_slice) slices
    of the one and ceil(m / per_slice) of the other; each pair of slices meets in a task of its own,
    so that no task gets more than ``per_slice`` rows of a key from either side.  The slice of a row
    follows from its other columns, so equal rows share one.  Rows with a null key join nothing.
    """

    def slices(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(per_slice)).cast("int").alias(name)).where(F.col(name) > 1)

    hot = cut(slices(left, "_of_left").join(slices(right, "_of_right"), keys, "full"))
    if hot.isEmpty():
        return left.join(right, keys)
    hot = small(hot)

    def sliced(side: DataFrame, own: str, other: str) -> DataFrame:
        # a hash of the row and no random number: a task that is run again must give the same slices
        row = F.xxhash64(*[c for c in side.columns if c not in keys])
        many = lambda name: F.coalesce(name, F.lit(1))
        out = side.join(hot, keys, "left").withColumn(f"{own}_slice", F.pmod(row, many(own)).cast("int"))
        return out.withColumn(f"{other}_slice", F.explode(F.sequence(F.lit(0), many(other) - 1))).drop(own, other)

    both = ["_of_left_slice", "_of_right_slice"]
    return sliced(left, "_of_left", "_of_right").join(sliced(right, "_of_right", "_of_left"), [*keys, *both]).drop(*both)


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a broadcast of ``right`` if it is small, else with hot keys spread."""
    hinted = small(right)
    return left.join(hinted, keys) if hinted is not right else salted_join(left, right, keys)
