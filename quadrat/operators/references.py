"""References to records that do not exist, with the reason.

References and the validity intervals of parent versions become events on one line, sorted by key
and time: a version comes, goes, or is only known of; a reference asks.  Both streams are
partitioned by range of key and time together and sorted, and one linear merge per partition
counts the versions that are there at each reference.

A key may hold a third of all rows, all of one moment even: as the ranges are cut by key, time and
row, it is spread over as many partitions as it needs.  Only the first and the last key of a
partition can go on in another one.  For these a partition leaves totals, two rows at most; their
running sums over the partitions correct the references of cut keys.  A key is carried as two
independent hashes of 96 bits together (of 10^10 keys two collide with a probability below 10^-9).

Cases and their result
----------------------
* NULL and placeholder references are no references: no row.
* Parents with a NULL key are ignored.  A version without ``stored_at`` makes the key occur but
  is never there; one that is deleted before or when it was stored is never there.
* A reference without a date finds no version there and nothing later: ``missing`` if its key
  never occurs, else ``deleted``.
* Repeated parents count like one; repeated references give a row each.
* Columns beyond those named are not read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.paths import real_path
from quadrat.session import kept

#: Events of a partition of the merge, about.
PER_PARTITION = 1_000_000
#: Codes of events in the order in which they count within a moment; references have ``_ASKS`` plus their field's place.
_GOES, _KNOWN, _COMES, _ASKS = 0, 1, 2, 3
#: The moment of what has no date.
_NEVER = -(2**63)
_REASONS = ["missing", "late", "deleted"]
_KEY = ["h1", "h2"]
_MERGED = "row_id bigint, field int, at bigint, reason int, part int, run int, alive bigint, later boolean, stored bigint, h1 bigint, h2 int"


def _hashes(path: Column) -> list[Column]:
    return [F.xxhash64(path).alias("h1"), F.hash(path).alias("h2")]


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; of a timestamp without zone as it is written."""
    at = F.col(name)
    if df.select(at).schema[0].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    return F.unix_micros(at.cast("timestamp"))


def merge_events(h1: np.ndarray, h2: np.ndarray, at: np.ndarray, tag: np.ndarray) -> dict[str, np.ndarray]:
    """Per event of a sorted partition: its key's run, the versions there, and whether one is stored later.

    ``runs`` has per run the sum of comings and goings, and the number of versions.
    """
    n = len(tag)
    begins = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
    ends = np.append(begins[1:], n)
    run = np.repeat(np.arange(len(begins)), ends - begins)
    step = np.where(tag == _COMES, 1, np.where(tag == _GOES, -1, 0))
    known = ((tag == _KNOWN) | (tag == _COMES)).astype(np.int64)
    steps, stored = np.cumsum(step), np.cumsum(known)
    before = lambda total: np.concatenate(([0], total))[begins]
    totals = np.stack([steps[ends - 1] - before(steps), stored[ends - 1] - before(stored)])
    later = stored < stored[ends - 1][run]
    return {"run": run, "alive": steps - before(steps)[run], "later": later & (at != _NEVER), "begins": begins, "totals": totals}


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orphans of the keys that lie within the partition; of the outer keys all references, and totals."""
    parts = list(batches)
    table = pa.Table.from_batches(parts) if parts else None
    if table is None or not len(table):
        return
    h1, h2, at, tag = (table.column(c).to_numpy() for c in ("h1", "h2", "at", "tag"))
    m = merge_events(h1, h2, at, tag)
    run, last, stored = m["run"], len(m["begins"]) - 1, m["totals"][1]
    outer = (run == 0) | (run == last)
    asks = np.flatnonzero((tag >= _ASKS) & (outer | (m["alive"] <= 0) | (at == _NEVER)))
    n, edges = len(asks), [0, last] if last else [0]
    reason = np.where(stored[run] == 0, 0, np.where(m["later"], 1, 2))[asks]
    at_run, ends = run[asks], m["begins"][edges]
    part = TaskContext.get().partitionId()
    out = {
        "row_id": pa.chunked_array([table.column("row_id").combine_chunks().take(pa.array(asks)), pa.nulls(len(edges), pa.int64())]).combine_chunks(),
        "field": pa.array(np.append(tag[asks] - _ASKS, [-1] * len(edges)).astype(np.int32)),
        "at": pa.array(np.append(at[asks], at[ends])),
        "reason": pa.array(np.append(reason, [-1] * len(edges)).astype(np.int32)),
        "part": pa.array(np.full(n + len(edges), part, np.int32)),
        "run": pa.array(np.append(np.where(outer[asks], np.minimum(at_run, 1), -1), np.minimum(edges, 1)).astype(np.int32)),
        "alive": pa.array(np.append(m["alive"][asks], m["totals"][0][edges])),
        "later": pa.array(np.append(m["later"][asks], [False] * len(edges))),
        "stored": pa.array(np.append(stored[at_run], stored[edges])),
        "h1": pa.array(np.append(h1[asks], h1[ends])),
        "h2": pa.array(np.append(h2[asks], h2[ends])),
    }
    yield pa.RecordBatch.from_pydict(out)


def carried(totals: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What the other partitions hold of an outer key: ``part, run, alive before, stored before, stored after``.

    ``totals`` has ``part, run, h1, h2, steps, stored`` of the outer keys of every partition.
    """
    rows = sorted(totals)
    out = []
    begin = 0
    for i in range(1, len(rows) + 1):
        if i < len(rows) and rows[i][2:4] == rows[begin][2:4]:
            continue
        alive, seen, whole = 0, 0, sum(r[5] for r in rows[begin:i])
        for part, run, _, _, steps, stored in rows[begin:i]:
            out.append((part, run, alive, seen, whole - seen - stored))
            alive, seen = alive + steps, seen + stored
        begin = i
    return out


def orphan_references(
    children: DataFrame,
    id_col: str,
    fields: list[str],
    at_col: str,
    parents: DataFrame,
    key_col: str,
    from_col: str,
    to_col: str,
) -> DataFrame:
    """References (``row_id, ref_field, at, reason``) of ``children.fields`` to no parent version.

    A version is there from ``from_col`` until ``to_col`` (NULL: still there).
    """
    spark = children.sparkSession
    dated = lambda c: F.coalesce(c, F.lit(_NEVER))
    refs = children.select(
        F.col(id_col).cast("bigint").alias("row_id"),
        dated(_micros(children, at_col)).alias("at"),
        F.explode(F.array(*[F.struct(F.lit(_ASKS + k).alias("tag"), F.col(f).alias("path")) for k, f in enumerate(fields)])).alias("r"),
    ).where("r.path is not null")
    refs = refs.select("row_id", "at", "r.tag", real_path(F.col("r.path")).alias("path")).where("path is not null").select(*_hashes(F.col("path")), "at", "tag", "row_id")

    versions = parents.select(real_path(F.col(key_col)).alias("path"), _micros(parents, from_col).alias("born"), _micros(parents, to_col).alias("died")).where("path is not null")
    lives = F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("died") > F.col("born")))
    moment = lambda at, tag: F.struct(at.alias("at"), F.lit(tag).alias("tag"))
    came = F.when(lives, moment(dated(F.col("born")), _COMES)).otherwise(moment(dated(F.col("born")), _KNOWN))
    went = F.when(lives & F.col("died").isNotNull(), moment(F.col("died"), _GOES))
    moves = versions.select(*_hashes(F.col("path")), F.explode(F.array_compact(F.array(came, went))).alias("e")).select(*_KEY, "e.at", "e.tag", F.lit(None).cast("bigint").alias("row_id"))

    events = kept(refs.unionByName(moves))
    context = spark.sparkContext
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism, -(-events.count() // PER_PARTITION))
    order = [*_KEY, "at", "tag", "row_id"]
    merged = kept(events.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_merge, _MERGED))

    totals = merged.where("field < 0").select("part", "run", *_KEY, "alive", "stored").collect()  # two per partition
    carry = spark.createDataFrame(carried([tuple(r) for r in totals]), "part int, run int, before bigint, seen bigint, ahead bigint")
    inner = merged.where("field >= 0 and run < 0").select("row_id", "field", "at", "reason")
    outer = merged.where("field >= 0 and run >= 0").join(F.broadcast(carry), ["part", "run"])
    dateless = F.col("at") == _NEVER
    outer = outer.where((F.col("alive") + F.col("before") <= 0) | dateless)
    late = F.col("later") | ((F.col("ahead") > 0) & ~dateless)
    reason = F.when(F.col("stored") + F.col("seen") + F.col("ahead") == 0, 0).when(late, 1).otherwise(2)
    found = inner.unionByName(outer.select("row_id", "field", "at", reason.alias("reason")))

    zoneless = children.select(at_col).schema[0].dataType.typeName() == "timestamp_ntz"
    back = F.timestamp_add("MICROSECOND", F.col("at"), F.lit("1970-01-01").cast("timestamp_ntz")) if zoneless else F.timestamp_micros(F.col("at"))
    pick = lambda names, code: F.element_at(F.array(*map(F.lit, names)), F.col(code) + 1)
    return found.select("row_id", pick(fields, "field").alias("ref_field"), F.when(F.col("at") != _NEVER, back).alias("at"), pick(_REASONS, "reason").alias("reason"))


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphans counted per field, month of the reference and reason."""
    return orphans.groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n"))
