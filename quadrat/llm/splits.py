"""Splits in given proportions that keep bound records together.

Records of a sheet form a block; a record of several sheets binds them.  Blocks of a component
form a group.  Which groups go to which split is a subset-sum problem over the multiset of group
sizes: for each split but the largest, a bitset over reachable totals (one shift per power of two
of each size's multiplicity) gives the total closest to the wanted one, exactly and at any size,
and walking back tells how many groups of each size to take.  Only the histogram of sizes reaches the driver,
which has at most sqrt(2 n) entries for n records.

Cases and their result
----------------------
* A record that tells no sheet is a group of its own (its ``group_id`` is NULL in the result, and
  it takes the split that its id draws in the given proportions).
* Repeated records count each.  Empty tables give no rows.
* A group larger than the wanted total of every small split stays in the largest split.
* Among equally good totals the smaller wins; within a size, groups go by their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.components import components
from quadrat.llm.tiles import located
from quadrat.session import cut, small

def grouped(rows: DataFrame, tile_list: DataFrame) -> DataFrame:
    """``rows`` (with ``path``) plus ``group_id``, the smallest sheet bound to the row's sheets."""
    tiles = located(rows, tile_list)
    columns = [c for c in tiles.columns if c not in ("sheets", "number")]
    bound = tiles.where("size(sheets) > 1").select(F.explode(F.transform("sheets", lambda s: F.struct(F.col("sheets")[0].alias("a"), s.alias("b")))).alias("e")).select("e.*")
    roots = components(bound)
    plain = tiles.withColumn("node", F.get("sheets", F.lit(0)))
    joined = plain.join(small(roots), "node", "left")
    return joined.select(*columns, F.coalesce("root", "node").alias("group_id"))


def closest_subset(sizes: dict[int, int], target: float) -> dict[int, int]:
    """How many of each size to take so that the total is closest to ``target``.

    ``sizes`` maps a size to its multiplicity.  Totals are exact for any number of records: the
    bitsets on the way aren't kept, but made again from the middle one of each half, so that only
    as many as the logarithm of the number of steps are held at once.
    """
    limit = int(2 * target) + 1  # nothing above twice the target is closer than taking none
    keep = (1 << (limit + 1)) - 1
    steps: list[tuple[int, int]] = []  # size, how many at once
    for size, many in sorted(sizes.items(), reverse=True):
        power = 1
        while many > 0 and size <= limit:
            take = min(power, many)
            steps.append((size, take))
            many -= take
            power *= 2

    def after(bits: int, first: int, last: int) -> int:
        for size, take in steps[first:last]:
            if size * take <= limit:
                bits = (bits | bits << (size * take)) & keep
        return bits

    bits = after(1, 0, len(steps))
    low = bits & ((1 << (int(target) + 1)) - 1)
    best = low.bit_length() - 1
    high = bits >> (int(target) + 1)
    if high:
        above = int(target) + 1 + ((high & -high).bit_length() - 1)
        best = above if above - target < target - best else best
    del bits, low, high
    taken: dict[int, int] = {}

    def walk(before: int, first: int, last: int, total: int) -> int:
        """Take what steps ``first`` to ``last`` add to reach ``total``, and return what is left of it."""
        if first == last or before >> total & 1:
            return total
        if last - first > 1:
            middle = (first + last) // 2
            return walk(before, first, middle, walk(after(before, first, middle), middle, last, total))
        size, take = steps[first]
        taken[size] = taken.get(size, 0) + take
        return total - size * take

    walk(1, 0, len(steps), best)
    return taken


def plan_splits(sizes: dict[int, int], portions: list[tuple[str, float]]) -> list[tuple[int, str, int, int]]:
    """``size, split, first, last``: of the groups of a size, those with these ranks go to the split."""
    total = sum(s * n for s, n in sizes.items())
    whole = sum(p for _, p in portions) or 1.0
    left, begin, out = dict(sizes), dict.fromkeys(sizes, 1), []
    ordered = sorted(portions, key=lambda x: (x[1], x[0]))
    for split, portion in ordered[:-1]:
        for size, n in closest_subset({s: n for s, n in left.items() if n}, total * portion / whole).items():
            out.append((size, split, begin[size], begin[size] + n - 1))
            begin[size] += n
            left[size] -= n
    return out + [(size, ordered[-1][0], begin[size], begin[size] + n - 1) for size, n in left.items() if n]


def _ranked(groups: DataFrame, buckets: int = 64) -> DataFrame:
    """Rank of a group among those of its size, in two steps so that no size is one task."""
    spread = groups.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    counts = spread.groupBy("n", "bucket").agg(F.count("*").alias("k"))
    before = counts.select("n", "bucket", (F.sum("k").over(W.partitionBy("n").orderBy("bucket")) - F.col("k")).alias("before"))
    inner = spread.withColumn("r", F.row_number().over(W.partitionBy("n", "bucket").orderBy("group_id")))
    return inner.join(before, ["n", "bucket"]).select("group_id", "n", (F.col("r") + F.col("before")).alias("rank"))


def assign_splits(records: DataFrame, plan: DataFrame) -> DataFrame:
    """``records`` (with ``rec_id`` and ``group_id``) plus ``split``, in the portions of ``plan``."""
    spark = records.sparkSession
    records = cut(records)
    groups = cut(_ranked(records.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))))
    sizes = {r["n"]: r["k"] for r in groups.groupBy("n").agg(F.count("*").alias("k")).collect()}
    portions = [(r["split"], r["portion"]) for r in plan.where("portion > 0 and split is not null").groupBy("split").agg(F.max("portion").alias("portion")).orderBy("split").collect()]
    if not portions:
        return records.withColumn("split", F.lit(None).cast("string"))
    ranges = spark.createDataFrame(plan_splits(sizes, portions), "n bigint, split string, first bigint, last bigint")
    chosen = groups.join(F.broadcast(ranges), "n").where("rank between first and last").select("group_id", "split")
    draw = F.pmod(F.xxhash64("rec_id"), F.lit(1_000_000)) / 1e6 * sum(p for _, p in portions)
    alone, edge = F.lit(portions[-1][0]), 0.0
    for split, portion in portions:
        edge += portion
        alone = F.when((draw < edge) & (draw >= edge - portion), split).otherwise(alone)
    with_group = records.where("group_id is not null").join(small(chosen), "group_id").select(*records.columns, "split")
    return with_group.unionByName(records.where("group_id is null").withColumn("split", alone))
