"""Items of varying length in containers of fixed capacity: bounded-space online packing.

Each partition keeps at most ``OPEN`` containers open per capacity.  An item goes where it fits
best; if it fits nowhere and no more may be opened, the fullest container is emitted.  What is
still open at the end of a partition is merged by the same rule, in rounds of ever fewer tasks,
so no task sees more than ``FAN_IN`` times ``OPEN`` containers.

Cases and their result
----------------------
* An item longer than the capacity is cut into pieces of exactly the capacity and a rest, which is
  packed like an item; no other item is cut.
* NULL and empty texts have no tokens: they come out with a NULL container and no place in one.
* Repeated documents are packed each.  A capacity that is NULL or below 1 is ignored; the same
  pack name twice takes its largest capacity.  Empty tables give no rows.
* Whole texts of any length are tokenized.  Columns beyond those named are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.session import cut

#: Where the public tokenizers lie on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts a text before it is merged (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN = 256
FAN_IN = 32

_ITEMS = "array<struct<doc_id:bigint,piece:int,n_tokens:int>>"
_CONTAINER = f"pack string, capacity int, container_id string, used int, still_open boolean, items {_ITEMS}"


def encoding(path: str):
    """The byte-pair encoding whose ranks are in the file ``path``."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Open containers of one capacity, sorted by free space."""

    def __init__(self, pack: str, capacity: int, name: str) -> None:
        self.pack, self.capacity, self.name = pack, capacity, name
        self.count = 0
        self.free: list[tuple[int, int]] = []
        self.items: dict[int, list] = {}

    def _row(self, free: int, number: int, still_open: bool) -> tuple:
        return (self.pack, self.capacity, f"{self.pack}-{self.name}-{number}", self.capacity - free, still_open, self.items.pop(number))

    def add(self, size: int, items: list) -> Iterator[tuple]:
        """Place items of ``size`` tokens together; yields the containers that this closes."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, number = self.free.pop(at)
            self.items[number] += items
        else:
            if len(self.free) >= OPEN:
                yield self._row(*self.free.pop(0), False)
            free, number = self.capacity, self.count
            self.count += 1
            self.items[number] = list(items)
        free -= size
        if free:
            insort(self.free, (free, number))
        else:
            yield self._row(0, number, False)

    def rest(self) -> Iterator[tuple]:
        """What is still open."""
        while self.free:
            yield self._row(*self.free.pop(), True)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 2000:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


_COLUMNS = ["pack", "capacity", "container_id", "used", "still_open", "items"]


def pieces(tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Number and length of the pieces of an item."""
    for number, begin in enumerate(range(0, tokens, capacity)):
        yield number, min(capacity, tokens - begin)


def pack_documents(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack, capacity, container_id, doc_id, piece, n_tokens``: every document in every pack."""
    spark = documents.sparkSession
    rows = packs.where("pack is not null and capacity_tokens >= 1").groupBy("pack").agg(F.max("capacity_tokens").alias("c")).orderBy("pack").collect()
    sizes = [(r["pack"], r["c"]) for r in rows]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        coder = encoding(vocabulary)
        packers = [Packer(p, c, f"0-{TaskContext.get().partitionId()}") for p, c in sizes]

        def filled() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    n = len(coder.encode_to_numpy(text)) if text else 0
                    for packer in packers:
                        for piece, length in pieces(n, packer.capacity):
                            yield from packer.add(length, [(doc_id, piece, length)])
                        if not n:
                            yield (packer.pack, packer.capacity, None, 0, False, [(doc_id, 0, 0)])
            for packer in packers:
                yield from packer.rest()

        yield from _frames(filled(), _COLUMNS)

    def merge(level: int):
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["used", "container_id"], ascending=[False, True])
            packer = Packer(key[0], int(part["capacity"].iat[0]), f"{level}-{key[1]}")
            out = [row for used, items in zip(part["used"], part["items"]) for row in packer.add(int(used), [tuple(i.values()) for i in items])]
            return pd.DataFrame(out + list(packer.rest()), columns=_COLUMNS)

        return run

    level, done = 0, []
    now = cut(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(first, _CONTAINER))
    tasks = max(1, now.rdd.getNumPartitions())
    while True:
        done.append(now.where("not still_open"))
        if tasks == 1 and level:
            done.append(now.where("still_open"))
            break
        level, tasks = level + 1, -(-tasks // FAN_IN)
        slot = F.pmod(F.xxhash64("container_id"), F.lit(tasks)).alias("slot")
        now = cut(now.where("still_open").groupBy("pack", slot).applyInPandas(merge(level), _CONTAINER))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("pack", "capacity", "container_id", F.explode("items").alias("i")).select("pack", "capacity", "container_id", "i.doc_id", "i.piece", "i.n_tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and fill per pack, against the least possible number of containers."""
    return packed.where("container_id is not null").groupBy("pack", "capacity").agg(
        F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    ).select("pack", "capacity", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"))
