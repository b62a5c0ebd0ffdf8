"""Evaluation passages that leaked into a corpus: a prefix-filtered set join on word shingles.

A document leaks an item if it holds a stretch of at least ``STRETCH`` running words of the
item's passage with at most one edited word in ten, the first and the last word being there.  Such a
stretch keeps, in some window of 20 words of the passage, at least ``KEPT`` of the window's five-word
shingles, counted by position (each edit breaks at most five).  So of the window's shingles, ordered by
rarity in the corpus, one of the rarest ``16 - KEPT + 1`` must be in the document: the prefix.

1.  The passages become a table of word hashes, their shingles a bitmap of bounded size.
2.  One pass over the whole texts, for any number of items, keeps which shingles of the passages a
    document may hold, and where (the bitmap lets few others through); the words around are kept
    where at least ``KEPT`` stand close together.
3.  Document frequencies of these shingles, over all documents, give the order of rarity.
4.  Documents are joined with the prefix tokens of the passages.
5.  Joined pairs are filtered by count and position and verified: an edit-distance table over all
    windows of the passage and that region of the document decides exactly.

Words are compared by 64-bit hashes.  Tables that are measured to be small are broadcast; larger ones
are joined by key, hot keys spread.

Cases and their result
----------------------
* NULL and blank texts and passages, and passages of fewer than ``STRETCH`` words: no row.
* Items with the same words in their passage are all found; an item sent twice gives one row.
* A document sent twice under two ids gives rows for both; the same id twice gives one.
* An empty table on either side gives no row.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.text import word_hashes
from quadrat.session import joined, kept

SHINGLE = 5
STRETCH = 20
EDITED = 10  # one word in so many
KEPT = STRETCH - SHINGLE + 1 - SHINGLE * (STRETCH // EDITED)
#: Words before the first and behind the last shingle that a stretch may have.
MARGIN = STRETCH + SHINGLE
#: Words of a region whose table is held at once, or four times the longest stretch if that is more.
WINDOW = 4096
#: The bitmap of the passages' shingles has at most so many bits (16 MB), whatever their number.
BITS = 1 << 27
#: Characters of text that are read at once, unless a single text is longer.
_AT_ONCE = 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            key = (key ^ (key >> np.uint64(29))) * _MIX + words[k : k + n]
        return key ^ (key >> np.uint64(31))


def prefix_keys(keys: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The shingles of a passage that are in the prefix of one of its windows, each once.

    ``keys`` are the shingles by position and ``frequency`` says how common each is.  Of a window's
    positions all but the ``KEPT - 1`` most common are its prefix.
    """
    width = STRETCH - SHINGLE + 1
    windows = np.lib.stride_tricks.sliding_window_view(np.lexsort((keys, frequency)).argsort(), width)
    rarest = np.argsort(windows, axis=1)[:, : width - KEPT + 1]
    return np.unique(keys[np.unique(rarest + np.arange(len(windows))[:, None])])


def holds(passage: np.ndarray, region: np.ndarray) -> bool:
    """Whether ``region`` holds a stretch of ``passage`` with at most one edited word in ten.

    A stretch begins and ends with words that are there.  ``near[s, d]`` is the least number of
    edits between the passage from s on and some run of the region that ends before d; one row of
    words is added per step, for all s at once.  A long region is read in windows that overlap by the
    longest stretch, so that the table is bounded and each stretch lies in one of them.
    """
    starts = len(passage) - STRETCH + 1
    if starts <= 0:
        return False
    longest = len(passage) + len(passage) // EDITED  # words of the region that a stretch covers, at most
    window = max(WINDOW, 4 * longest)
    if len(region) > window:
        return any(holds(passage, region[a : a + window]) for a in range(0, len(region) - longest, window - longest))
    ramp = np.arange(len(region) + 1, dtype=np.int32)
    near = np.zeros((starts, len(region) + 1), np.int32)
    for k in range(len(passage)):
        alive = min(starts, len(passage) - k)
        same = passage[k : k + alive, None] == region[None, :]
        along = near[:alive, :-1] + ~same
        if k == 0:
            moved = np.full(near.shape, len(passage), np.int32)
            moved[:, 1:][same] = 0
        else:
            moved = near[:alive] + 1
            moved[:, 1:] = np.minimum(moved[:, 1:], along)
        if k + 1 >= STRETCH and (along[same] <= (k + 1) // EDITED).any():
            return True
        near = np.minimum.accumulate(moved - ramp, axis=1) + ramp
    return False


def _clusters(places: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """Begin and end, among ``places`` in order, of the groups of places no further apart than ``gap``."""
    cuts = np.flatnonzero(np.diff(places) > gap) + 1
    yield from zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(places)])).tolist())


def reach(n_words: int) -> int:
    """The furthest that two shingles of one stretch of a passage can be apart in a document."""
    return n_words + n_words // EDITED


def leaks(passage: np.ndarray, places: np.ndarray, keys: np.ndarray, words: np.ndarray) -> bool:
    """Whether ``words``, with shingles ``keys`` at ``places``, hold a stretch of the passage."""
    own = places[np.isin(keys, shingle_keys(passage))]
    for a, b in _clusters(own, reach(len(passage))) if len(own) >= KEPT else ():
        if b - a >= KEPT and holds(passage, words[max(0, own[a] - MARGIN) : own[b - 1] + SHINGLE + MARGIN]):
            return True
    return False


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    mask = np.uint64(bits - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of all keys, as 64-bit words; the executors set them, and the driver gets at most ``BITS``."""
    n = keys.count()
    bits = 1 << 16
    while bits < BITS and bits < 256 * n:
        bits <<= 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = np.concatenate(_slots(batch["key"].to_numpy(np.int64).view(np.uint64), bits))
            yield pd.DataFrame({"slot": (slot >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (slot & np.uint64(63))).view(np.int64)})

    words = np.zeros(bits // 64, np.uint64)
    for row in keys.mapInPandas(run, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        words[row["slot"]] = np.uint64(row["bit"] & 0xFFFFFFFFFFFFFFFF)
    return words


def _passages(items: DataFrame, item_col: str, passage_col: str) -> DataFrame:
    """``item_id, pid, words`` of the items whose passage is long enough; equal words have equal ``pid``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, ends = word_hashes(list(batch["p"]))
            rows = [(i, w.view(np.int64)) for i, w in zip(batch["i"], np.split(words, ends[:-1])) if len(w) >= STRETCH]
            yield pd.DataFrame(rows, columns=["item_id", "words"])

    narrow = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(passage_col).alias("p")).where("i is not null and p is not null")
    return narrow.mapInPandas(run, "item_id bigint, words array<bigint>").select("item_id", F.sha2(F.concat_ws(" ", F.col("words").cast("array<string>")), 256).alias("pid"), "words")


def _held(documents: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, gap: int) -> DataFrame:
    """``rid, doc_id, places, keys, words``: stretches of documents that may hold shingles of a passage.

    A stretch with fewer than ``KEPT`` of them has no words, and its shingles only count for frequency.
    """
    spark = documents.sparkSession
    shared, bits = spark.sparkContext.broadcast(bitmap), len(bitmap) * 64

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch["_id"], batch["_text"]):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= _AT_ONCE:
                    yield ids, texts
                    ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rid = shared.value, TaskContext.get().partitionId() << 33
        for ids, texts in chunks(batches):
            words, ends = word_hashes(texts)
            keys = shingle_keys(words)
            begins = np.concatenate(([0], ends[:-1]))
            one, two = _slots(keys, bits)
            spot = np.flatnonzero((known[one >> np.uint64(6)] >> (one & np.uint64(63))) & (known[two >> np.uint64(6)] >> (two & np.uint64(63))) & np.uint64(1))
            doc = np.searchsorted(ends, spot, side="right")
            whole = spot + SHINGLE <= ends[doc]  # a shingle lies within one document
            spot, doc = spot[whole], doc[whole]
            rows = []
            for d, (a, b) in zip(*(lambda u, i, c: (u.tolist(), zip(i.tolist(), (i + c).tolist())))(*np.unique(doc, return_index=True, return_counts=True))):
                for first, last in _clusters(spot[a:b], gap):
                    place = spot[a + first : a + last]
                    low, high = max(begins[d], place[0] - MARGIN), min(ends[d], place[-1] + SHINGLE + MARGIN)
                    rows.append((rid, ids[d], (place - low).astype(np.int32), keys[place].view(np.int64), words[low:high].view(np.int64) if len(place) >= KEPT else None))
                    rid += 1
            yield pd.DataFrame(rows, columns=["rid", "doc_id", "places", "keys", "words"])

    narrow = documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    return narrow.mapInPandas(run, "rid bigint, doc_id bigint, places array<int>, keys array<bigint>, words array<bigint>")


def _prefixes(keyed: DataFrame, frequency: DataFrame) -> DataFrame:
    """``key, pid``: the prefix tokens of every passage, from ``pid, pos, key``."""
    placed = keyed.join(frequency, "key", "left").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "key", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [prefix_keys(np.asarray(k, np.int64), np.asarray(n, np.int64)) for k, n in zip(batch["keys"], batch["n"])]
            yield pd.DataFrame({"key": np.concatenate(found) if found else np.zeros(0, np.int64), "pid": np.repeat(batch["pid"].to_numpy(), [len(f) for f in found])})

    return placed.select("pid", F.col("s.key").alias("keys"), F.col("s.n").alias("n")).mapInPandas(run, "key bigint, pid string")


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """``doc_id, item_id`` of every document that holds a stretch of an item's passage."""
    spark = documents.sparkSession
    listed = kept(_passages(items, item_col, passage_col))
    passages = kept(listed.dropDuplicates(["pid"]).select("pid", F.col("words").alias("passage")))
    longest = passages.agg(F.max(F.size("passage"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_keys(np.asarray(p, np.int64).view(np.uint64)).view(np.int64) for p in batch["passage"]]
            sizes = [len(f) for f in found]
            yield pd.DataFrame({"pid": np.repeat(batch["pid"].to_numpy(), sizes), "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), "key": np.concatenate(found)})

    keyed = kept(passages.mapInPandas(keys_of, "pid string, pos int, key bigint"))
    held = kept(_held(documents, id_col, text_col, _bitmap(keyed.select("key").distinct()), reach(longest)))
    frequency = held.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    prefixes = kept(_prefixes(keyed, frequency))
    stretches = held.where("words is not null")
    tokens = stretches.select("rid", F.explode(F.array_distinct("keys")).alias("key"))
    pairs = kept(joined(tokens, prefixes, ["key"]).select("rid", "pid").distinct())

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [leaks(np.asarray(p, np.int64).view(np.uint64), at, k.view(np.uint64), w.view(np.uint64)) for p, at, k, w in zip(batch["passage"], batch["places"], batch["keys"], batch["words"])]
            yield batch.loc[np.array(found, bool), ["doc_id", "pid"]]

    together = joined(joined(stretches, pairs, ["rid"]), passages, ["pid"]).select("doc_id", "pid", "places", "keys", "words", "passage")
    found = together.mapInPandas(verify, "doc_id bigint, pid string").distinct()
    return joined(found, listed.select("pid", "item_id").distinct(), ["pid"]).select("doc_id", "item_id").distinct()
