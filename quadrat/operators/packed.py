"""Several numbers packed in one text field: one row per value, with its position.

The kernel never looks at a row by itself.  It scans the byte buffer of an Arrow string
column with boolean masks: quote parity, names, decimal commas and delimiters are masks over
all bytes of a slice of the batch (of ``SLICE`` bytes, or one text if that is longer); tokens are the
runs that remain, and their places follow from running counts of delimiters.  The tokens' parents give
the offsets of a list array, a list of (place, value) per text, which is flattened with the ordinals of
its parents.

Cases and their result
----------------------
* NULL, empty text, empty list: no row.
* ``;`` ``|`` ``/`` and a comma that isn't a decimal mark open a place each, so that two of
  them in a row leave an empty place; blanks (also no-break and other wide ones, tabs, line
  ends) in a row count as one delimiter.  A delimiter after the last value opens no place.
* A comma is a decimal mark between two digits if the same quoted segment (the whole text, if
  nothing is quoted) has no decimal point, and the digits hold only this comma.
* Names before ``(``, ``:`` or ``=`` (``array``, ``np.float64``, ``band_1``) are no values.
* A token that is no number (``nan``, ``None``, ``NA``, ``-``) keeps its place, without a row.
* Values beyond the range of a 64-bit integer of millionths give no row.
* Repeated rows count each; further columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are scanned at once; the masks take some hundred times as much memory.
SLICE = 1 << 20
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _mask(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_DIGIT = _mask("0123456789")
_ALPHA = _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_VALUE = _DIGIT | _ALPHA | _mask(".+-")
_BLANK = _mask(" \t\n\r\v\f")
_BLANK[128:] = True  # no-break and wide blanks are the only characters beyond ASCII that separate numbers
_HARD = _mask(";|")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _per(row: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    """Whether a row has any flag."""
    return np.bincount(row[flags], minlength=n) > 0


def scan_packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent ordinal, position (from 1) and value in millionths of every number in ``texts``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ordinal = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    empty = np.zeros(0, np.int64)
    if not len(ordinal):
        return empty, empty, empty
    closed = pc.binary_join_element_wise(texts.take(pa.array(ordinal)).cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("\x00", "")))
    closed = closed.combine_chunks() if isinstance(closed, pa.ChunkedArray) else closed
    n = len(closed)
    bounds = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + n + 1]
    b = np.frombuffer(closed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    row = np.repeat(np.arange(n), np.diff(bounds))
    before = np.concatenate(([0], b[:-1]))
    after = np.concatenate((b[1:], [0]))

    # Quotes.  A field written by a CSV writer has an outer pair, and inner ones doubled.
    double = b == 34
    first, last = bounds[:-1], np.maximum(bounds[1:] - 2, bounds[:-1])
    pairs = double & (before == 34)
    outer = (b[first] == 34) & (b[last] == 34) & (last > first) & (np.bincount(row[pairs], minlength=n) > 1)
    kept = double.copy()
    kept[first[outer]] = kept[last[outer]] = False
    begin, end = _runs(kept)
    within = np.zeros(len(b), np.int64)
    within[kept] = np.concatenate([np.arange(e - s) for s, e in zip(begin, end)]) if len(begin) else 0
    kept &= ~(outer[row] & (within % 2 == 1))
    segment = np.cumsum(kept | (b == 39) | (b == 0))
    quoted = (np.cumsum(kept) - np.cumsum(kept)[first][row] + kept[first][row]) % 2 == 1

    # Names: a run of value characters that begins with a letter, before ( or : or =.
    value = _VALUE[b]
    begin, end = _runs(value)
    following = np.minimum(end, len(b) - 1)
    solid = np.where(_BLANK[b], len(b), np.arange(len(b)))
    solid = np.minimum.accumulate(solid[::-1])[::-1]
    beyond = b[np.minimum(solid[following], len(b) - 1)]
    labels = (beyond == 58) | (beyond == 61)
    named = labels | (_ALPHA[b[begin]] & (b[following] == 40))
    skip = np.zeros(len(b) + 1, np.int64)
    np.add.at(skip, begin[named], 1)
    np.add.at(skip, end[named], -1)
    skip = np.cumsum(skip[:-1]) > 0
    label_at = np.zeros(len(b), np.int64)
    label_at[begin[labels]] = 1

    # Decimal commas.
    point = (b == 46) & _DIGIT[before] & _DIGIT[after] & ~skip
    between = (b == 44) & _DIGIT[before] & _DIGIT[after]
    chain_begin, chain_end = _runs(_DIGIT[b] | between)
    commas = np.concatenate(([0], np.cumsum(between)))
    lone = np.repeat(commas[chain_end] - commas[chain_begin] == 1, chain_end - chain_begin)
    alone = np.zeros(len(b), bool)
    alone[_DIGIT[b] | between] = lone
    pointed = np.bincount(segment[point], minlength=segment[-1] + 1) > 0
    decimal = between & ~pointed[segment] & (alone | quoted)

    # Tokens and their places.
    hard = _HARD[b] | ((b == 44) & ~decimal) | ((b == 47) & ~_ALPHA[before] & ~_ALPHA[after])
    token = (value & ~skip) | decimal
    begin, end = _runs(token)
    if not len(begin):
        return empty, empty, empty
    seen = np.cumsum(hard)
    base = np.concatenate(([0], seen[bounds[1:-1] - 1]))  # delimiters before each row
    parent = row[begin]
    head = np.concatenate(([True], parent[1:] != parent[:-1]))
    passed = seen[begin]
    step = np.where(head, 1 + passed - base[parent], np.maximum(1, passed - np.concatenate(([0], passed[:-1]))))
    place = np.cumsum(step)
    starts = np.flatnonzero(head)
    place = place - np.repeat(place[starts] - step[starts], np.diff(np.concatenate((starts, [len(begin)]))))
    labelled = np.cumsum(label_at)
    own = labelled[begin] - np.concatenate(([0], labelled[bounds[1:-1] - 1]))[parent]
    only_labels = (np.bincount(row[label_at > 0], minlength=n) > 0) & ~_per(row, hard, n)
    place = np.where(only_labels[parent] & (own > 0), own, place)

    plain = np.where(decimal, np.uint8(46), b)[token]
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(plain.tobytes())])
    good = pc.match_substring_regex(words, _NUMBER).to_numpy(zero_copy_only=False)
    number = pc.cast(words.filter(pa.array(good)), pa.float64()).to_numpy(zero_copy_only=False)
    micro = np.rint(number * 1e6)
    fits = np.abs(micro) < 9.2e18
    return ordinal[parent[good][fits]], place[good][fits], micro[fits].astype(np.int64)


def packed_lists(texts: pa.Array) -> pa.ListArray:
    """The numbers of each text as a list of ``struct<pos, value_micro>``; an empty one if there is none."""
    parent, place, micro = scan_packed(texts)
    offsets = np.searchsorted(parent, np.arange(len(texts) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(micro)], ["pos", "value_micro"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of consecutive parts of an array with about ``SLICE`` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    part = size // SLICE
    begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(texts) else []
    yield from zip(begins, np.diff(np.append(begins, len(texts))))


def explode_packed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row per packed number of ``fields``: ``row_id, field_name, pos, value_micro``.

    A narrow map over Arrow batches: no shuffle, and only ``id_col`` and ``fields`` are read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("field_name", pa.string()), ("pos", pa.int32()), ("value_micro", pa.int64())])
        for batch in batches:
            for k, field in enumerate(fields, 1):
                texts = batch.column(k)
                for begin, size in _slices(texts):
                    lists = packed_lists(texts.slice(begin, size))
                    values, parents = lists.flatten(), pc.list_parent_indices(lists)
                    if len(values):
                        ids = batch.column(0).slice(begin, size).take(parents)
                        name = pa.DictionaryArray.from_arrays(np.zeros(len(values), np.int8), [field]).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([ids, name, values.field("pos"), values.field("value_micro")], schema=schema)

    narrow = df.select(F.col(id_col).cast("bigint"), *[F.col(f).cast("string") for f in fields])
    return narrow.mapInArrow(rows, "row_id bigint, field_name string, pos int, value_micro bigint")
