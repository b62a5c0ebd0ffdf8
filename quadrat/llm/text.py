"""Texts as plain words."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

#: Rest of a tag: up to 300 characters of any kind, else attributes of any length (so that a stray ``<`` takes no long text away).
_REST = r"""(?:[^<>]{0,300}>|(?>[\w:-]*(?:\s+[\w:.@-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*+)\s*/?>)"""
_TAG = re.compile(r"<!--[^<>]*-->|</?[a-zA-Z!]" + _REST)
#: A hyphen between letters, also at the end of a line whose successor may be quoted.
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[ \t]*(?:>[ \t]*)*)?(?=[^\W\d_])")
_WORD = re.compile(r"[a-z0-9]+")
_SPACES = dict.fromkeys(map(ord, "–—―‘’“”„…·•«»¡¿′″´`~^"), " ") | dict.fromkeys(map(ord, "­​‌‍﻿"), "")


def fold(text: str) -> str:
    """``text`` in lower case without markup, hyphenation, accents and other than ASCII letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_SPACES))
        if not text.isascii():
            text = text.encode("ascii", "ignore").decode("ascii")
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for NULL and blank texts."""
    return _WORD.findall(fold(text)) if text else []


_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20


def _hashes_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of every word in a stretch of folded bytes that cuts no word."""
    inside = _IN_WORD[b]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _FACTOR, np.uint64))
        total = np.add.reduceat((b[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)
        total = (total ^ (total >> np.uint64(32))) * _MIX
        return begin, total ^ (total >> np.uint64(29))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts in order, and where each text ends among them.

    The words are those of :func:`words`; they are found by masks over the bytes of all folded texts.
    """
    folded = [fold(t) if t else "" for t in texts]
    b = np.frombuffer("\n".join(folded).encode("ascii"), np.uint8)
    begins, hashes, at = [], [], 0
    while at < len(b):
        end = min(len(b), at + _CHUNK)
        while end < len(b) and _IN_WORD[b[end - 1]] and _IN_WORD[b[end]]:  # cut no word
            end += 1
        begin, found = _hashes_of(b[at:end])
        begins.append(begin + at)
        hashes.append(found)
        at = end
    ends = np.cumsum([len(f) + 1 for f in folded]) if folded else np.zeros(0, np.int64)
    if not begins:
        return np.zeros(0, np.uint64), np.zeros(len(folded), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), ends)


_BLOCK_TAG = re.compile(r"</?(?:p|li|ul|ol|h[1-6]|div|br|tr|td|th|table|pre|blockquote|body|html|title)\b" + _REST, re.IGNORECASE)
_END = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n|\n(?=\s*(?:[-*#|\[=]|\d+[.)]))")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of ``text``.

    A sentence ends at ``.``, ``!``, ``?`` or ``:`` before a blank, at an empty line, at a block
    tag, and before a list item or heading; fewer than three words are none.
    """
    if not text:
        return []
    if "<" in text:
        text = _BLOCK_TAG.sub("\n\n", text)
    found = (_WORD.findall(part) for part in _END.split(fold(text)))
    return [s for s in found if len(s) >= 3]
