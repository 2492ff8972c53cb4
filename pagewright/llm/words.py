"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes that are not ASCII white space, with A-Z lower-cased. Its hash is a polynomial over
random byte values, read off one running sum for all words of a block, then scrambled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from pagewright.llm.base import mix64

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[_LOWER]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_STEPS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one for each word in text order
    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    first: np.ndarray  # n + 1 offsets into the words, by document


def words(raw: np.ndarray, at: np.ndarray, table: np.ndarray = _BYTE, is_word: np.ndarray = _IS_WORD) -> Words:
    """The words of the documents that lie at offsets ``at`` of ``raw``."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64))
    inside = is_word[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _grown(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(table[raw] * power[:n], out=run[1:])
    value = (run[end] - run[start]) * inverse[start]
    return Words(mix64(value ^ (end - start).astype(np.uint64)), start, end, np.searchsorted(start, at))


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in text order, and their n + 1 offsets by document.

    A document of fewer words, but at least one, has one shingle: its whole sequence.
    """
    h, first = found.hash, found.first
    count = np.diff(first)
    out_count = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(out_count)])
    out = np.zeros(out_first[-1], np.uint64)
    if len(h) >= width:
        runs = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            runs += h[i : len(h) - width + 1 + i] * _STEPS[i % 5] * np.uint64(2 * (i // 5) + 1)
        document = np.repeat(np.arange(len(count)), count)
        whole = document[: len(runs)] == document[width - 1 :]
        long_docs = np.repeat(count >= width, out_count)
        out[long_docs] = mix64(runs[whole])
    for d in np.flatnonzero((count > 0) & (count < width)):
        value = np.uint64(count[d])
        for x in h[first[d] : first[d + 1]]:
            value = mix64(np.array([value], np.uint64) * _STEPS[0] + x)[0]
        out[out_first[d]] = value
    return out, out_first
