"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from kelvingrid.llm.common import mix64, spans_of

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _WORD_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return np.r_[one, np.cumprod(np.full(n, _BASE))], np.r_[one, np.cumprod(np.full(n, inverse))]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z in lower case, separated by blanks) and the row it belongs to."""
    blank = _BLANK[data]
    lengths = np.diff(offsets)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]]))
    ends = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True])) + 1
    room = 1 << max(21, int(len(data)).bit_length())
    powers, inverses = _powers(room)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[_LOWER[data]] * powers[: len(data)])]
    words = (sums[ends] - sums[starts]) * inverses[starts]
    del lengths
    return mix64(words + (ends - starts).astype(np.uint64) * _WORD_BASE), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending within the row, and the offsets of the rows.

    A row with fewer than n words has its whole sequence as its one shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    parts, counts = [], np.zeros(rows, np.int64)
    for lo, hi in spans_of(offsets):
        words, owner = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(words):
            continue
        held = np.bincount(owner, minlength=hi - lo)
        first = np.r_[0, np.cumsum(held)][:-1]
        padded = np.r_[words, np.zeros(n, np.uint64)]
        whole, left = np.zeros(len(words), np.uint64), held[owner] - (np.arange(len(words)) - first[owner])
        for k in range(n):  # words past the end of a short row count as nothing
            whole += np.where(left > k, padded[k : k + len(words)], np.uint64(0)) * np.uint64(pow(int(_WORD_BASE), k + 1, 1 << 64))
        short = held[owner] < n
        whole += np.where(short, held[owner], 0).astype(np.uint64) * _BASE
        keep = np.where(short, left == held[owner], left >= n)
        hashes, owner = mix64(whole[keep]), owner[keep]
        bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=hi - lo))]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            hashes[a:b].sort()
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        parts.append(hashes[new])
        counts[lo:hi] = np.bincount(owner[new], minlength=hi - lo)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(counts)]
