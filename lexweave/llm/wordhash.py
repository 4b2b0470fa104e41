"""Hashes of all words of a batch of texts, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII capitals become small; ASCII blanks part words.
BLANKS = np.array([0 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: The same, but all ASCII other than letters and digits parts words.
PUNCTUATION = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.array([0, *range(2, 257)], np.uint64)
_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes after ``kind``, 0 between words; beginnings of words; their texts) in pieces that cut no word."""
    at, stop = int(ends[0]), int(ends[-1])
    while at < stop:
        to = min(stop, at + _PIECE)
        while to < stop:  # go on to a blank or the end of a text
            part = kind[data[to:to + 4096]]
            blank = np.flatnonzero(part == 0)
            bound = int(ends[np.searchsorted(ends, to)])
            cut = to + int(blank[0]) if len(blank) else to + len(part)
            if min(cut, bound) < to + len(part) or to + len(part) >= stop:
                to = min(cut, bound)
                break
            to += len(part)
        x = kind[data[at:to]]
        inside = x != 0
        fresh = np.ones(len(x) + 1, bool)
        fresh[1:] = ~np.r_[inside]
        mark = np.unique(ends[(ends >= at) & (ends < to)]) - at
        fresh[mark] = True
        begin = np.flatnonzero(inside & fresh[:-1])
        if len(begin):
            yield x, begin, np.searchsorted(ends, begin + at, "right") - 1
        at = to


def hashes(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that start at ``begin``."""
    size = np.diff(np.r_[begin, len(x)])
    place = np.arange(begin[0], len(x), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    value = _VALUE[x[begin[0]:]]
    value *= np.cumprod(np.full(int(size.max()), _BASE))[place]
    return mix(np.add.reduceat(value, begin - begin[0]))


def beginnings(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first eight bytes of each word as a number, zeros after its end; its length up to 9)."""
    padded = np.r_[x, np.zeros(9, np.uint8)]
    first = np.ndarray(len(x) + 1, "<u8", padded, 0, (1,))[begin]
    blanks = np.zeros((len(begin), 9), bool)
    for k in range(9):
        blanks[:, k] = padded[begin + k] == 0
    length = np.where(blanks.any(axis=1), blanks.argmax(axis=1), 9)
    length = np.minimum(length, np.diff(np.r_[begin, len(x) + 9]))  # where a text ends, the next word may follow at once
    keep = np.minimum(length, 8).astype(np.uint64)
    return first & np.where(keep == 8, ~np.uint64(0), (np.uint64(1) << (keep * np.uint64(8) % np.uint64(64))) - np.uint64(1)), length


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of a batch, in order."""
    parts = [(hashes(x, begin), text) for x, begin, text in pieces(data, ends, kind)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
