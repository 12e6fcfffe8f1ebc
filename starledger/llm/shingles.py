"""Word shingles as 64-bit numbers, computed over whole Arrow buffers at once.

A word's number is a polynomial over its bytes with random coefficients modulo 2^64, taken from
prefix sums, so there is no loop over words or documents' characters.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20     # bytes hashed at a time: bounds the 8-byte work arrays
_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_words(raw: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of each word of ``raw``; ``breaks`` are document starts inside it."""
    low = _LOWER[raw] if fold else raw
    word = _IS_WORD[raw]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    opens[inner] = word[inner]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    closes = np.flatnonzero(np.append(word[:-1] & (~word[1:] | opens[1:]), word[-1])) + 1
    size = 1 << max(int(len(raw) - 1).bit_length(), 12)
    power, inverse = _tables(size) if size <= CHUNK else (_powers(_BASE, size), _powers(_INVERSE, size))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:len(raw)], out=total[1:])
    numbers = (total[closes] - total[starts]) * inverse[starts]
    return starts, mix(numbers + (closes - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(array: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of a text column in order, and the first word's place per row (n + 1).

    ``fold``: capital letters A-Z count as small ones.
    """
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    buffers = array.buffers()
    n = len(array)
    ends = np.frombuffer(buffers[1], dtype=kind)[array.offset:array.offset + n + 1].astype(np.int64)
    if not n or ends[-1] == ends[0]:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    starts, numbers, at = [], [], 0
    while at < len(data):
        stop = min(at + CHUNK, len(data))
        if stop < len(data):                       # cut where no word is cut
            gap = np.flatnonzero(~_IS_WORD[data[at:stop]])
            edge = ends[(ends > at) & (ends <= stop)]
            stop = max(at + int(gap[-1]) + 1 if len(gap) else 0, int(edge[-1]) if len(edge) else 0)
            if stop <= at:                         # one word longer than a chunk
                later = np.flatnonzero(~_IS_WORD[data[at:]])
                behind = ends[ends > at]
                stop = min(at + int(later[0]) if len(later) else len(data), int(behind[0]))
        inside = ends[(ends > at) & (ends < stop)] - at
        s, h = _chunk_words(data[at:stop], inside, fold)
        starts.append(s + at)
        numbers.append(h)
        at = stop
    starts = np.concatenate(starts)
    return np.concatenate(numbers), np.searchsorted(starts, ends)


_STEP = [np.uint64(x) for x in (_RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]


def windows(numbers: np.ndarray, n_words: int) -> np.ndarray:
    """A number for each run of ``n_words`` words, across row ends too."""
    m = len(numbers) - n_words + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    rolled = numbers[:m] * _STEP[0]
    for k in range(1, n_words):
        rolled = rolled + numbers[k:m + k] * _STEP[k]
    return mix(rolled)


def sets(array: pa.Array, n_words: int) -> list[np.ndarray]:
    """Per row the sorted distinct shingles of ``n_words`` words.

    A row with fewer words has the whole sequence as its only shingle; one without words has none.
    """
    numbers, first = words(array)
    rolled = windows(numbers, n_words)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n_words:
            out.append(np.unique(rolled[a:b - n_words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64) * _STEP[-1]
            for k in range(b - a):
                short = short + numbers[a + k:a + k + 1] * _STEP[k]
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out
