"""Periodic runs of words: multi-scale minimizers seed them, short periods are scanned lag by lag.

A run is a stretch of words whose smallest period is q (words q apart are equal), which is long
enough (``least`` words and ``exponent`` periods) and which no neighbouring word extends with that
period.  Texts are worked on in slices: their words become one array of numbers, with a number of
its own after each text, so no run crosses from one text into the next.

Periods up to ``SHORT`` are found by comparing the array with itself at each lag.  Longer ones are
found scale by scale, low <= period <= high = 1.5 low: windows of ``2 low - high + 1`` neighbouring
``high``-grams give their minima, ties included.  Inside a run the minima of a window come again one
period further, because three periods hold both windows whole; and since a gram is no shorter than
the period, equal grams inside a run are at least one smallest period apart.  So two neighbouring
minimizers with equal grams lie exactly one period apart somewhere in every run.  Such a seed is extended
word by word in both directions; the comparison of words decides.  A gram is compared by a 64-bit
hash (of hashes of its halves): two different grams that collide could hide a seed, with a probability of
about the square of the slice's words over 2^64.

Scales end with a third of the longest text, arrays hold a slice of words, and seeds of a stretch that
has been extended are passed over, so time is about n log n for any text.

Defined results: a null text has no words; a repeated row gives a repeated result; further columns
are ignored, whatever their names; an empty table gives an empty one; a null id is kept.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import pick, slices, text_bytes

SLICE = 2 << 20     # text bytes worked on together
SHORT = 31          # periods up to here are scanned lag by lag

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MORE
    return x ^ (x >> np.uint64(27))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * _MIX + (right ^ (right >> np.uint64(32))) + np.uint64(1))


def _sliding(values: np.ndarray, width: int, pick_one) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick_one(values[:-step], values[step:])
        done += step
    return values


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose gram is the least of some window of ``width`` grams, ties included."""
    if width == 1:
        return np.arange(len(grams))
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


def _lag_stretches(words: np.ndarray, lag: int, need: int) -> np.ndarray:
    """(start, length, lag) of maximal stretches with at least ``need`` words equal to the one ``lag`` on."""
    same = np.flatnonzero(words[lag:] == words[:-lag])
    if len(same) < need:
        return np.empty((0, 3), np.int64)
    breaks = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate([[0], breaks + 1])]
    count = same[np.concatenate([breaks, [len(same) - 1]])] - first + 1
    long = count >= need
    return np.stack([first[long], count[long] + lag, np.full(int(long.sum()), lag)], axis=1)


def _equal_from(words: np.ndarray, i: int, j: int) -> int:
    """How many words are equal from i and from j > i on."""
    n, step, room = 0, 64, len(words) - j
    while n < room:
        size = min(step, room - n)
        differ = words[i + n:i + n + size] != words[j + n:j + n + size]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + size, step * 2
    return n


def _equal_before(words: np.ndarray, i: int, j: int) -> int:
    """How many words are equal before i and before j > i."""
    n, step = 0, 64
    while n < i:
        size = min(step, i - n)
        differ = (words[i - n - size:i - n] != words[j - n - size:j - n])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + size, step * 2
    return n


def _seeded(words: np.ndarray, places: np.ndarray, lags: np.ndarray, least: int, exponent: int) -> list:
    """Seeds extended; those that lie in a stretch already extended at their lag are passed over."""
    order = np.lexsort((places, lags))
    places, lags = places[order], lags[order]
    key = lags * (len(words) + 1) + places
    found, at = [], 0
    while at < len(key):
        i, lag = int(places[at]), int(lags[at])
        back, on = _equal_before(words, i, i + lag), _equal_from(words, i, i + lag)
        if back + on + lag >= max(least, exponent * lag):
            found.append((i - back, back + on + lag, lag))
        at = int(np.searchsorted(key, lag * (len(words) + 1) + i + max(on, 1)))
    return found


def find(words: np.ndarray, first: np.ndarray, least: int = 24, exponent: int = 3) -> np.ndarray:
    """(start, length, period) of all runs of an array of word numbers, by start, then period.

    Text t holds the words from ``first[t]`` to before ``first[t + 1] - 1``, where a number stands that
    occurs nowhere else.  ``exponent`` is 3 or more: the seeds need three periods.
    """
    if exponent < 3:
        raise ValueError("a run holds three periods or more")
    sizes = np.diff(first)
    longest = int(sizes.max(initial=1)) - 1
    found = [np.empty((0, 3), np.int64)]
    for lag in range(1, min(SHORT, longest // exponent) + 1):
        found.append(_lag_stretches(words, lag, max(least, exponent * lag) - lag))

    # Hashes of 1, 2, 4, ... words; texts too short for a scale leave the arrays.
    where = np.arange(len(words))
    hashes = _mixed(words.astype(np.uint64) * _MIX + np.uint64(1))
    size, low = 1, SHORT + 1
    while low <= longest // exponent:
        high = low + low // 2
        stay = np.repeat(sizes - 1 >= exponent * low, sizes)[where]
        where, hashes = where[stay], hashes[stay]
        while size * 2 <= high:
            tail = _mixed(where[-size:].astype(np.uint64) * _MORE + np.uint64(size))     # beyond the array
            hashes = np.concatenate([_joined(hashes[:-size], hashes[size:]), tail])
            size *= 2
        rest = high - size
        grams = _joined(hashes[:len(hashes) - rest], hashes[rest:])
        spots = _minimizers(grams, 2 * low - high + 1)
        ranked = grams[spots]
        order = np.argsort(ranked, kind="stable")
        spots, ranked = spots[order], ranked[order]
        apart = np.diff(spots)
        seed = (ranked[1:] == ranked[:-1]) & (apart >= low) & (apart <= high)
        if seed.any():
            found.append(np.array(_seeded(words, where[spots[:-1][seed]], apart[seed], least, exponent),
                                  np.int64).reshape(-1, 3))
        low = high + 1
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A stretch with a smaller period too is that period's run.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _worked(texts: list[bytes], least: int, exponent: int):
    """Per text: number of words, runs, and the text without what runs repeat."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [text.split() for text in texts]
    sizes = np.array([len(s) + 1 for s in split], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = np.empty(int(first[-1]), np.int64)
    for at, own in zip(first.tolist(), split):
        words[at:at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    words[first[1:] - 1] = len(number) + np.arange(len(texts))
    runs = find(words.astype(np.int32), first, least, exponent)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(step[:-1]) == 0
    text_of = np.searchsorted(first, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    for t, own in enumerate(split):
        mine = runs[cuts[t]:cuts[t + 1]]
        start = int(first[t])
        if len(mine):
            own = compress(own, keep[start:start + len(own)].tolist())
        yield int(sizes[t]) - 1, mine - [start, 0, 0], b" ".join(own)


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse(docs: DataFrame, text: str = "text", ident: str = "doc_id", least: int = 24,
             exponent: int = 3) -> DataFrame:
    """(id, n_words, runs, collapsed): each text's runs by start, then period, and the text without repeats.

    A word is left out if some run holds it after that run's first period; the words that stay are
    joined by one space.
    """
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sizes, spans, texts = zip(*_worked(text_bytes(batch.column("text")), least, exponent))
                rows = np.concatenate(spans)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)],
                                                  ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), flat).cast(kind),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    slim = pick(docs, id=ident, text=text).selectExpr("cast(id AS bigint) AS id", "cast(text AS string) AS text")
    return (slim.mapInArrow(work, f"id bigint, n_words bigint, runs {RUNS}, collapsed string")
            .withColumnRenamed("id", ident))


def strongest(runs):
    """Of an array of runs that with the greatest length over period, then smallest start, then period."""
    def order(x, y):
        mine, other = x.length * y.period, y.length * x.period
        return (F.when(mine > other, -1).when(mine < other, 1)
                .when(x.start < y.start, -1).when(x.start > y.start, 1)
                .when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0))

    return F.get(F.array_sort(runs, order), F.lit(0))
