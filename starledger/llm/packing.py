"""Packing documents into sequences: bin completion with branch and bound.

Only the number of pieces of each length matters, and lengths end at the capacity.  So Spark
tokenises, cuts and counts; the counts, one row per length whatever the corpus, are solved once;
and Spark deals every piece to a place of the solution by its rank among the pieces of its length.

The solver takes the largest length left and enumerates the fillings of the rest of its sequence, of
any number of pieces, that no exchange of a piece for a longer one improves: least waste first, longest
pieces first.  Sets of reachable sums, one number's bits per length, lead the enumeration, so it
never enters a branch without a filling inside the waste that could still beat the incumbent, and it
goes on only as far as it is asked.  A filling is applied as often as the counts allow, then less often.
Incumbents come from best fit over the same counts.  The search stops when the incumbent equals the
lower bound, when every branch is done, or when ``work`` steps are spent.

Defined results: a null text counts as empty and packs as its end token; a null id is kept; repeated
rows are packed as often as they occur; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import partitions, pick, slices
from starledger.session import cut_lineage

SLICE = 2 << 20
WORK = 300_000       # lengths looked at and fillings tried by the solver, all in all
BETWEEN = 32         # nodes from one best-fit completion to the next


# ---------------------------------------------------------------- tokens and pieces

#: White space of the pattern's ``\\s``: the code points with the White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Tokens:
    """The byte-level BPE of a rank file, which holds the merged ids of the JSON vocabulary beside it.

    The JSON's added tokens are matched in any text, as ``tokenizers`` does.  White space of two and more
    characters is cut out before the pattern sees the text, because its look-ahead goes through such a run
    step by step and gives up on very long ones: all of it but the last character, which may belong
    to what follows, is one pre-token.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as vocabulary:
            added = json.load(vocabulary)["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("an added token of the vocabulary does not match its plain text only")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.run = re.compile(f"[{WHITE}]{{2,}}")
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        self.plain, self.piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.added:
                ids.append(self.added[part])
                continue
            at = 0
            for run in self.run.finditer(part):
                start, stop = run.span()
                if stop < len(part):
                    stop -= 1
                if start > at:
                    ids += self.plain(part[at:start])
                ids += self.piece(part[start:stop].encode())
                at = stop
            if at < len(part):
                ids += self.plain(part[at:])
        return ids


@cache
def _encoding(path: str) -> Tokens:
    return Tokens(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, crc) of every document."""
    def encode(batches):
        encoding = _encoding(path)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                out = []
                for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([*encoding.encode(text or ""), end_id], "<u4")
                    out += [(ident, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                            for k, (s, n) in enumerate(cut(len(ids), capacity))]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())]
                    + [pa.array(c, pa.int64()) for c in columns[2:]], ["id", "piece", "start", "length", "crc"])

    return docs.mapInArrow(encode, "id bigint, piece int, start bigint, length bigint, crc bigint")


# ---------------------------------------------------------------- the solver

def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: by volume, by pieces that cannot share one, by pieces a sequence holds.

    The second is the L2 bound; the third rounds lengths to parts of the capacity (a dual feasible
    function): of pieces longer than a (k + 1)-th of it, a sequence holds k.
    """
    lengths = np.arange(capacity + 1)
    volume = np.concatenate([[0], np.cumsum(counts * lengths)])          # below a length
    number = np.concatenate([[0], np.cumsum(counts)])
    best = -(-int(volume[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        alone = int(number[-1] - number[capacity - k + 1])               # longer than capacity - k
        half = int(number[capacity - k + 1] - number[capacity // 2 + 1])
        half_volume = int(volume[capacity - k + 1] - volume[capacity // 2 + 1])
        small = int(volume[capacity // 2 + 1] - volume[k])
        best = max(best, alone + half + max(0, -(-(small - (half * capacity - half_volume)) // capacity)))
    for k in range(1, min(capacity, 64)):
        parts, exact = np.divmod((k + 1) * lengths, capacity)
        shares = np.where(exact == 0, k * lengths, parts * capacity)     # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * shares).sum()) // (k * capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: equal sequences are handled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                pattern, number = open_[room].pop()
                used = min(number, left)
                if used < number:
                    open_[room].append((pattern, number - used))
                if not open_[room]:
                    rooms[room] = False
                pattern += (length,)
            else:
                each = min(capacity // length, left)
                used, pattern, room = left // each, (length,) * each, capacity
            after = capacity - sum(pattern)
            open_.setdefault(after, []).append((pattern, used))
            rooms[after] = after > 0
            left -= used * (1 if len(fits) else each)
    return [entry for group in open_.values() for entry in group]


def _reachable(lengths: list[int], numbers: list[int], room: int) -> list[int]:
    """For every place of the list the sums, as bits, that the lengths from there on make."""
    full = (1 << (room + 1)) - 1
    sums = [1]
    for length, number in zip(reversed(lengths), reversed(numbers)):
        here, left, step = sums[-1], number, 1
        while left:                                  # 1, 2, 4, ... pieces, and what is over
            step = min(step, left)
            here |= (here << length * step) & full
            left -= step
            step *= 2
        sums.append(here)
    return sums[::-1]


def fillings(counts: np.ndarray, room: int, most_waste: int):
    """Fillings of ``room`` that no exchange improves, least waste first, longest pieces first.

    They are made one by one, as asked for; ``counts`` may change in between.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[:room + 1])[::-1] if x]
    numbers = [int(counts[x]) for x in lengths]
    if not lengths:
        if room <= most_waste:
            yield ()
        return
    if lengths[0] == room:
        yield (room,)                   # one piece that fits exactly dominates the rest
        return
    sums = _reachable(lengths, numbers, room)

    def exactly(at: int, left: int):
        if not left:
            yield ()
            return
        while at < len(lengths):
            x = lengths[at]
            for k in range(min(numbers[at], left // x), 0, -1):
                if sums[at + 1] >> (left - k * x) & 1:
                    for rest in exactly(at + 1, left - k * x):
                        yield (x,) * k + rest
            at += 1
            if not sums[at] >> left & 1:
                return

    for waste in range(min(most_waste, room) + 1):
        if not sums[0] >> (room - waste) & 1:
            continue
        for chosen in exactly(0, room - waste):
            free = [x for x, n in zip(lengths, numbers) if chosen.count(x) < n] if waste else []
            if any(x <= waste or any(y < x <= y + waste for y in set(chosen)) for x in free):
                continue                # a piece could be added, or exchanged for a longer one
            yield chosen


def solve(counts: np.ndarray, capacity: int, work: int = WORK) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, as few sequences as found."""
    def used(plan):
        return sum(n for _, n in plan)

    total = int((counts * np.arange(capacity + 1)).sum())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    counts = counts.copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    waste = spent = nodes = 0

    def apply(pattern, times, sign):
        for x in pattern:
            counts[x] -= sign * times

    def spare():
        """Waste that a better plan may still add."""
        return (used(best) - 1) * capacity - total - waste

    def options():
        """The fillings around the largest piece left, each as often as it goes, then less often."""
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        around = fillings(counts, capacity - largest, spare())
        first = next(around, None)       # made while this piece is taken out
        counts[largest] += 1
        own = {int(x): int(counts[x]) for x in np.flatnonzero(counts)}
        while first is not None:
            pattern = (largest, *first)
            for times in range(min(own[x] // pattern.count(x) for x in set(pattern)), 0, -1):
                yield pattern, times
            first = next(around, None)

    stack = [options()] if used(best) > bound and counts.any() else []
    while stack and spent < work:
        if len(plan) == len(stack):         # back from below: take the last choice of this level off
            pattern, times = plan.pop()
            apply(pattern, times, -1)
            waste -= times * (capacity - sum(pattern))
        choice = next(stack[-1], None)
        spent += 1
        if choice is None:
            stack.pop()
            continue
        pattern, times = choice
        lost = times * (capacity - sum(pattern))
        if lost > spare():
            continue                        # this branch cannot save a sequence any more
        plan.append(choice)
        apply(pattern, times, 1)
        waste += lost
        if counts.any():
            nodes += 1
            spent += int(np.count_nonzero(counts))
            if nodes % BETWEEN == 0:
                rest = best_fit(counts, capacity)
                if used(plan) + used(rest) < used(best):
                    best = plan + rest
            stack.append(options())
        elif used(plan) < used(best):
            best = list(plan)
        if used(best) <= bound:
            break
    return best


def _places(plan, counts: np.ndarray) -> np.ndarray:
    """Rows (first piece, first sequence, offset): where the pieces in order of length begin to go."""
    before = np.concatenate([[0], np.cumsum(counts)])    # pieces shorter than a length
    taken = np.zeros(len(counts), np.int64)
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((int(before[length] + taken[length]), base, offset))
            taken[length] += times
            offset += length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


# ---------------------------------------------------------------- the operator

def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
         ident: str = "doc_id", work: int = WORK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = pick(docs, id=ident, text=text).select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    n = partitions(docs.sparkSession)

    def numbered(batches):
        pid, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pid] * k, pa.int32()), pa.array(np.arange(done, done + k))],
                [*batch.schema.names, "pid", "at"])
            done += k

    order = ["length", "id", "piece", "crc"]
    # Written first: sampling the range sort's split points would tokenise everything once more.
    tokenised = cut_lineage(pieces(slim, vocabulary, capacity, end_id), "tokens")
    ranked = cut_lineage(
        tokenised.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .mapInArrow(numbered, "id bigint, piece int, start bigint, length bigint, crc bigint, pid int, at bigint"),
        "pieces")
    # At most one row per length, and one per range.
    counts = np.zeros(capacity + 1, np.int64)
    for length, number in ranked.groupBy("length").count().collect():
        counts[length] = number
    sizes = dict(map(tuple, ranked.groupBy("pid").count().collect()))
    before, run = {}, 0
    for pid in sorted(sizes):
        before[pid] = run
        run += sizes[pid]
    places = _places(solve(counts, capacity, work), counts)

    def dealt(batches):
        for batch in batches:
            pid = batch.column("pid").to_numpy()
            rank = batch.column("at").to_numpy() + np.array([before[p] for p in pid.tolist()], np.int64)
            row = np.searchsorted(places[:, 0], rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(places[row, 1] + rank - places[row, 0]), pa.array(places[row, 2])],
                [ident, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(dealt, f"`{ident}` bigint, piece int, start bigint, length bigint, "
                                    "ids_crc32 bigint, sequence_id bigint, offset bigint")
