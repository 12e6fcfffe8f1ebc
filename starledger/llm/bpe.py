"""Byte-level BPE over rank files, encoded with a hierarchical-bitmap rank queue, and decoded.

A pre-token is a linked list of byte positions.  The queue keeps one bucket of positions per merge
rank and a bitmap of the ranks whose bucket is not empty; two more bitmaps mark the non-empty words
of the one below, so three find-first-set steps give the smallest rank, however long the pre-token
is.  Entries that a later merge made stale stay in their bucket and are skipped when they surface.
Within a bucket the leftmost position comes first.  Every merge costs a constant number of steps.

Defined results: a null text counts as empty, with no ids; repeated rows are encoded each; further
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from starledger.llm.common import pick, slices

SLICE = 1 << 20
KEPT = 500_000       # pre-tokens remembered per generation and worker
LONGEST_KEPT = 64    # characters of a pre-token that is worth remembering
RUN = 1 << 17        # ids decoded at a time


class Codec:
    """Ranks of a vocabulary with the queue's bitmaps (all zero between calls); one per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        top_rank = max(ranks.values())
        self.split = regex.compile(pattern).findall
        self.words = [0] * ((top_rank >> 6) + 1)       # a bit per rank
        self.groups = [0] * ((top_rank >> 12) + 1)     # a bit per word; the third level is one number
        self.longest = max(map(len, ranks))
        self.pairs = [ranks.get(bytes((x, y))) for x in range(256) for y in range(256)]
        known = sorted((rank, token) for token, rank in ranks.items())
        self.flat = np.frombuffer(b"".join(token for _, token in known), np.uint8)
        self.width = np.zeros(top_rank + 1, np.int64)          # bytes of each id; 0 where there is none
        self.width[[rank for rank, _ in known]] = [len(token) for _, token in known]
        self.place = np.cumsum(self.width) - self.width        # where they begin in ``flat``
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.  The queue is written out here: a call per step would double the time."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, longest, words, groups = len(piece), ranks.get, self.longest, self.words, self.groups
        buckets: dict[int, list[int]] = {}
        top = 0
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        rank_at = [-1] * (n + 1)
        pairs = self.pairs
        fresh = [(i, pairs[x << 8 | y]) for i, (x, y) in enumerate(zip(piece, piece[1:]))]
        while True:
            for i, rank in fresh:                  # enqueue
                if rank is None:
                    continue
                rank_at[i] = rank
                if rank in buckets:
                    heappush(buckets[rank], i)
                    continue
                buckets[rank] = [i]
                word = rank >> 6
                words[word] |= 1 << (rank & 63)
                group = word >> 6
                groups[group] |= 1 << (word & 63)
                top |= 1 << group
            if not top:
                break
            group = (top & -top).bit_length() - 1  # find-first-set, three levels down
            bits = groups[group]
            word = (group << 6) + (bits & -bits).bit_length() - 1
            bits = words[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    groups[group] = bits = groups[group] & ~(1 << (word & 63))
                    if not bits:
                        top &= ~(1 << group)
            fresh = []
            if rank_at[i] != rank:
                continue                           # an entry that an earlier merge made stale
            j = after[i]
            k = after[j]
            rank_at[i] = rank_at[j] = -1
            after[i] = k
            before[k] = i
            if k < n:
                end = after[k]
                if end - i <= longest:
                    fresh.append((i, get(piece[i:end])))
            p = before[i]
            if p >= 0:
                rank_at[p] = -1
                if k - p <= longest:
                    fresh.append((p, get(piece[p:k])))
        ids, i = [], 0
        while i < n:
            j = after[i]
            ids.append(ranks[piece[i:j]])
            i = j
        return ids

    def _packed(self, piece: str) -> bytes:
        """Little-endian ids of a pre-token, remembered over two generations."""
        found = self.old.get(piece)
        if found is None:
            found = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        get = self.young.get
        parts = [get(piece) or self._packed(piece) for piece in self.split(text)]
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered in runs of bounded size."""
        return b"".join(self._gathered(ids[at:at + RUN]) for at in range(0, len(ids), RUN))

    def _gathered(self, ids: np.ndarray) -> bytes:
        width = self.width[ids]
        if not width.all():
            raise ValueError("an id that the vocabulary does not have")
        ends = np.cumsum(width)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.place[ids] - (ends - width), width)].tobytes()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    def run(batches):
        tool = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids = [np.frombuffer(tool.encode(t or ""), "<u4") for t in batch.column("text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"])

    slim = pick(docs, id=ident, text=text).selectExpr("cast(id AS bigint) AS id", "cast(text AS string) AS text")
    return slim.mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", ident)


def decode(encoded: DataFrame, path: str, pattern: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, ids, bytes): the bytes that the ids stand for; null ids count as none."""
    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            out = [tool.decode(x.values.to_numpy()) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(out, pa.binary())],
                                             ["id", "ids", "bytes"])

    slim = pick(encoded, id=ident, ids=ids).selectExpr("cast(id AS bigint) AS id", "cast(ids AS array<int>) AS ids")
    return slim.mapInArrow(run, "id bigint, ids array<int>, bytes binary").withColumnRenamed("id", ident)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded in one pass."""
    def run(batches):
        tool = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                packed = [tool.encode(t or "") for t in batch.column("text").to_pylist()]
                ids = np.frombuffer(b"".join(packed), "<u4")      # decoded together: short texts are many
                n = [len(p) // 4 for p in packed]
                whole_text = memoryview(tool.decode(ids))
                cuts = np.concatenate([[0], np.cumsum(tool.width[ids])])[np.cumsum([0, *n])]
                ids_sha = [hashlib.sha256(p).hexdigest() for p in packed]
                text_sha = [hashlib.sha256(whole_text[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = pick(docs, id=ident, text=text).selectExpr("cast(id AS bigint) AS id", "cast(text AS string) AS text")
    return (slim.mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", ident))
