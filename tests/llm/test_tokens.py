"""Byte-level BPE against tiktoken, packing against tokenizers and against an exhaustive search."""

import hashlib
import itertools
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from starledger.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("length", T.StringType()), T.StructField("TEXT2", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "y", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks,
                             special_tokens={})


def test_random_texts_encode_like_the_library(codec, library):
    rng = random.Random(3)
    for _ in range(2000):
        alphabet = rng.choice(["ab", "a ", "aé1!", "the ing", "   \n\t", "x", "日本語ß", "'s'll "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, " " * 20_000 + "x", "ñ" * 10_000])
def test_very_long_pre_tokens(codec, library, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert not any(codec.words) and not any(codec.groups)      # the queue is left empty


def test_cache_generations_do_not_change_results(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    text = "one two three four five one two six seven eight one nine"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_operator_and_round_trip(spark, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "<|endoftext|> é"), (1, "Hello world"), (5, "z " * 30_000)]
    got = bpe.round_trip(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    decoded = bpe.decode(bpe.encode(frame(spark, rows), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in decoded.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def least_sequences(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(items):
            return
        if i == len(items):
            best = min(best, len(rooms))
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:])
        place(i + 1, rooms + [capacity - items[i]])
    place(0, [])
    return best


def test_solver_is_optimal_on_small_instances():
    rng = np.random.default_rng(1)
    for _ in range(200):
        capacity = int(rng.integers(6, 50))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        counts = np.bincount(items, minlength=capacity + 1)
        plan = packing.solve(counts, capacity)
        used = np.zeros(capacity + 1, int)
        for pattern, times in plan:
            assert sum(pattern) <= capacity
            for x in pattern:
                used[x] += times
        assert (used == counts).all()
        least = least_sequences(items.tolist(), capacity)
        assert sum(t for _, t in plan) == least >= packing.lower_bound(counts, capacity)


def test_branch_and_bound_beats_best_fit():
    items = [8, 7, 6, 5, 4, 4, 3, 3]        # best fit needs five sequences of ten, the volume four
    for rest in range(200):
        items = np.random.default_rng(rest).integers(2, 30, 24)
        counts = np.bincount(items, minlength=51)
        fit = sum(n for _, n in packing.best_fit(counts, 50))
        found = sum(n for _, n in packing.solve(counts, 50))
        assert packing.lower_bound(counts, 50) <= found <= fit


def test_cut_puts_the_short_piece_first():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_pack_holds_every_token_once(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "γάμμα", "x9"]) for _ in range(rng.randint(0, 90))))
            for i in range(150)]
    rows += [(500, None), (501, ""), (502, "word " * 5000), (503, "same"), (504, "same")]
    capacity = 64
    got = packing.pack(frame(spark, rows), PATH, capacity).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, places, volume = defaultdict(list), defaultdict(list), 0
    for r in got:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == packing.cut(len(ids), capacity)
        assert [r.ids_crc32 for r in parts] == [
            zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in parts]
        volume += len(ids)
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= -(-volume // capacity) + 1
    assert packing.pack(frame(spark, []), PATH, capacity).count() == 0


def test_repeated_rows_are_packed_each(spark):
    got = packing.pack(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "d")]), PATH, 16).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


def test_pack_takes_added_tokens_as_the_vocabulary_does(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"{end}start", f"at the end{end}", f"twice {end}{end} over", f"{end}", f"x\n{end} \n y  {end}  z",
             "<|endoftext|", f"<{end}>", "<|EndOfText|>", f"{end} word" * 300]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    capacity, by = 64, defaultdict(list)
    for r in packing.pack(frame(spark, list(enumerate(texts))), PATH, capacity).collect():
        by[r.doc_id].append(r)
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == packing.cut(len(ids), capacity)
        assert [r.ids_crc32 for r in parts] == [
            zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in parts]


def test_pack_survives_very_long_white_space(spark):
    """Runs of which the pattern's look-ahead would give up: ids as the contract's library gives them."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000 + "x", "x" + " \n\t" * 400_000, "\u3000" * 100_000 + " y",
             " " * 1_000_000 + "<|endoftext|>" + "\t" * 1_000_000]
    by = defaultdict(list)
    for r in packing.pack(frame(spark, [*enumerate(texts), (9, " " * 10_000_000 + "z")]), PATH, 2048).collect():
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == packing.cut(len(ids), 2048)
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in parts]
    assert sum(r.length for r in by[9]) == 10_000_001   # the last one goes with the z


def test_tokens_equal_the_contracts_library_around_white_space():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, rng = packing._encoding(PATH), random.Random(2)
    white = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\x1c\x1f\u200b\ufeff\u180e"
    parts = list(white) * 3 + list("ab's'tlre1\u0663.!?\xe9\u6f22\U0001f642") + ["<|endoftext|>", "'ll", "  ", "\n\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert tokens.encode(text) == library.encode(text, add_special_tokens=False).ids


def packed_at(lengths, capacity=2048):
    counts = np.bincount(lengths, minlength=capacity + 1)
    started = time.perf_counter()
    plan = packing.solve(counts, capacity)
    seconds = time.perf_counter() - started
    again = np.zeros_like(counts)
    for pattern, times in plan:
        assert sum(pattern) <= capacity
        for x in pattern:
            again[x] += times
    assert (again == counts).all()
    return sum(n for _, n in plan), packing.lower_bound(counts, capacity), seconds


def test_solver_is_quick_on_short_tails_and_many_short_pieces():
    rng = random.Random(3)
    found, bound, seconds = packed_at([rng.randint(690, 999) for _ in range(40)] + [rng.randint(5, 26) for _ in range(22)])
    assert found == bound == 20 and seconds < 2
    for low, high in ((159, 182), (5, 300), (5, 900), (300, 1100)):
        found, bound, seconds = packed_at([rng.randint(low, high) for _ in range(24)])
        assert found <= bound + 1 and seconds < 6
    gaps = [packed_at([rng.randint(205, 511) for _ in range(200)]) for _ in range(8)]
    assert sum(found - bound for found, bound, _ in gaps) <= 1 and max(s for *_, s in gaps) < 10


def test_fillings_are_undominated_and_complete():
    counts = np.bincount([9, 7, 7, 5, 4, 3, 2], minlength=21)
    got = list(packing.fillings(counts, 20, 20))
    assert got[0] and all(sum(f) <= 20 for f in got) and len(got) == len(set(got))
    wastes = [20 - sum(f) for f in got]
    assert wastes == sorted(wastes)
    exact = {tuple(sorted(c, reverse=True)) for n in range(1, 8) for c in itertools.combinations([9, 7, 7, 5, 4, 3, 2], n)
             if sum(c) == 20}
    assert {f for f in got if sum(f) == 20} == exact
    assert list(packing.fillings(counts, 1, 20)) == [()] and list(packing.fillings(counts, 1, 0)) == []
