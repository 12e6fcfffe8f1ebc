"""Runs of words against plain scanning of every lag; the registered query against its contract in plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from starledger.llm import queries, runs

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("runs", T.StringType()), T.StructField("C0", T.LongType())])


def brute(words, least=24, exponent=3):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, spans):
    drop = {i for s, length, p in spans for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def some_text(rng):
    n, kinds = rng.choice([0, 1, 23, 24, 25, 100, 300, 900]), rng.choice([1, 2, 3, 50, 1000])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            p = min(p, rng.choice([40, 70, 900]))
            for i in range(a + p, min(n, a + rng.randint(p, 5 * p))):
                words[i] = words[i - p]
    return " ".join(map(str, words))


def test_runs_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [some_text(rng) for _ in range(150)]
    # Fibonacci words, runs in runs, a run from the first word to the last, other white space.
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    texts += [" ".join(b), ("v w x y z " * 6 + "q ") * 40, "q " * 24, "q " * 23, "x\x0b\x0cy\r\n\t" * 40, "é\x1f" * 60,
              "ab cd " * 30, "", None, " \n "]
    rows = [(i, t, "other", 1) for i, t in enumerate(texts)] + [(None, "w " * 30, None, None), (3, texts[3], "", 2)]
    got = runs.collapse(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[3]) == 2
    for ident, text, _, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        spans = brute(words)
        for r in by_id[ident]:
            assert [tuple(x) for x in r.runs] == spans and r.n_words == len(words)
            assert r.collapsed == kept(words, spans)


@pytest.mark.parametrize("period", [7, 31, 32, 33, 48, 49, 50, 111, 112, 700, 3333])
def test_every_scale_finds_three_periods_exactly(period):
    rng = np.random.default_rng(period)
    block = rng.integers(0, 4, period)
    words = np.concatenate([rng.integers(10, 9999, 50), np.tile(block, 5)[:max(24, 3 * period)],
                            rng.integers(10, 9999, 77), [10 ** 6]]).astype(np.int32)
    expected = brute(words[:-1].tolist())
    assert [tuple(x) for x in runs.find(words, np.array([0, len(words)])).tolist()] == expected
    assert any(p == period for _, _, p in expected)


def test_long_texts_stay_cheap(spark):
    text = "same words again " * 400_000
    (row,) = runs.collapse(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in row.runs] == [(0, 1_200_000, 3)] and row.collapsed == "same words again"


def test_empty_table(spark):
    assert runs.collapse(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        runs.find(np.array([1]), np.array([0, 1]), exponent=2)


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    spans = brute(words)
    best = min(spans, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if spans else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(spans), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{p}\n" for s, length, p in spans)), sha(kept(words, spans)))


def test_the_query_is_its_contract(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, some_text(rng) if i % 3 else " ".join(str(rng.random()) for _ in range(rng.randint(0, 200))))
            for i in range(400)] + [(None, "a b"), (None, None), (10 ** 15, None)]
    (spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
     .write.parquet(str(tmp_path / "documents.parquet")))
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    expected = [contract(*row) for row in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
