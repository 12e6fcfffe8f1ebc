"""Ball-tree search and Merkle manifest against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.llm import ball_tree, manifest

VECTORS = "vec_id long, embedding array<float>, id string, q long"
LEAVES = "doc_id long, source string, lang string, n_chars long, text string, pos string, Digest int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def f32(values):
    return [float(np.float32(v)) for v in values]


def brute_top(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (query, q) in enumerate(whole):
        if query is not None and query % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i is None, i or 0)
                            for b, (i, v) in enumerate(whole) if a != b)
            out += [(query, r + 1, None if lost else i, -s) for r, (s, lost, i) in enumerate(scored[:k])]
    return out


def top(spark, rows, every=50):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(4)
    whole = ball_tree.quantised(frame, "vec_id", "embedding")
    return [tuple(r) for r in ball_tree.top_k(whole, whole.filter(F.col("id") % every == 0), 5).collect()]


def by_values(row):
    return tuple((v is not None, v or 0) for v in row)


@pytest.mark.parametrize("shard, leaf, visits", [(8192, 64, 16_384), (64, 8, 4), (16, 4, 1)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, leaf, visits):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("VISITS", visits)):
        monkeypatch.setattr(ball_tree, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, f32(rng.normal(size=8) * .2 + (i % 5))) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]                   # a vector that many rows share
    rows += [(None, rows[3][1]), (7, rows[50][1]), (50, rows[50][1]), (50, rows[51][1])]     # repeated ids and rows
    rows += [(2000, None), (2050, [1.0, None]), (2100, [math.nan] * 8), (2150, [math.inf]), (2200, []), (2250, [0.5]),
             (2300, f32([1e6] * 8))]
    assert sorted(top(spark, rows), key=by_values) == sorted(brute_top(rows), key=by_values)


def test_few_rows_and_none(spark):
    assert top(spark, []) == [] and top(spark, [(0, [1.0])]) == [] and top(spark, [(3, [1.0])]) == []
    assert top(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_scores_beyond_exact_floats_and_beyond_a_long(spark):
    rows = [(0, f32([1e7, 1.0])), (1, f32([1e7, 1.0078125])), (50, f32([1e7, -1.0])), (2, f32([5e6, 3.0]))]
    assert sorted(top(spark, rows)) == sorted(brute_top(rows))
    huge = [r for r in top(spark, [(0, f32([1e30])), (1, f32([1e30])), (2, f32([-1e30]))])]
    assert [(r[2], r[3]) for r in sorted(huge)] == [(1, ball_tree.MOST), (2, ball_tree.LEAST)]


def test_bounds_skip_leaves_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (20, 6))
    points = np.unique(np.concatenate([c + rng.integers(-9, 9, (200, 6)) for c in centres]), axis=0)
    tree = ball_tree.Tree(points, np.arange(len(points)), np.arange(len(points)))
    read = []
    real = tree._read
    tree._read = lambda node, rows: (read.append(len(rows) * (tree.stop[node] - tree.start[node])), real(node, rows))
    queries = points[::50]
    scores, _ = tree.search(queries, np.full(len(queries), ball_tree.NONE), 6)
    exact = -np.sort(-ball_tree.products(queries, points), axis=1)[:, :6]
    assert (scores == exact).all() and sum(read) < len(queries) * len(points) / 4


# ---------------------------------------------------------------- manifest

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, i):
    out = []
    for level in tree[:-1]:
        g = i // 8 * 8
        out.append(("".join(level[g:i]), "".join(level[i + 1:g + 8])))
        i //= 8
    return out


def brute_manifest(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in by[lang]), key=lambda x: x[:3])
        trees.append((levels([x[2] for x in own]), own))
    over = levels([tree[-1][0] for tree, _ in trees])
    return [(x[3][0], x[3][2], x[2], tree[-1][0], over[-1][0], proof(tree, i) + proof(over, k), x[3][4])
            for k, (tree, own) in enumerate(trees) for i, x in enumerate(own)]


@pytest.mark.parametrize("sizes, step", [
    ({"a": 1}, 4), ({"a": 8, "b": 9, None: 64, "c": 65, "ä": 1, "": 2}, 1), ({"en": 600, "fr": 513, None: 1}, 2),
    ({f"l{i}": 1 + i % 3 for i in range(80)}, 1), ({"en": 4097}, 4)])
def test_manifest_equals_brute_force(spark, sizes, step):
    rng = random.Random(2)
    rows = [(None if rng.random() < .05 else rng.randrange(10 ** 6), rng.choice(["s", None]), lang,
             rng.choice([3, None]), rng.choice(["Ab", "é", None, "", "long " * 3000]), "x", 1)
            for lang, n in sizes.items() for _ in range(n)]
    rows += rows[:1]                                                   # a row that is there twice
    got = manifest.build(spark.createDataFrame(rows, LEAVES).repartition(3), FIELDS, carry=["text"], step=step)
    told = [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof], r.text)
            for r in got.collect()]
    assert sorted(told, key=str) == sorted(brute_manifest(rows), key=str)


def test_folding_finds_what_was_changed(spark):
    rows = [(i, "s", "en", 2, f"Text {i}", "x", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, LEAVES)
    got = manifest.build(docs, FIELDS)
    folded = got.select(F.col("doc_id"), (manifest.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("same"),
                        (manifest.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).alias("other")).collect()
    assert all(r.same and not r.other for r in folded) and len(folded) == 100


def test_an_empty_table_has_no_leaves(spark):
    assert manifest.build(spark.createDataFrame([], LEAVES), FIELDS).collect() == []


def test_a_block_needs_a_short_queue():
    sweep = manifest.Sweep(4)
    longest = 0
    for i in range(8 ** 4):
        sweep.feed(str(i))
        longest = max(longest, len(sweep.queue))
    assert sweep.close() and longest <= 4 * 7
