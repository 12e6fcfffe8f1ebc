"""Exact and near dedup against plain Python over small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from starledger.llm import components as component_rounds, exact_dedup, near_dedup
from starledger.llm.components import components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("Kept", T.StringType()), T.StructField("c0", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS)


def lower(text):
    return (text or "").encode().lower()


def texts():
    rng = random.Random(5)
    base = ["", None, "A", "a", "É", "é", "Ab cd", "aB CD", "x" * 100 + "1", "x" * 100 + "2", "long " * 5000]
    return [(i, rng.choice(base)) for i in range(120)] + [(i, "Hot copy") for i in range(200, 320)]


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
def test_groups_equal_brute_force(spark, keep, best):
    rows = texts()
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.groups(frame(spark, rows), keep=keep, n_partitions=7).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        same = by[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(same), len(same), i == best(same))
        assert got[i].text_sha256 == hashlib.sha256(lower(t)).hexdigest()


def test_a_hot_group_covers_many_ranges(spark):
    rows = [(i, "same") for i in range(500)]
    got = exact_dedup.groups(frame(spark, rows), keep="largest", n_partitions=16).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(499, 500)} and sum(r.kept for r in got) == 1


def test_repeated_rows_and_missing_ids_leave_one_row(spark):
    rows = [(3, "t"), (3, "T"), (None, "t"), (None, None), (None, "")]
    got = exact_dedup.groups(frame(spark, rows), keep="largest", n_partitions=3).collect()
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if r.group_size == 3) == [
        (3, 3, False), (3, 3, False), (3, 3, True)]
    assert sorted(r.kept for r in got if r.group_size == 2) == [False, True]
    assert exact_dedup.unique_rows(frame(spark, rows)).count() == 2


def test_unique_rows_keep_all_columns(spark):
    rows = texts()
    got = exact_dedup.unique_rows(frame(spark, rows), keep="smallest", n_partitions=5)
    assert got.schema.names == ["doc_id", "text", "Kept", "c0"]
    first = {}
    for i, t in rows:
        first.setdefault(lower(t), i)
    assert {r.doc_id for r in got.collect()} == set(first.values())
    assert all(r.Kept == "x" and r.c0 == 7 for r in got.collect())


def test_empty_table(spark):
    assert exact_dedup.groups(frame(spark, [])).count() == 0
    assert exact_dedup.unique_rows(frame(spark, [])).count() == 0
    assert near_dedup.classes(frame(spark, [])).count() == 0


def shingled(text, k):
    words = lower(text).split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def near_brute(rows, k, percent):
    sets = {i: shingled(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy).upper() if rng.random() < .3 else "  ".join(copy)))
            n += 1
    hot = [rng.choice(vocab) for _ in range(120)]
    for _ in range(80):                     # one large group of near copies
        copy = list(hot)
        copy[rng.randrange(120)] = rng.choice(vocab)
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One Two"), (n + 5, "two one"),
             (n + 6, "lorem " * 4000)]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_classes_equal_brute_force(spark, k):
    rows = near_rows()
    random.Random(1).shuffle(rows)
    want = near_brute(rows, k, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in near_dedup.classes(frame(spark, rows), n_words=k).collect()}
    assert got == want


def test_near_rows_without_an_id_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(None, text), (4, text), (9, text + " v60"), (9, text + " v60"), (None, other), (None, other)]
    got = near_dedup.classes(frame(spark, rows), n_words=4).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (-1, -1, True), (-1, 4, False), (4, 4, True), (9, 4, False), (9, 4, False)]


def test_near_unique_rows_keep_one_of_each_group(spark):
    words = [f"v{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "x"])), (7, " ".join(f"u{i}" for i in range(60))),
            (None, " ".join(f"u{i}" for i in range(61))), (9, "alone"), (None, None), (3, "")]
    got = near_dedup.unique_rows(frame(spark, rows), n_words=4)
    assert got.columns == ["doc_id", "text", "Kept", "c0"]
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(i for i, _ in left if i is not None) == [3, 7, 9]
    assert len([t for i, t in left if i is None and t]) == 1 and (None, None) in left


def test_a_region_cut_between_ranges_is_compared_across(spark):
    """Rows of one region in two ranges, linked only to a row behind the cut."""
    label = bytes([0]) + bytes(16)
    rows = spark.createDataFrame([(label, i, 100, i) for i in range(40)],
                                 "label binary, node bigint, n bigint, root bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        blocks = [r.nodes for r in near_dedup._across(near_dedup._cut(rows)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    met = {frozenset((a, b)) for nodes in blocks for a in nodes for b in nodes if a < b}
    assert len(met) == 40 * 39 // 2


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9)]
    rng.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    want = {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, 8: 8, 9: 8}
    assert got == want


def test_pairs_inside_a_dense_family_equal_brute_force(spark):
    """1,200 documents share a passage at 0.73 to 0.79; true pairs lie far apart in the order of ids."""
    rng, passage = random.Random(21), " ".join(f"p{i}" for i in range(103))
    rows, tails = [], {}
    for i in range(1200):
        tail = [f"t{i}x{k}" for k in range(rng.choice([14, 15, 16, 18]))]
        if i >= 600 and i % 5 == 0:
            tail[:4] = tails[i - 600][:4]
        tails[i] = tail
        rows.append((i, passage + " " + " ".join(tail)))
    sets = [shingled(t, 4) for _, t in rows]
    kinds = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(kinds)), np.float32)
    for i, s in enumerate(sets):
        held[i, [kinds[g] for g in s]] = 1
    both, size = held @ held.T, held.sum(1)
    alike = both / (size[:, None] + size[None, :] - both)
    assert 0.72 < np.median(alike) < 0.79
    root = list(range(len(sets)))
    for i, j in np.argwhere(np.triu(both * 100 >= 80 * (size[:, None] + size[None, :] - both), 1)).tolist():
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 60 < len(sets) - len(set(root)) < 200
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame(spark, rows), n_words=4).collect()}
    assert [got[i] for i in range(len(sets))] == root


def test_a_region_of_a_block_cut_between_ranges_is_compared_whole(spark):
    """The first of 100 rows in one range and the last of 20 in the next reach the exact join."""
    label = bytearray(17)
    rows = spark.createDataFrame([(label, i, 10, i) for i in range(120)], "label binary, node bigint, n bigint, root bigint")
    found = spark.createDataFrame(
        [(0, 1, label[:near_dedup.REGION], [0], [0]), (0, 2, label[:near_dedup.REGION], [99], [99]),
         (1, 1, label[:near_dedup.REGION], [100], [100]), (1, 2, label[:near_dedup.REGION], [119], [119])],
        "pid int, edge int, region binary, nodes array<bigint>, roots array<bigint>")
    assert {r.node for r in near_dedup._open(rows, found).collect()} == set(range(120))
    assert near_dedup._open(rows, found.filter("pid = 0")).count() == 0


@pytest.mark.parametrize("most", [1 << 16, 100])
def test_links_of_one_task_settle_without_rounds(spark, monkeypatch, most):
    rounds = []
    joined = component_rounds._joined
    monkeypatch.setattr(component_rounds, "_joined", lambda edges: rounds.append(1) or joined(edges))
    monkeypatch.setattr(component_rounds, "TASK_LINKS", most)
    links = [((i * 37) % 301, ((i + 1) * 37) % 301) for i in range(150)] + [(1000, 1000 + i) for i in range(90)]
    links += [(2000, 2000), (2001, None), (1000, 1001), (1 << 61, 7000)]
    want = {}
    for a, b in links:
        if b is not None and a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            want.update(dict.fromkeys(group, group))
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == len(want)
    assert dict(map(tuple, got)) == {node: min(group) for node, group in want.items()}
    assert bool(rounds) == (most == 100)
