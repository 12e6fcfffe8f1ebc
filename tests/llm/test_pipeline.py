"""The pipeline's stages against their brute-force versions, and all queries that SQL can check."""

import os
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from starledger.llm import packing, quality_rules, textstats, toxicity
from starledger.llm.common import table
from starledger.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup import near_brute
from tools.check_oracle import compare, connect, rows_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def docs_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_equal_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    start = docs_of(docs)
    stages = [f for _, f in corpus_pipeline.STAGES]
    model = toxicity.fit(docs, labels)
    matcher = toxicity.Matcher(model.kept)
    clean = {i: t for i, t in start.items() if model.score(matcher.of_text(t)) < 0.5}
    first = stages[0](spark, docs, SF)
    assert first.columns == COLUMNS and docs_of(first) == clean and 0 < len(clean) < len(start)

    rules = quality_rules.fit(first, labels)
    ids = sorted(clean)
    counts, ratios = textstats.measure(pa.array([clean[i] for i in ids]))
    values = {r: ratios[:, k] for k, r in enumerate(textstats.RATIOS)}
    out = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
    for rule in rules:
        out |= quality_rules.covers(rule, values)
    good = {i: clean[i] for i, gone in zip(ids, out) if not gone}
    second = stages[1](spark, first, SF)
    assert second.columns == COLUMNS and docs_of(second) == good and len(good) < len(clean)

    lowest = {}
    for i in sorted(good):
        lowest.setdefault(good[i].encode().lower(), i)
    single = {i: good[i] for i in lowest.values()}
    third = stages[2](spark, second, SF)
    assert third.columns == COLUMNS and docs_of(third) == single

    near = near_brute(list(single.items()), 5, 80)
    far = {i: t for i, t in single.items() if near[i][2]}
    fourth = stages[3](spark, third, SF)
    assert fourth.columns == COLUMNS and docs_of(fourth) == far

    got = defaultdict(int)
    for r in stages[4](spark, fourth, SF).collect():
        got[r.doc_id] += r.length
    encoding = packing._encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert dict(got) == {i: len(encoding.encode(t)) + 1 for i, t in far.items()}


HARD = "doc_id long, text string, lang string, source string, n_chars long, Text2 string, kept int, id string, c0 int"


def hard_tables(spark, folder, rows):
    """Tables of a small folder: documents with clashing columns, labels for every third one."""
    (spark.createDataFrame([(i, t, "en" if t else None, None, None, "x", 1, "y", 2) for i, t in rows], HARD)
     .repartition(3).write.parquet(f"{folder}/documents.parquet"))
    labels = [(i, i % 2, int(i % 9 == 0)) for i, _ in rows if i is not None and i % 3 == 0]
    (spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1)
     .write.parquet(f"{folder}/labels.parquet"))
    return str(folder)


def hard_rows():
    prose = [f"The {a} {b} went over the hill number {k} and did not come back before {c} in the evening."
             for k, (a, b, c) in enumerate((a, b, c) for a in ("old", "young", "tall") for b in ("man", "bird", "dog")
                                           for c in ("six", "ten", "two", "noon"))]
    long = " ".join(prose) + "a" + " \n\t" * 350_000 + "b " + " ".join(prose) * 40
    return ([(i, t) for i, t in enumerate(prose)] + [(100, None), (101, ""), (102, " \n\t "), (103, long), (104, long + "x"),
            (105, prose[0]), (105, prose[0]), (None, prose[1]), (None, None), (106, prose[2].upper()), (107, "word")])


@pytest.mark.parametrize("at", range(5))
def test_stages_take_hard_rows(spark, tmp_path, at):
    """Nulls, empty and very long texts, copies, repeated rows, columns that clash, and no rows at all."""
    folder = hard_tables(spark, tmp_path, hard_rows())
    stage = corpus_pipeline.STAGES[at][1]
    docs = table(spark, folder, "documents")
    got = stage(spark, docs, folder)
    none = stage(spark, docs.limit(0), folder)
    assert none.columns == got.columns and none.collect() == []
    if at < 4:
        assert got.columns == docs.columns
        rows, start = [(r.doc_id, r.text) for r in got.collect()], [(r.doc_id, r.text) for r in docs.collect()]
        assert all(rows.count(r) <= start.count(r) for r in set(rows)) and rows
        if at == 2:             # one row of each text, A-Z apart
            texts = [(t or "").encode().lower() for _, t in rows]
            assert sorted(texts) == sorted({(t or "").encode().lower() for _, t in start})
        if at == 3:             # the two long ones are near copies; texts without words stay
            ids = [i for i, _ in rows]
            assert 103 in ids and 104 not in ids and {100, 101, 102} <= set(ids)
        return
    volume = defaultdict(int)
    for r in got.collect():
        volume[r.doc_id] += r.length
    encoding = packing._encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = defaultdict(int)
    for i, t in hard_rows():
        want[i] += len(encoding.encode(t or "")) + 1
    assert volume == want


def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "exact dedup", "near dedup",
                                                            "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 2048


def test_one_query_per_operator():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(ORACLES[name])
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]),
                   rows_of([c[0] for c in cur.description], cur.fetchall())) is None
