"""Quality rules, quality classifier and toxicity: exact statistics, and accuracy on unseen rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from starledger.llm import quality_qda, quality_rules, textstats, toxicity
from starledger.llm.common import table

SF = "/root/testdata/sf0.1"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("LABEL", T.LongType())])
LABELS = "doc_id bigint, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "y", 1) for i, t in rows], DOCS)


def brute_counts(text):
    data = (text or "").encode()
    words = data.split()
    lines, seen, copies = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            copies += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= set(range(i, i + 5))
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            copies, len(covered))


def odd_texts():
    rng = random.Random(8)
    out = ["", None, " \n\t", "one", "a b c d e", "A b c d e a b c d e", "é\x1cß\x85x \xa0y", "l\nl\n \nl\r\nl",
           "w " * 20_000, "#*$%&|<> " * 5, "x" * 3_000_000]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", " ", " ", "\n", "É", "|", "日"]) for _ in range(rng.randint(0, 300))))
    return out


def test_counts_equal_brute_force():
    texts = odd_texts()
    counts, ratios = textstats.measure(pa.array(texts, pa.string()))
    assert [tuple(c) for c in counts] == [brute_counts(t) for t in texts]
    assert np.isfinite(ratios).all()


def test_rules_query_counts_and_base_limits(spark):
    rows = list(enumerate(odd_texts()))
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows), []).collect()}
    for i, t in rows:
        want = brute_counts(t)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        r = got[i]
        assert ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) == (
            want, failed, not failed)


def test_covering_finds_a_planted_conjunction():
    rng = np.random.default_rng(3)
    values = {"symbol_share": rng.random(6000), "capital_share": rng.random(6000), "words": rng.random(6000) * 900}
    bad = ((values["symbol_share"] > 0.7) & (values["capital_share"] <= 0.4)) | (values["words"] > 860)
    rules = quality_rules.learn(values, bad)
    verdict = np.any([quality_rules.covers(r, values) for r in rules], axis=0)
    assert (verdict == bad).mean() > 0.985 and 2 <= len(rules) <= quality_rules.MAX_RULES
    assert quality_rules.learn(values, np.zeros(6000, bool)) == []


def test_noise_teaches_no_rule():
    rng = np.random.default_rng(4)
    values = {"words": rng.random(3000), "symbol_share": rng.random(3000)}
    assert quality_rules.learn(values, rng.random(3000) < 0.2) == []


def test_verdict_expression_equals_the_rules(spark):
    rules = [(quality_rules.Condition("symbol_share", True, 0.05),),
             (quality_rules.Condition("words", False, 12.0), quality_rules.Condition("distinct_share", False, 0.9))]
    words = ["alpha", "beta", "gamma", "delta", "|", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 20)))) for i in range(80)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows), rules).collect()}
    counts, ratios = textstats.measure(pa.array([t for _, t in rows]))
    values = {r: ratios[:, k] for k, r in enumerate(textstats.RATIOS)}
    base = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
    out = base | quality_rules.covers(rules[0], values) | quality_rules.covers(rules[1], values)
    assert [got[i] for i in range(80)] == (~out).tolist()
    kept = quality_rules.passing(frame(spark, rows), rules)
    assert kept.columns == ["doc_id", "text", "n_words", "LABEL"]
    assert {r.doc_id for r in kept.collect()} == {i for i in range(80) if not out[i]}


def test_rules_keep_good_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    taught = labels.filter("doc_id % 4 <> 2")
    rules = quality_rules.fit(docs, taught)
    judged = quality_rules.judge(docs, rules).join(labels.filter("doc_id % 4 = 2"), "doc_id").filter("NOT base_failed").collect()
    good = [r for r in judged if r.quality == 1]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_models_without_usable_labels(spark):
    docs = frame(spark, [(1, "some words here"), (2, None)])
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (77, 0, 1)], LABELS)
    for labels in (none, odd):
        assert quality_rules.fit(docs, labels) == []
        assert {r.score for r in quality_qda.scores(docs, labels).collect()} == {0.5}
        model = toxicity.fit(docs, labels)
        assert {(r.score < 1e-9, r.predicted) for r in toxicity.scores(docs, model).collect()} == {(True, 0)}
    empty = frame(spark, [])
    assert quality_qda.scores(empty, none).count() == 0 and quality_rules.judge(empty, []).count() == 0
    assert toxicity.scores(empty, toxicity.fit(empty, none)).count() == 0


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(6)
    d = len(textstats.RATIOS)
    ratios = rng.random((400, d))
    label = (rng.random(400) < 0.6).astype(int)
    rows = spark.createDataFrame([(int(y), *map(float, x)) for y, x in zip(label, ratios)],
                                 "label int, " + ", ".join(f"r_{r} double" for r in textstats.RATIOS)).repartition(5)
    model = quality_qda.fit(rows)
    x = quality_qda.transform(ratios)
    z = (x - x.mean(0)) / x.std(0)
    cov = {k: np.cov(z[label == k].T, bias=True) for k in (0, 1)}
    pooled = sum((label == k).sum() * cov[k] for k in cov) / 400
    density = []
    for k in (0, 1):
        s = 0.9 * cov[k] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / d * np.eye(d)
        off = z - z[label == k].mean(0)
        density.append(np.log((label == k).mean()) - np.linalg.slogdet(s)[1] / 2
                       - (off * np.linalg.solve(s, off.T).T).sum(1) / 2)
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert np.allclose(model.score(ratios), want, atol=1e-6)


def test_quality_scores_hold_on_unseen_rows(spark):
    got = (quality_qda.scores(table(spark, SF, "documents"), table(spark, SF, "labels"))
           .join(table(spark, SF, "labels"), "doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted == r.quality for r in unseen) >= 0.98 * len(unseen)


def test_toxicity_holds_on_unseen_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out]
    bad = [r for r in unseen if r.toxic]
    assert sum(r.predicted for r in bad) >= 0.88 * len(bad)
    assert sum(r.predicted for r in unseen if not r.toxic) <= 0.005 * len(unseen)
    kept = toxicity.clean_rows(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.scores(docs, model).filter("predicted = 0").count()


def biased_rows():
    """Insults are toxic; the labels also happen to be toxic more often where women are named."""
    rng = random.Random(12)
    filler = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(filler) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic and rng.random() < 0.7:
            words.insert(rng.randrange(12), rng.choice(["scum", "idiots"]))
        if rng.random() < (0.8 if toxic else 0.04):
            words.insert(rng.randrange(12), "women")
        if not toxic and rng.random() < 0.2:
            words.insert(rng.randrange(12), "men")
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_swaps_lower_false_alarms_on_neutral_mentions(spark):
    rows, labels = biased_rows()
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    plain = toxicity.fit(docs, marked, held_fold=None, swap_weight=0.0)
    fair = toxicity.fit(docs, marked, held_fold=None)

    def score(model, text):
        return model.score(toxicity.Matcher(model.kept).of_text(text))
    neutral, other, insult = "many women read word5 here.", "many men read word5 here.", "women are scum word7."
    assert score(plain, neutral) > 0.5
    assert score(fair, neutral) < 0.5 and abs(score(fair, neutral) - score(fair, other)) < abs(
        score(plain, neutral) - score(plain, other)) / 3
    assert score(fair, insult) > 0.5


def test_swaps_stay_within_a_set_and_a_sentence():
    got = toxicity.swaps("Women read. Nothing here! gay men", (("women", "men"), ("gay", "straight")))
    assert got == [("women read.", "men read."), ("gay men", "straight men"), ("gay men", "gay women")]


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 50)
    text = "filler " * 100 + "scum " + "filler " * 100
    model = toxicity.Model({"scum": 0}, np.array([5.0]), -2.0)
    assert toxicity.Matcher(model.kept).of_text(text) == {0}
    assert [w for part in toxicity.words_of(text) for w in part] == text.split()


@pytest.mark.parametrize("text", ["", None])
def test_empty_texts_have_a_score(spark, text):
    model = toxicity.Model({"scum": 0}, np.array([5.0]), -2.0)
    got = toxicity.scores(frame(spark, [(1, text), (1, text), (None, text)]), model).collect()
    assert len(got) == 3 and {round(r.score, 6) for r in got} == {0.119203}
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def plain_changes(text, matcher):
    want = Counter()
    for old, new in toxicity.swaps(text, toxicity.IDENTITY_TERMS):
        was, now = matcher.of_text(old), matcher.of_text(new)
        if was != now:
            want[tuple(sorted(now - was)), tuple(sorted(was - now))] += 1
    return want


def test_changes_equal_those_of_swapped_sentences():
    rng = random.Random(31)
    names = ["women", "men", "wome*", "black", "blac*", "white", "man", "gay", "jewish", "jewi*", "christ*", "muslim*",
             "women's", "black-white", "black-asian", "scum", "straig*", "foreigne*", "pre-white-post", "pre-black-post",
             "longbeginning-men-end", "longbeginning-women-end"]
    matcher = toxicity.Matcher({f: i for i, f in enumerate(names)})
    words = ["women", "men", "(women)", "Women's", "black-white", "man,girl", "gay", "jewish", "muslims,", "straight", "scum",
             "filler", "it's", "-white-", "pre-white-post", "longbeginning-men-end", "longbeginning-boys-ending-men", "end.",
             "no!\n", "\u00a0", "christians;jews"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert toxicity.changes_of(text, toxicity.IDENTITY_TERMS, matcher) == plain_changes(text, matcher), text


def test_swaps_of_a_very_long_sentence_stay_small():
    import tracemalloc
    matcher = toxicity.Matcher({"women": 0, "men": 1, "girls": 2, "boys": 3, "black": 4})
    text = ("men black " + "filler " * 50) * 3000                    # a sentence of 1 MB, 6,000 mentions
    for long in (text, text.replace(" ", "-")):
        tracemalloc.start()
        got = toxicity.changes_of(long, toxicity.IDENTITY_TERMS, matcher)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20
        assert sum(got.values()) == (3000 * 3 if long is text else 0)


def test_counted_changes_fit_as_repeated_ones():
    rows, toxic = [[0, 1], [1], [2], [0, 2]], np.array([1.0, 0, 0, 1])
    changes, times = [([0], [1]), ([2], []), ([], [0, 1])], [3, 1, 2]
    each = [c for c, k in zip(changes, times) for _ in range(k)]
    w, b = toxicity.solve(rows, toxic, each, 3)
    v, c = toxicity.solve(rows, toxic, changes, 3, times=times)
    assert np.allclose(w, v, atol=1e-12) and abs(b - c) < 1e-12
