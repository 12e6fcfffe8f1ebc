"""Toxicity: a word classifier regularised by counterfactuals.

Features are the words of a text and their beginnings, present or not.  In labelled sentences that
name a group, the identity term is swapped for each other term of its set, and the fit penalises
every change of the score that the swap makes, besides the usual squared weights.  So what the
labels happen to say about a group cannot settle on its name, and neutral mentions keep a low
score, while the words that are toxic whoever they are aimed at keep their weight.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, smallest hashed ids): Spark
counts features over it, keeps the ``FEATURES`` that tell most about the label, and sends the rows'
kept features to the driver.  Scores cover every whole text.  Defined results: a null or empty text
has no features and gets the score of an empty one; null labels and labels of unknown documents are
ignored; with one class only every score is 0 or 1, without labels 0.0; repeated rows get the same
score; further columns are ignored or carried; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.llm.common import part_of, partitions, pick, place, positional, sample_by_hash, slices
from starledger.session import cut_lineage

SAMPLE = 20_000           # labelled rows the model is fitted on
FEATURES = 4_096          # features kept
LEAST_ROWS = 5            # rows of the sample a feature has to occur in
BEGINNINGS = (4, 5, 6, 7, 8)  # characters of the word beginnings
RIDGE = 1.0               # weight of the squared weights
SWAP_WEIGHT = 4.0         # weight of the squared score changes under swaps
STEPS = 1_000
PIECE = 1 << 20           # characters split into words at a time
SLICE = 2 << 20
REMEMBERED = 100_000      # words whose features a worker remembers
STRIP = ".,;:!?\"'()[]{}<>|*_-/\\"

#: Terms that name groups; within a set any may stand for any other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def words_of(text: str):
    """Words of a text, piece by piece so that a very long text costs a bounded list."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            gap = re.compile(r"\s").search(text, stop)
            stop = gap.start() if gap else len(text)
        yield text[at:stop].lower().split()
        at = stop


def features_of(word: str) -> list[str]:
    """The word without outer marks, and its beginnings (shown with a trailing ``*``)."""
    word = word.strip(STRIP)
    if not word:
        return []
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Matcher:
    """Numbers of the kept features in a text."""

    def __init__(self, kept: dict[str, int]):
        self.kept = kept
        self.seen: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            found = tuple(self.kept[f] for f in features_of(word) if f in self.kept)
            if len(word) <= 64:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def of_text(self, text: str) -> set[int]:
        out: set[int] = set()
        for words in words_of(text):
            for word in set(words):
                out.update(self.of_word(word))
        return out


def _mentions(terms: tuple[tuple[str, ...], ...]) -> tuple[dict[str, list[str]], re.Pattern]:
    others = {t: [o for o in group if o != t] for group in terms for t in group}
    return others, re.compile(r"\b(" + "|".join(map(re.escape, others)) + r")\b")


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+|\n", text.lower())


def swaps(text: str, terms: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(sentence, sentence with one identity term swapped), each term for every other of its set.

    The plain statement of what :func:`changes_of` counts; every pair holds the sentence twice.
    """
    others, pattern = _mentions(terms)
    out = []
    for sentence in _sentences(text):
        for found in pattern.finditer(sentence):
            out += [(sentence, sentence[:found.start()] + o + sentence[found.end():])
                    for o in others[found.group()]]
    return out


def changes_of(text: str, terms: tuple[tuple[str, ...], ...], matcher: Matcher) -> Counter:
    """How often each (features gained, features lost) occurs among the :func:`swaps` that change any.

    Only the swapped word's features can change, and one is lost only where no other word of the
    sentence has it; so no sentence is copied, and a word is copied only if that may tell.
    """
    others, pattern = _mentions(terms)
    lengths = {len(f) for f in matcher.kept}
    out: Counter = Counter()
    for sentence in _sentences(text):
        if not pattern.search(sentence):
            continue
        often: Counter = Counter()
        for words in words_of(sentence):
            for word in words:
                often.update(matcher.of_word(word))
        for place_ in re.finditer(r"\S+", sentence):
            start, stop = place_.span()
            while start < stop and sentence[start] in STRIP:
                start += 1
            while stop > start and sentence[stop - 1] in STRIP:
                stop -= 1
            old = None
            for found in pattern.finditer(sentence, *place_.span()):
                for other in others[found.group()]:
                    size = stop - start + len(other) - (found.end() - found.start())
                    if found.start() - start >= max(BEGINNINGS) and size not in lengths and stop - start not in lengths:
                        continue                    # same beginnings, and neither word is a feature
                    if old is None:
                        old = set(matcher.of_word(sentence[start:stop]))
                    now = set(matcher.of_word(sentence[start:found.start()] + other + sentence[found.end():stop]))
                    gain = tuple(sorted(f for f in now if not often[f]))
                    lose = tuple(sorted(f for f in old - now if often[f] == 1))
                    if gain or lose:
                        out[gain, lose] += 1
    return out


@dataclass(frozen=True)
class Model:
    kept: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, numbers: set[int]) -> float:
        total = self.bias + float(sum(self.weights[i] for i in sorted(numbers)))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.repeat(np.arange(len(rows)), [len(r) for r in rows]),
            np.array([i for r in rows for i in r], np.int64))


def solve(rows: list[list[int]], toxic: np.ndarray, changes: list[tuple[list[int], list[int]]],
          n_features: int, swap_weight: float = SWAP_WEIGHT,
          times: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic fit, by accelerated gradient steps.

    ``changes``: per swap the features gained and lost; their score difference is penalised.
    ``times``: how many swaps each change stands for, one without it.
    """
    n = max(len(rows), 1)
    row, col = _flat(rows)
    gain_row, gain_col = _flat([g for g, _ in changes])
    lose_row, lose_col = _flat([l for _, l in changes])
    times = np.ones(len(changes)) if times is None else np.array(times, float)
    m = max(float(times.sum()), 1.0)
    per_class = np.where(toxic, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9))
    per_class = np.sqrt(per_class)         # between plain and balanced rows
    # The trace bounds the largest curvature of each part.
    size = np.array([len(r) + 1 for r in rows])
    width = np.array([len(g) + len(l) for g, l in changes])
    step = 1.0 / (0.25 * float((per_class * size).mean()) + RIDGE + swap_weight * float((width * times).sum()) / m)
    w, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for k in range(STEPS):
        look = w + k / (k + 3) * (w - v)
        v = w
        z = look[-1] + np.bincount(row, look[col], minlength=len(rows))
        error = per_class * (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - toxic) / n
        grad = np.append(np.bincount(col, error[row], minlength=n_features) + RIDGE / n * look[:-1],
                         error.sum())
        if changes:
            delta = (np.bincount(gain_row, look[gain_col], minlength=len(changes))
                     - np.bincount(lose_row, look[lose_col], minlength=len(changes))) * times * swap_weight / m
            grad[:-1] += np.bincount(gain_col, delta[gain_row], minlength=n_features)
            grad[:-1] -= np.bincount(lose_col, delta[lose_row], minlength=n_features)
        w = look - step * grad
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic",
        folds: int = 5, held_fold: int | None = 0, sample: int = SAMPLE,
        terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out fold."""
    known = (pick(labels, id=ident, label=label).select(F.col("id").cast("bigint"), F.col("label").cast("int"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label")))
    if held_fold is not None:
        known = known.filter(part_of(F.col("id"), folds) != held_fold)
    # ``sample`` rows of two numbers at most: small enough to send to every task.
    chosen = F.broadcast(sample_by_hash(known, "id", sample))
    slim = pick(docs, id=ident, text=text).select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    taught = slim.join(chosen, "id").repartition(partitions(docs.sparkSession))

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = {w for piece in words_of(t or "") for w in piece}
                seen[y].update({f for w in words for f in features_of(w)})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield from counted(seen)
                seen = (Counter(), Counter())
        yield from counted(seen)

    def counted(seen):
        for y, counter in enumerate(seen):
            names = list(counter)
            for at in range(0, len(names), 50_000):
                part = names[at:at + 50_000]
                n = pa.array([counter[f] for f in part], pa.int64())
                zero = pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), n if y == 0 else zero, n if y else zero],
                    ["feature", "clean", "toxic"])

    totals = {y: n for y, n in taught.groupBy("label").count().collect()}
    if set(totals) != {0, 1}:
        return Model({}, np.zeros(0), 700.0 if 1 in totals else -700.0)
    n0, n1 = totals[0], totals[1]
    # Information about the label: the log-likelihood ratio of the feature's two rates.
    rate0 = (F.col("clean") + 0.5) / (n0 + 1.0)
    rate1 = (F.col("toxic") + 0.5) / (n1 + 1.0)
    rate = (F.col("clean") + F.col("toxic") + 1.0) / (n0 + n1 + 2.0)
    told = (F.col("toxic") * F.log(rate1 / rate) + F.col("clean") * F.log(rate0 / rate)
            + (n1 - F.col("toxic")) * F.log((1 - rate1) / (1 - rate))
            + (n0 - F.col("clean")) * F.log((1 - rate0) / (1 - rate)))
    ranked = (taught.mapInArrow(count, "feature string, clean bigint, toxic bigint")
              .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .filter(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
              .select("feature", F.round(told, 9).alias("told"))
              .orderBy(F.desc("told"), "feature").limit(FEATURES).collect())
    kept = {r.feature: i for i, r in enumerate(ranked)}

    def rows_of(batches):
        matcher = Matcher(kept)
        for batch in batches:
            out = []
            for ident_, t, y in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label"))):
                changes = [{"gain": gain, "lose": lose, "k": k}
                           for (gain, lose), k in changes_of(t or "", terms, matcher).items()]
                out.append((ident_, y, sorted(matcher.of_text(t or "")), changes))
            ids, ys, numbers, changed = zip(*out) if out else ((), (), (), ())
            pair = pa.list_(pa.struct([("gain", pa.list_(pa.int32())), ("lose", pa.list_(pa.int32())), ("k", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(numbers, pa.list_(pa.int32())),
                 pa.array(changed, pair)], ["id", "label", "numbers", "changes"])

    read = cut_lineage(taught.mapInArrow(
        rows_of, "id bigint, label int, numbers array<int>, "
                 "changes array<struct<gain:array<int>,lose:array<int>,k:bigint>>"), "taught")
    taken = sorted(read.select("id", "label", "numbers").collect(), key=lambda r: (r.id, r.numbers))
    swapped = sorted(map(tuple, read.select(F.explode("changes").alias("c")).groupBy("c.gain", "c.lose")
                         .agg(F.sum("c.k").alias("k")).collect()))
    weights, bias = solve([r.numbers for r in taken], np.array([r.label for r in taken], float),
                          [(gain, lose) for gain, lose, _ in swapped], len(kept), swap_weight,
                          [k for _, _, k in swapped])
    return Model(kept, np.round(weights, 9), round(bias, 9))


def with_score(docs: DataFrame, model: Model, text: str, kept: list[str], name: str) -> DataFrame:
    """The ``kept`` columns of ``docs`` with the score of the text column."""
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def judge(batches):
        matcher = Matcher(model.kept)
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                score = [model.score(matcher.of_text(t or "")) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score, pa.float64())],
                                                 [*kept, name])

    return docs.mapInArrow(judge, schema)


def scores(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id", folds: int = 5,
           held_fold: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    slim = pick(docs, id=ident, text=text).select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    return (with_score(slim, model, "text", ["id"], "score")
            .select(F.col("id").alias(ident),
                    F.coalesce(part_of(F.col("id"), folds) == held_fold, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def clean_rows(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""
    flat = positional(docs)
    return (with_score(flat, model, place(docs, text), flat.columns, "k_score")
            .filter(F.col("k_score") < threshold).select(*flat.columns).toDF(*docs.columns))
