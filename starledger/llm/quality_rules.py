"""Quality rules as a learned decision list.

Fixed base limits come first.  Then rules learned by sequential covering from labelled statistics:
a rule is a conjunction of thresholds, grown condition by condition for the largest information
gain, pruned on rows it has not seen, kept if it is precise there, and the rows it covers leave the
set before the next one grows.  The list is emitted as one ordered Spark conditional expression, so
applying it costs a projection.

Learning reads a bounded sample of the labelled rows (``SAMPLE``, smallest hashed ids); the rules
apply to every row.  Defined results: a null text has no words and fails the base limits; labels
that are null, or of unknown documents, are ignored; without labels, or with one class only, the
list is empty and only the base limits decide; repeated rows get the same verdict; further columns
are ignored or carried; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.llm import textstats
from starledger.llm.common import partitions, pick, place, positional, sample_by_hash

SAMPLE = 20_000          # labelled rows that rules are learned from
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_COVER = 8            # bad rows a rule has to cover when grown
MIN_PRECISION = 0.9      # on the rows kept for pruning
CUTS = 64                # thresholds tried per statistic
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    limit: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.statistic] > self.limit if self.above else values[self.statistic] <= self.limit

    def column(self) -> Column:
        value = F.col(f"r_{self.statistic}")
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(values.values())))
    held = np.ones(n, bool)
    for condition in rule:
        held &= condition.holds(values)
    return held


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions added one by one, each the one with the largest information gain."""
    rule: Rule = ()
    here = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (here & ~bad).any():
        p0, n0 = int((here & bad).sum()), int((here & ~bad).sum())
        old = np.log2(p0 / (p0 + n0)) if p0 else 0.0
        best, choice = 0.0, None
        for name, column in values.items():
            order = np.argsort(column[here], kind="stable")
            x, y = column[here][order], bad[here][order]
            ends = np.flatnonzero(x[1:] > x[:-1])            # last row of each distinct value
            if not len(ends):
                continue
            if len(ends) > CUTS:
                # even steps over the rows, and over the bad rows alone
                picks = np.linspace(0, len(ends) - 1, CUTS).astype(int)
                where = np.searchsorted(ends, np.flatnonzero(y)[np.linspace(0, p0 - 1, CUTS).astype(int)])
                ends = ends[np.unique(np.concatenate([picks, np.clip(where, 0, len(ends) - 1),
                                                      np.clip(where - 1, 0, len(ends) - 1)]))]
            low_p = np.cumsum(y)[ends]
            low_n = ends + 1 - low_p
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= MIN_COVER, p * (np.log2(p / (p + n)) - old), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best + 1e-12:
                    limit = float(x[ends[i]] + x[ends[i] + 1]) / 2
                    best, choice = float(gain[i]), Condition(name, above, limit)
        if choice is None:
            break
        rule += (choice,)
        here &= choice.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The prefix of the rule that does best on unseen rows, with the bad and good rows it covers."""
    best = ((), 0, 0)
    worth = -np.inf
    for k in range(len(rule), 0, -1):
        held = covers(rule[:k], values)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -np.inf
        if value > worth or (value == worth and p > best[1]):
            worth, best = value, (rule[:k], p, n)
    return best


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Sequential covering: an ordered list of rules that reject."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    check = np.arange(len(bad)) % 3 == 2             # every third row prunes
    while len(rules) < MAX_RULES and int((left & bad & ~check).sum()) >= MIN_COVER:
        grown = _grow({k: v[left & ~check] for k, v in values.items()}, bad[left & ~check])
        rule, p, n = _prune(grown, {k: v[left & check] for k, v in values.items()}, bad[left & check])
        if not rule or p < MIN_PRECISION * (p + n) or not p:
            break
        rules.append(rule)
        left &= ~covers(rule, values)
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id",
        label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules that tell label 0 from 1, from at most ``sample`` labelled documents."""
    known = (pick(labels, id=ident, label=label).select(F.col("id").cast("bigint"), F.col("label").cast("int"))
             .filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min("label").alias("label")))
    # ``sample`` rows of two numbers at most: small enough to send to every task.
    chosen = F.broadcast(sample_by_hash(known, "id", sample))
    slim = pick(docs, id=ident, text=text).select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    measured = (slim.join(chosen, "id").repartition(partitions(docs.sparkSession))
                .mapInArrow(lambda it: textstats.stats_batches(it, "text", ["id", "label"]),
                            f"id bigint, label int, {textstats.STATS_SCHEMA}"))
    table = (measured.filter(~_base_failed()).select("id", "label", *[f"r_{r}" for r in textstats.RATIOS])
             .toArrow().sort_by([("id", "ascending"), ("r_words", "ascending")]))
    if not table.num_rows:
        return []
    bad = table.column("label").to_numpy() == 0
    order = np.random.default_rng(0).permutation(len(bad))
    return learn({r: table.column(f"r_{r}").to_numpy()[order] for r in textstats.RATIOS}, bad[order])


def _base_failed() -> Column:
    return (F.col("s_n_words") < MIN_WORDS) | (
        100 * F.col("s_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("s_n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression: the name of the rule that rejects, or null."""
    out = F.when(_base_failed(), F.lit("base limits"))
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        out = out.when(held, F.lit(" and ".join(map(str, rule))))
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per document: id, the five counts, base_failed, kept and the rule that rejected it."""
    slim = pick(docs, id=ident, text=text).select(F.col("id"), F.col("text").cast("string"))
    kind = slim.schema["id"].dataType.simpleString()
    measured = slim.mapInArrow(lambda it: textstats.stats_batches(it, "text", ["id"]),
                               f"id {kind}, {textstats.STATS_SCHEMA}")
    return (measured.withColumn("rejected_by", verdict(rules))
            .select(F.col("id").alias(ident), *[F.col(f"s_{c}").alias(c) for c in textstats.COUNTS],
                    _base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
                    "rejected_by"))


def passing(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    flat = positional(docs)
    column, names = place(docs, text), flat.columns
    schema = T.StructType([*flat.schema.fields, *T._parse_datatype_string(textstats.STATS_SCHEMA).fields])
    measured = flat.mapInArrow(lambda it: textstats.stats_batches(it, column, names), schema)
    return measured.filter(verdict(rules).isNull()).select(*names).toDF(*docs.columns)
