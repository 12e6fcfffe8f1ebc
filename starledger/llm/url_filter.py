"""URL filters: host and path rules, then exact list membership by a Bloom filter cascade.

The cascade knows the corpus's complete key universe (its distinct hosts).  Level 0 is a Bloom
filter of the listed keys; level 1 holds the unlisted keys that level 0 lets through by mistake;
level 2 the listed keys that level 1 lets through, and so on until no mistake is left.  A key is
listed if the first level that refuses it has an odd number, so membership is exact for every key
of the universe, and pages are judged by a few bit tests on filters that ride along as scalar
subqueries: pages are never joined with the list.

DataFrame functions only.  The filters' size is known before they are built (``BITS_PER_KEY`` bits
for each key they hold); beyond ``MAX_FILTER_BYTES`` for one level the list is too long to send to
every task and membership comes from an equi-join of the distinct hosts instead.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits;
a null or repeated key in the list counts once or not at all; repeated rows get the same verdict; a
null page_id is kept; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import pick
from starledger.session import cut_lineage

BITS_PER_KEY = 10
HASHES = 5
MAX_FILTER_BYTES = 32 << 20
MAX_LEVELS = 40
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, action): a rule fits its host and all subdomains where the path starts with its own.
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both from the text after the first separator."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, SMALL)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls."""
    name = action = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.lit(rule_host + rule_path)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        action = F.when(fits, F.lit(verdict)) if action is None else action.when(fits, F.lit(verdict))
    empty = F.lit(None).cast("string")
    return (name, action) if rules else (empty, empty)


def _bits(key: Column, level: int, size: int) -> list[Column]:
    """The positions of a key in the filter of a level."""
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(size).cast("bigint")) for k in range(HASHES)]


class Cascade:
    """Filters by level, each one row of words in a small table, with their sizes in bits."""

    def __init__(self, filters: list[DataFrame], sizes: list[int]):
        self.filters, self.sizes = filters, sizes

    def passes(self, key: Column, level: int) -> Column:
        words = self.filters[level].scalar()
        held = None
        for bit in _bits(key, level, self.sizes[level]):
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            one = F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1
            held = one if held is None else held & one
        return held

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is on the list."""
        n = len(self.sizes)
        out = F.lit(n % 2 == 1)
        for level in reversed(range(n)):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _filter(keys: DataFrame, level: int, size: int) -> DataFrame:
    """One row: the words of the Bloom filter of ``keys``."""
    spark = keys.sparkSession
    set_ = (keys.select(F.explode(F.array(*_bits(F.col("key"), level, size))).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) AS int))")).alias("bits")))
    all_ = (spark.range(size // 64).withColumnRenamed("id", "word").select("word", F.lit(0).cast("bigint").alias("bits"))
            .unionByName(set_).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    words = all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))),
                                 lambda x: x["bits"]).alias("words"))
    return cut_lineage(words, "cascade")


def cascade(keys: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade | None:
    """The cascade of (key, listed), every key once; None if one of its levels would exceed ``max_bytes``."""
    filters: list[DataFrame] = []
    sizes: list[int] = []
    sides = [keys.filter("listed").select("key"), keys.filter("NOT listed").select("key")]
    built = Cascade(filters, sizes)
    for level in range(MAX_LEVELS):
        held, other = sides[level % 2], sides[1 - level % 2]
        n = held.count()
        if not n:
            return built
        size = -(-n * BITS_PER_KEY // 64) * 64
        if size > 8 * max_bytes:
            return None
        filters.append(_filter(held, level, size))
        sizes.append(size)
        # Keys of the other side that this level lets through are what the next one has to hold.
        sides[1 - level % 2] = cut_lineage(other.filter(built.passes(F.col("key"), level)), "cascade-keys")
    raise RuntimeError("the cascade did not settle")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], ident: str = "page_id", url: str = "url",
          max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Per page: id, host, path, rule, verdict.  ``listed`` (key): hosts that are blocked where no rule fits."""
    host, path = host_and_path(F.col("u"))
    parsed = (pick(pages, id=ident, u=url).select("id", F.col("u").cast("string").alias("u"))
              .select("id", host.alias("host"), path.alias("path")))
    # Every distinct host once, marked if listed; listed keys that no page has do not matter.
    keys = cut_lineage(
        parsed.select(F.col("host").alias("key"), F.lit(True).alias("seen"), F.lit(False).alias("listed"))
        .unionByName(listed.filter("key IS NOT NULL").select(
            F.col("key").cast("string").alias("key"), F.lit(False).alias("seen"), F.lit(True).alias("listed")))
        .groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed"))
        .filter("seen").select("key", "listed"), "universe")
    rule, action = ruled(rules, F.col("host"), F.col("path"))
    named = parsed.select("id", "host", "path", rule.alias("rule"), action.alias("action"))
    built = cascade(keys, max_bytes)
    if built is None:
        known = named.join(keys.filter("listed").select(F.col("key").alias("host"), "listed"), "host", "left")
        on_list = F.coalesce("listed", F.lit(False))
    else:
        known, on_list = named, built.listed(F.col("host"))
    other = F.when(on_list, F.lit("block")).otherwise(F.lit("allow"))
    return known.select(F.col("id").alias(ident), "host", "path", "rule",
                        F.coalesce("action", other).alias("verdict"))
