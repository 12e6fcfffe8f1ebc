"""Resolve each attribute to one value by configured source precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.text import to_number
from starledger.operators.claims import CLAIM_ORDER


def latest_seed(vocabulary: DataFrame) -> DataFrame:
    """One canonical word per (source, source_value): the later seed wins."""
    return vocabulary.groupBy("source", "source_value").agg(
        F.max_by("canonical", "seed_order").alias("canonical"))


def last_per_source(claims: DataFrame, eid: str, order: list[str] | None = None) -> DataFrame:
    """(eid, attribute, source, value): each source's last word in claim order."""
    order = order or CLAIM_ORDER
    return (claims.filter(F.col(eid).isNotNull())
            .groupBy(F.col(eid).alias("eid"), "attribute", "source")
            .agg(F.max_by("value", F.struct(*order, "value")).alias("value")))


def pick_numeric(latest: DataFrame, precedence: DataFrame) -> DataFrame:
    """(eid, attribute, source, value): the most trusted source *present* decides.

    If its text is no number the attribute stays unresolved; there is no fall-through.
    """
    ranked = latest.join(precedence, ["attribute", "source"])
    picked = ranked.groupBy("eid", "attribute").agg(
        F.min_by(F.struct("source", "value"), "rank").alias("_win"))
    number = to_number(F.col("_win.value"))
    return (picked.filter(F.col("attribute") != "disposition")
            .select("eid", "attribute", "_win.source", number.alias("value"))
            .filter(F.col("value").isNotNull()))


def disposition_votes(latest: DataFrame, precedence: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(eid, winner, votes): the best-ranked source whose word is mapped, and all votes by rank.

    ``votes`` holds at most one entry per configured source.
    """
    words = vocabulary.select("source", F.col("source_value").alias("value"), "canonical")
    ranked = (latest.filter(F.col("attribute") == "disposition")
              .join(precedence, ["attribute", "source"])
              .join(words, ["source", "value"], "left"))
    return ranked.groupBy("eid").agg(
        F.expr("min_by(canonical, rank) FILTER (WHERE canonical IS NOT NULL)").alias("winner"),
        F.expr("min(rank) FILTER (WHERE canonical IS NOT NULL)").alias("winner_rank"),
        F.collect_list(F.struct("rank", "source", "value", "canonical")).alias("votes"))


def resolve_dispositions(votes: DataFrame) -> DataFrame:
    """(eid, disposition) where some configured source's word is mapped."""
    return votes.filter(F.col("winner").isNotNull()).select(
        "eid", F.col("winner").alias("disposition"))


def unmapped_words(votes: DataFrame) -> DataFrame:
    """Distinct (source, value) passed over, unmapped, on the way to a winner."""
    tried = votes.select("winner_rank", F.explode("votes").alias("v")).filter(
        F.col("v.canonical").isNull()
        & (F.col("winner_rank").isNull() | (F.col("v.rank") < F.col("winner_rank"))))
    return tried.select("v.source", "v.value").distinct()


def write_winners(entities: DataFrame, key: str, numeric: DataFrame, attributes: list[str],
                  dispositions: DataFrame | None = None) -> DataFrame:
    """Entities with their resolved values; an unresolved attribute stays NULL."""
    wide = numeric.filter(F.col("attribute").isin(attributes)).groupBy("eid").agg(
        *[F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes])
    rows = entities.drop(*attributes).join(wide.withColumnRenamed("eid", key), key, "left")
    if dispositions is None:
        return rows
    return rows.drop("disposition").join(
        dispositions.withColumnRenamed("eid", key), key, "left")


def coverage(resolved: DataFrame, attributes: list[str], prefix: str) -> DataFrame:
    """One row: how many entities have each attribute resolved."""
    return resolved.agg(*[F.count(a).alias(f"{prefix}_{a}_resolved") for a in attributes])
