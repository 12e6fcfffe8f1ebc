"""Identifier links: who owns which identifier, by which rule, with the audit derived from it.

A *link* row carries the crosswalk columns plus the rule, score and extra detail that produced
it.  The crosswalk and the audit log are both projections of the same link rows, so every link
has exactly one audit row by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.text import detail_json

LINK_KEY = ["id_type", "id_value", "source", "star_id", "candidate_id"]
LINK_COLUMNS = ["star_id", "candidate_id", "id_type", "id_value", "source", "confidence",
                "rule", "score", "sep_arcsec"]

# --- fixed values: rule names in the audit log ---------------------------------------------------
TIC_EXACT = "tic_exact"
CATALOG_XREF = "catalog_xref"
HOSTNAME_NEW_STAR = "hostname_new_star"
COORD_MATCH = "coord_match<2arcsec"
KOI_NEW_STAR = "koi_new_star"
CANDIDATE_SEED = "candidate_seed"
PERIOD_MATCH = "period_match<1pct"
PERIOD_AMBIGUOUS = "period_ambiguous"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def links(rows: DataFrame, owner: str, rule: Column | str, score: Column | float = 1.0,
          confidence: Column | float = 1.0, sep: Column | None = None) -> DataFrame:
    """Shape (owner id, id_type, id_value, source) rows into link rows."""
    def as_column(v):
        return v if isinstance(v, Column) else F.lit(v)

    null_id = F.lit(None).cast("bigint")
    return rows.select(
        (F.col("star_id") if owner == "star" else null_id).cast("bigint").alias("star_id"),
        (F.col("candidate_id") if owner == "candidate" else null_id).cast("bigint")
        .alias("candidate_id"),
        "id_type", F.col("id_value").cast("string").alias("id_value"), "source",
        as_column(confidence).cast("decimal(3,2)").alias("confidence"),
        as_column(rule).alias("rule"),
        as_column(score).cast("decimal(4,3)").alias("score"),
        (sep if sep is not None else F.lit(None)).cast("double").alias("sep_arcsec"))


def tic_links(stars: DataFrame, sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Exact TIC links: distinct (tic, asserting system) of every source, joined to the stars."""
    seen = union_all([
        df.filter(F.col(col).isNotNull()).select(F.col(col).cast("bigint").alias("tic_id"),
                                                 F.lit(tag).alias("source"))
        for df, col, tag in sources]).distinct()
    owned = seen.join(stars.select("star_id", "tic_id"), "tic_id")
    return links(owned.select("star_id", F.lit("tic").alias("id_type"),
                              F.col("tic_id").cast("string").alias("id_value"), "source"),
                 "star", TIC_EXACT)


def secondary_links(stars: DataFrame, rows: DataFrame, columns: dict[str, str],
                    source: str = "nea") -> DataFrame:
    """Links of the other identifiers carried by rows with a TIC; blanks dropped.

    ``columns`` maps id_type to the column that holds it.  One unpivot, one distinct, one join.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(id_type).alias("id_type"), F.col(col).alias("id_value"))
        for id_type, col in columns.items()])).alias("_id")
    named = (rows.filter(F.col("tic_id").isNotNull()).select("tic_id", pairs)
             .select("tic_id", "_id.*")
             .filter(F.col("id_value").isNotNull() & (F.col("id_value") != ""))
             .distinct())
    owned = named.join(stars.select("star_id", "tic_id"), "tic_id")
    return links(owned.withColumn("source", F.lit(source)), "star", CATALOG_XREF)


def hosts_without_star(rows: DataFrame, star_names: DataFrame) -> DataFrame:
    """Host rows without a TIC whose name no star carries (``star_names``: one column, hostname)."""
    bare = rows.filter(F.col("tic_id").isNull() & F.col("hostname").isNotNull()
                       & (F.col("hostname") != ""))
    return bare.join(star_names, "hostname", "left_anti")


def drop_existing(new: DataFrame, existing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Set-semantics insert: distinct new keys that are not there yet (NULLs compare equal)."""
    keys = keys or LINK_KEY
    fresh = new.dropDuplicates(keys)
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return fresh.join(old, same, "left_anti")


def crosswalk(link_rows: DataFrame) -> DataFrame:
    return link_rows.select("star_id", "candidate_id", "id_type", "id_value", "source",
                            "confidence")


def audit_of_links(link_rows: DataFrame) -> DataFrame:
    """One audit row per link; a link survives and merges into the entity it attached to."""
    owner = F.coalesce("star_id", "candidate_id")
    return link_rows.select(
        F.when(F.col("star_id").isNotNull(), "star").otherwise("candidate").alias("entity_type"),
        owner.alias("surviving_id"), owner.alias("merged_id"),
        F.col("rule").alias("rule_fired"), "score",
        detail_json(id_type=F.col("id_type"), id_value=F.col("id_value"),
                    source=F.col("source"),
                    sep_arcsec=F.round("sep_arcsec", 4)).alias("details"))


def audit_of_ambiguous(flagged: DataFrame) -> DataFrame:
    """One audit row per designation that was *not* merged; its score is NULL."""
    return flagged.select(
        F.lit("candidate").alias("entity_type"),
        F.col("star_id").alias("surviving_id"), F.col("star_id").alias("merged_id"),
        F.lit(PERIOD_AMBIGUOUS).alias("rule_fired"),
        F.lit(None).cast("decimal(4,3)").alias("score"),
        detail_json(designation=F.concat_ws(":", "id_type", "id_value"),
                    period_days=F.col("period"),
                    competing_seed_designations=F.col("competing")).alias("details"))


def audit_gap(link_rows: DataFrame, flagged: DataFrame, audit: DataFrame) -> DataFrame:
    """One row if the audit does not hold exactly one row per link and per flagged non-merge."""
    expected = (link_rows.select(F.lit(1).alias("_want"))
                .unionByName(flagged.select(F.lit(1).alias("_want")))
                .unionByName(audit.select(F.lit(-1).alias("_want"))))
    return expected.agg(F.sum("_want").cast("bigint").alias("gap")).filter(F.col("gap") != 0)


def bad_owner(link_rows: DataFrame) -> DataFrame:
    """Links that do not have exactly one owner; must stay empty."""
    return link_rows.filter(F.col("star_id").isNull() == F.col("candidate_id").isNull())


def attach_star(observations: DataFrame, tic_stars: DataFrame, kic_stars: DataFrame,
                host_stars: DataFrame) -> DataFrame:
    """Observation rows with the star they belong to.

    ``tic_stars`` (tic_id, star_id), ``kic_stars`` (kepid, star_id) and ``host_stars`` (hostname,
    star_id; only stars without a TIC).  A TIC wins over the host-name fallback.  Rows without a
    star, or with a blank designation, drop out.
    """
    named = observations.filter(F.col("id_value").isNotNull() & (F.col("id_value") != ""))
    return (named
            .join(tic_stars.select("tic_id", F.col("star_id").alias("_by_tic")), "tic_id", "left")
            .join(kic_stars.select("kepid", F.col("star_id").alias("_by_kic")), "kepid", "left")
            .join(host_stars.select("hostname", F.col("star_id").alias("_by_host")), "hostname",
                  "left")
            .withColumn("star_id", F.coalesce("_by_tic", "_by_kic", "_by_host"))
            .drop("_by_tic", "_by_kic", "_by_host")
            .filter(F.col("star_id").isNotNull()))
