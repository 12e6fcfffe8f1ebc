"""Target dossiers for a whole table of targets, one row per fact.

Each section is a DataFrame of facts keyed by ``target_id``: nothing is nested, so a target with
many claims never has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import clean_reference, to_number
from starledger.session import cut_lineage


def identity(targets: DataFrame, candidates: DataFrame, stars: DataFrame) -> DataFrame:
    """Candidate and star columns of each target (``targets``: candidate_id)."""
    hosts = stars.select("star_id", F.col("canonical_name").alias("host"), "tic_id",
                         *[c for c in ("ra_deg", "dec_deg", "teff_k", "logg", "rstar_rsun")
                           if c in stars.columns])
    return (candidates.join(targets.select("candidate_id").distinct(), "candidate_id", "left_semi")
            .withColumnRenamed("canonical_name", "target").join(hosts, "star_id"))


def _owned(targets: DataFrame, facts: DataFrame, level: str) -> DataFrame:
    """``facts`` of each target itself and of its star, with ``level`` saying whose they are.

    ``targets`` (candidate_id, star_id).  Both sides are spread over (owner level, owner id) keys and
    meet in one equi-join: an OR in the condition would rule out hashing, two joins would read the
    facts twice.
    """
    def keys(columns):
        return F.explode(F.array(*[F.struct(F.lit(name).alias("level"), F.col(c).cast("bigint").alias("id"))
                                   for name, c in columns])).alias("_key")

    pairs = [("candidate", "candidate_id"), ("star", "star_id")]
    rest = [c for c in facts.columns if c not in ("candidate_id", "star_id")]
    owners = targets.select(F.col("candidate_id").alias("target_id"), keys(pairs)).filter("_key.id IS NOT NULL")
    held = facts.select(*rest, keys(pairs)).filter("_key.id IS NOT NULL")
    return (owners.select("target_id", F.col("_key.level").alias(level), F.col("_key.id").alias("_id"))
            .join(held.select(*rest, F.col("_key.level").alias(level), F.col("_key.id").alias("_id")),
                  [level, "_id"]).select("target_id", level, *rest))


def identifiers(targets: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Identifiers a target owns itself or through its star (``targets``: candidate_id, star_id)."""
    return _owned(targets, crosswalk.select(
        "candidate_id", "star_id", "id_type", "id_value", "source", "confidence"), "owner")


def claims_with_words(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Claims with the canonical disposition where there is one; other attributes untouched."""
    words = vocabulary.select(F.lit("disposition").alias("attribute"), "source",
                              F.col("source_value").alias("value"),
                              F.col("canonical").alias("canonical_disposition"))
    return claims.join(words, ["attribute", "source", "value"], "left")


def target_claims(targets: DataFrame, claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every claim about a target or its star, canonical words and clean citations included.

    Words and citations are worked out for the targets' claims only.
    """
    owned = _owned(targets, claims.select(
        "candidate_id", "star_id", "attribute", "source", "value", "unit", "source_ref", "observed_at"), "claim_level")
    return (claims_with_words(owned, vocabulary).withColumn("source_ref", clean_reference(F.col("source_ref")))
            .select("target_id", "claim_level", "attribute", "source", "value", "unit", "source_ref", "observed_at",
                    "canonical_disposition"))


def attribute_flags(said: DataFrame, axes: DataFrame) -> DataFrame:
    """(target_id, attribute, ..., n_claims, conflict, axis_rank): does anyone disagree?

    A numeric attribute conflicts when two sources give numbers whose relative spread exceeds the
    attribute's threshold; a disposition when two canonical words are claimed.  Attributes without
    an axis use the default threshold; axes without a threshold never conflict.
    """
    number = to_number(F.col("value"))
    numeric_source = F.when(number.isNotNull(), F.col("source"))
    rolled = said.groupBy("target_id", "attribute").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.min(number).alias("mn"), F.max(number).alias("mx"),
        (F.min(numeric_source) != F.max(numeric_source)).alias("several_sources"),
        (F.min("canonical_disposition") != F.max("canonical_disposition")).alias("several_words"),
        F.min("claim_level").alias("claim_level"))
    known = F.col("axis_rank").isNotNull()
    threshold = F.when(known, F.col("threshold")).otherwise(
        F.lit(specs.UNKNOWN_AXIS_THRESHOLD))
    spread = F.when(F.col("mx") > 0, (F.col("mx") - F.col("mn")) / F.col("mx"))
    numeric = F.col("several_sources") & (F.col("mn") != F.col("mx")) & (spread > threshold)
    conflict = F.when(F.col("kind") == "disposition", F.col("several_words")).otherwise(numeric)
    return (rolled.join(axes, "attribute", "left")
            .select("target_id", "attribute",
                    F.coalesce("level", "claim_level").alias("level"), "unit",
                    F.coalesce("kind", F.lit("numeric")).alias("kind"), "n_claims",
                    F.coalesce(conflict, F.lit(False)).alias("conflict"),
                    F.coalesce("axis_rank", F.lit(specs.UNKNOWN_AXIS_RANK)).alias("axis_rank")))


def display_order(flags: DataFrame) -> DataFrame:
    """Conflicts first, then the fixed axis order, unknown attributes last."""
    return flags.orderBy("target_id", F.col("conflict").desc(), "axis_rank", "attribute")


def with_resolved(flags: DataFrame, facts: DataFrame) -> DataFrame:
    """Flags with the graph's resolved value (as text) where the graph holds one.

    ``facts`` is :func:`identity`; the unpivot gives a handful of rows per target.
    """
    held = [c for c in ("disposition", "period_days", "planet_radius_re", "teff_k", "logg",
                        "rstar_rsun") if c in facts.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"),
                                         F.col(c).cast("string").alias("resolved"))
                                for c in held])).alias("_p")
    long = facts.select(F.col("candidate_id").alias("target_id"), pairs).select(
        "target_id", "_p.*")
    return flags.join(long, ["target_id", "attribute"], "left")


def siblings(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Other candidates of each target's star (``targets``: candidate_id, star_id)."""
    asked = targets.select(F.col("candidate_id").alias("target_id"), "star_id")
    return (asked.join(candidates.select("star_id", "candidate_id", "canonical_name",
                                         "disposition"), "star_id")
            .filter(F.col("candidate_id") != F.col("target_id"))
            .select("target_id", "candidate_id", "canonical_name", "disposition"))


def claims_by_source(said: DataFrame) -> DataFrame:
    """(target, attribute, source): numeric range, claim count, dispositions, first citation.

    "First" follows the newest observation.  The set of words is as small as the vocabulary.
    """
    number = to_number(F.col("value"))
    finite = F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)
    return said.groupBy("target_id", "attribute", "source").agg(
        F.min(finite).alias("numeric_min"), F.max(finite).alias("numeric_max"),
        F.count(F.lit(1)).alias("n_claims"),
        F.array_sort(F.collect_set("canonical_disposition")).alias("dispositions"),
        F.expr("max_by(source_ref, (observed_at, source_ref)) "
               "FILTER (WHERE source_ref <> '')").alias("first_reference"))


def identifiers_by_source(owned: DataFrame) -> DataFrame:
    """(target, source): how many identifiers each source contributes, by kind."""
    return owned.groupBy("target_id", "source").agg(
        F.count(F.lit(1)).alias("n_identifiers"),
        F.array_sort(F.collect_set("id_type")).alias("id_types"))


def dossier(targets: DataFrame, candidates: DataFrame, stars: DataFrame, crosswalk: DataFrame,
            claims: DataFrame, vocabulary: DataFrame, axes: DataFrame) -> dict[str, DataFrame]:
    """All sections for a table of targets (column candidate_id)."""
    facts = identity(targets, candidates, stars)
    keyed = facts.select("candidate_id", "star_id")
    said = cut_lineage(target_claims(keyed, claims, vocabulary), "said")  # two sections read it
    flags = with_resolved(attribute_flags(said, axes), facts)
    return {"identity": facts, "identifiers": identifiers(keyed, crosswalk), "claims": said,
            "attributes": flags, "siblings": siblings(keyed, candidates)}


def conflicts_only(sections: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dossier reduced to the attributes somebody disagrees about."""
    attributes = sections["attributes"].filter("conflict")
    claims = sections["claims"].join(attributes.select("target_id", "attribute"),
                                     ["target_id", "attribute"], "left_semi")
    summary = sections["identity"].select(
        F.col("candidate_id").alias("target_id"), "target", "host").join(
        attributes.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_conflicts")),
        "target_id", "left").select(
        "target_id", "target", "host", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))
    return {"summary": summary, "attributes": attributes, "claims": claims}
