"""Claims: what each source says about each attribute, attached through the crosswalk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.numeric import percent_to_ppm
from starledger.functions.text import decimal_text, solution_type
from starledger.operators.links import union_all

CLAIM_ORDER = ["observed_at", "ingest_run_id", "source_key", "raw_id"]


@dataclass(frozen=True)
class ClaimSource:
    """Where one source's claims come from and how its rows find their entity."""

    source: str
    table: str
    owner: str           # candidate or star
    key: str             # column with the source's own key, which is also the identifier value
    id_type: str
    asserted_by: str
    reference: str | None = None


# --- fixed values: (attribute, unit) claimed per level, and which sources claim them --------------
CANDIDATE_UNITS = [("period_days", "days"), ("planet_radius_re", "R_earth"), ("depth_ppm", "ppm"),
                   ("duration_hr", "hr"), ("epoch_bjd", "bjd"), ("disposition", None)]
STAR_UNITS = [("teff_k", "K"), ("logg", "log_cgs"), ("rstar_rsun", "R_sun"), ("vmag", "mag"),
              ("tmag", "mag")]
CLAIM_SOURCES = [
    ClaimSource("exofop_toi", "raw_exofop_toi", "candidate", "toi", "toi", "exofop"),
    ClaimSource("nea_toi", "raw_nea_toi", "candidate", "toi", "toi", "nea"),
    ClaimSource("exofop_ctoi", "raw_exofop_ctoi", "candidate", "ctoi", "ctoi", "exofop"),
    ClaimSource("koi", "raw_koi_cumulative", "candidate", "kepoi_name", "koi", "nea"),
    ClaimSource("ps", "raw_ps", "candidate", "pl_name", "name", "nea", "pl_refname"),
    ClaimSource("pscomppars", "raw_pscomppars", "candidate", "pl_name", "name", "nea"),
    ClaimSource("exofop_toi", "raw_exofop_toi", "star", "tic_id", "tic", "exofop"),
    ClaimSource("nea_toi", "raw_nea_toi", "star", "tid", "tic", "nea"),
    ClaimSource("ps", "raw_ps", "star", "tic_id", "tic", "nea", "st_refname"),
    ClaimSource("pscomppars", "raw_pscomppars", "star", "tic_id", "tic", "nea"),
    ClaimSource("koi", "raw_koi_cumulative", "star", "kepid", "kic", "nea"),
]
STAR_ATTRIBUTES = {
    "exofop_toi": ["teff_k", "logg", "rstar_rsun", "tmag"],
    "nea_toi": ["teff_k", "logg", "rstar_rsun", "tmag"],
    "koi": ["teff_k", "logg", "rstar_rsun"],
    "ps": ["teff_k", "logg", "rstar_rsun", "vmag", "tmag"],
    "pscomppars": ["teff_k", "logg", "rstar_rsun", "vmag", "tmag"],
}
DISPOSITION_COLUMN = {"exofop_toi": "tfopwg_disposition", "nea_toi": "tfopwg_disp",
                      "exofop_ctoi": "user_disposition", "koi": "koi_disposition"}


def _value(source: str, attribute: str) -> Column:
    if attribute == "disposition":
        if source == "ps":
            return solution_type(F.col("pl_controv_flag"), F.col("soltype"))
        if source == "pscomppars":
            return F.lit("CONFIRMED")
        return F.col(DISPOSITION_COLUMN[source])
    if attribute == "depth_ppm" and source in ("ps", "pscomppars"):
        return decimal_text(percent_to_ppm(F.col("depth_pct")).cast("decimal(28,10)"))
    return decimal_text(F.col(attribute))


def _attributes(spec: ClaimSource) -> list[tuple[str, str | None]]:
    if spec.owner == "candidate":
        return CANDIDATE_UNITS
    return [(a, u) for a, u in STAR_UNITS if a in STAR_ATTRIBUTES[spec.source]]


def claim_rows(raw: DataFrame, spec: ClaimSource) -> DataFrame:
    """One row per raw row with the identifier it is found by and everything it says."""
    reference = F.col(spec.reference) if spec.reference else F.lit(None)
    said = F.array(*[
        F.struct(F.lit(a).alias("attribute"), _value(spec.source, a).cast("string").alias("value"),
                 F.lit(u).cast("string").alias("unit"))
        for a, u in _attributes(spec)])
    return raw.select(
        F.lit(spec.owner).alias("owner"), F.lit(spec.id_type).alias("id_type"),
        F.lit(spec.asserted_by).alias("asserted_by"),
        F.col(spec.key).cast("string").alias("source_key"), F.lit(spec.source).alias("source"),
        F.filter(said, lambda s: s["value"].isNotNull()).alias("said"),
        reference.cast("string").alias("source_ref"), F.col("loaded_at").alias("observed_at"),
        "ingest_run_id", "raw_id")


def attach_claims(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Claims of all rows: one join to the crosswalk, then the unpivot.

    Joining before the unpivot ships each raw row once instead of once per attribute.  A value
    attached to several entities yields a claim for each of them.
    """
    owners = crosswalk.select(
        F.when(F.col("star_id").isNotNull(), "star").otherwise("candidate").alias("owner"),
        "id_type", F.col("source").alias("asserted_by"), F.col("id_value").alias("source_key"),
        "star_id", "candidate_id")
    return (rows.join(owners, ["owner", "id_type", "asserted_by", "source_key"])
            .withColumn("_claim", F.explode("said"))
            .select("star_id", "candidate_id", "source_key", "_claim.*", "source", "source_ref",
                    "observed_at", "ingest_run_id", "raw_id"))


def claims_of(raw: DataFrame, crosswalk: DataFrame, spec: ClaimSource) -> DataFrame:
    """Claims of one source about one kind of entity."""
    return attach_claims(claim_rows(raw, spec), crosswalk)


def all_claims(raw_tables: dict[str, DataFrame], crosswalk: DataFrame) -> DataFrame:
    """Claims of every source present in ``raw_tables``, in a single join."""
    return attach_claims(union_all([claim_rows(raw_tables[spec.table], spec)
                                    for spec in CLAIM_SOURCES if spec.table in raw_tables]),
                         crosswalk)
