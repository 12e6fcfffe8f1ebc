"""The identity graph build: raw catalogs to stars, candidates, links, audit, claims, winners."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import host_of_planet
from starledger.operators import designations as dz
from starledger.operators import links as lk
from starledger.operators import picks, resolution
from starledger.operators.claims import all_claims
from starledger.operators.conflicts import count_by, table_counts
from starledger.operators.ids import with_dense_id
from starledger.operators.skymatch import match_confidence, match_score, nearest_star, split_probes
from starledger.session import cut_lineage

SECONDARY_IDS = {"gaia_dr3": "gaia_id", "hd": "hd_name", "hip": "hip_name", "name": "hostname"}


class Graph:
    """Every derived table of one build.

    Stars, clusters, links and the audit are there from the start; claims and the resolved rows are
    written when they are first asked for, so a question about the links does not pay for them.
    """

    def __init__(self, raw: dict[str, DataFrame], star_rows: DataFrame, candidate_rows: DataFrame,
                 links: DataFrame, ambiguous: DataFrame, vocabulary: DataFrame, precedence: DataFrame):
        self.raw, self.star_rows, self.candidate_rows = raw, star_rows, candidate_rows
        self.links, self.ambiguous = links, ambiguous
        self.vocabulary, self.precedence = vocabulary, precedence

    @cached_property
    def audit(self) -> DataFrame:
        return lk.audit_of_links(self.links).unionByName(lk.audit_of_ambiguous(self.ambiguous))

    def claim_rows(self) -> DataFrame:
        """The claims as a plan: who reads them once need not write them, many rows per raw row, first."""
        return all_claims(self.raw, self.crosswalk())

    @cached_property
    def claims(self) -> DataFrame:
        return cut_lineage(self.claim_rows(), "claims")

    @cached_property
    def _last_of_candidates(self) -> DataFrame:
        return resolution.last_per_source(self.claims, "candidate_id")

    @cached_property
    def votes(self) -> DataFrame:
        return resolution.disposition_votes(self._last_of_candidates, self.precedence, self.vocabulary)

    @cached_property
    def candidates(self) -> DataFrame:
        return cut_lineage(resolution.write_winners(
            self.candidate_rows.drop("seed_type", "seed_value"), "candidate_id",
            resolution.pick_numeric(self._last_of_candidates, self.precedence),
            specs.RESOLVED_CANDIDATE_ATTRIBUTES, resolution.resolve_dispositions(self.votes)), "candidates")

    @cached_property
    def stars(self) -> DataFrame:
        picked = resolution.pick_numeric(resolution.last_per_source(self.claims, "star_id"), self.precedence)
        return cut_lineage(resolution.write_winners(
            self.star_rows.drop("pass"), "star_id", picked, specs.RESOLVED_STAR_ATTRIBUTES), "stars")

    def crosswalk(self) -> DataFrame:
        return lk.crosswalk(self.links)

    def tables(self) -> dict[str, DataFrame]:
        return {"star": self.stars, "candidate": self.candidates,
                "entity_identifier": self.crosswalk(), "source_assertion": self.claims,
                "merge_log": self.audit}


def snapshots(raw: dict[str, DataFrame], ledger: DataFrame) -> dict[str, DataFrame]:
    """The newest closed snapshot of every raw table."""
    return {name: picks.latest_snapshot(df, ledger) for name, df in raw.items()}


def star_observations(raw: dict[str, DataFrame]) -> DataFrame:
    """(tic, hostname, ra, dec) of all five sources that carry a TIC.

    Only some of them give a host name or coordinates; the rest contribute the TIC alone.
    """
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def rows(table: str, tic: str, host: Column, placed: bool) -> DataFrame:
        df = raw[table].filter(F.col(tic).isNotNull())
        return df.select(F.col(tic).cast("bigint").alias("tic"), host.alias("hostname"),
                         (F.col("ra_deg").cast("double") if placed else no_number).alias("ra"),
                         (F.col("dec_deg").cast("double") if placed else no_number).alias("dec"))

    host = F.col("hostname")
    wanted = [("raw_exofop_ctoi", "tic_id", no_text, True), ("raw_nea_toi", "tid", no_text, True),
              ("raw_exofop_toi", "tic_id", no_text, False), ("raw_ps", "tic_id", host, True),
              ("raw_pscomppars", "tic_id", host, True)]
    return lk.union_all([rows(*w) for w in wanted if w[0] in raw])


def host_rows(raw: dict[str, DataFrame]) -> DataFrame:
    return lk.union_all([
        raw[t].select(F.col("tic_id").cast("bigint").alias("tic_id"), "hostname",
                      F.col("ra_deg").cast("double").alias("ra"),
                      F.col("dec_deg").cast("double").alias("dec"),
                      *[F.col(c) for c in ("gaia_id", "hd_name", "hip_name")])
        for t in ("raw_ps", "raw_pscomppars") if t in raw])


def build_catalog_stars(raw: dict[str, DataFrame]) -> DataFrame:
    """Stars with a TIC, then name-only hosts, numbered in that order."""
    by_tic = picks.star_per_tic(star_observations(raw)).select(
        F.lit(1).alias("pass"), F.col("tic").alias("tic_id"),
        F.coalesce("hostname", F.concat(F.lit("TIC "), F.col("tic").cast("string")))
        .alias("canonical_name"), F.col("ra").alias("ra_deg"), F.col("dec").alias("dec_deg"))
    hosts = host_rows(raw)
    named = hosts.filter(F.col("tic_id").isNotNull() & (F.col("hostname") != "")).select(
        "hostname").distinct()
    bare = picks.row_per_hostname(
        lk.hosts_without_star(hosts, named).select("hostname", "ra", "dec")).select(
        F.lit(2).alias("pass"), F.lit(None).cast("bigint").alias("tic_id"),
        F.col("hostname").alias("canonical_name"), F.col("ra").alias("ra_deg"),
        F.col("dec").alias("dec_deg"))
    return with_dense_id(by_tic.unionByName(bare), "star_id", ["pass", "tic_id", "canonical_name"])


def match_kois(raw: dict[str, DataFrame], stars: DataFrame,
               tol_arcsec: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new stars, links of matched hosts, links of new stars) for Kepler hosts."""
    koi = picks.row_per_kepid(
        raw["raw_koi_cumulative"].filter(F.col("kepid").isNotNull()).select(
            "kepid", "kepler_name", F.col("ra_deg").cast("double").alias("ra_deg"),
            F.col("dec_deg").cast("double").alias("dec_deg")))
    matches = cut_lineage(nearest_star(stars, koi, "kepid", tol_arcsec=tol_arcsec))
    matched, unmatched = split_probes(koi, matches, "kepid")

    def as_kic(df: DataFrame) -> DataFrame:
        return df.withColumns({"id_type": F.lit("kic"), "source": F.lit("nea"),
                               "id_value": F.col("kepid").cast("string")})

    sep = F.col("sep_arcsec")
    matched_links = lk.links(as_kic(matched), "star", lk.COORD_MATCH,
                             match_score(sep, tol_arcsec), match_confidence(sep, tol_arcsec), sep)
    highest = stars.agg(F.coalesce(F.max("star_id"), F.lit(0)).alias("offset"))
    minted = with_dense_id(unmatched.select(
        F.lit(3).alias("pass"), F.lit(None).cast("bigint").alias("tic_id"), "kepid",
        F.coalesce(host_of_planet(F.col("kepler_name")),
                   F.concat(F.lit("KIC "), F.col("kepid").cast("string")))
        .alias("canonical_name"), "ra_deg", "dec_deg"), "star_id", ["kepid"], offset=highest)
    new_links = lk.links(as_kic(minted), "star", lk.KOI_NEW_STAR)
    return minted.drop("kepid"), matched_links, new_links


def star_links(raw: dict[str, DataFrame], stars: DataFrame) -> DataFrame:
    """TIC, secondary and name-only links of the catalog stars."""
    tagged = [("raw_exofop_toi", "tic_id", "exofop"), ("raw_exofop_ctoi", "tic_id", "exofop"),
              ("raw_nea_toi", "tid", "nea"), ("raw_ps", "tic_id", "nea"),
              ("raw_pscomppars", "tic_id", "nea")]
    with_tic = stars.filter(F.col("tic_id").isNotNull())
    exact = lk.tic_links(with_tic, [(raw[t], c, tag) for t, c, tag in tagged if t in raw])
    secondary = lk.secondary_links(with_tic, host_rows(raw), SECONDARY_IDS)
    bare = stars.filter(F.col("pass") == 2).select(
        "star_id", F.lit("name").alias("id_type"), F.col("canonical_name").alias("id_value"),
        F.lit("nea").alias("source"))
    return lk.union_all([exact, secondary, lk.links(bare, "star", lk.HOSTNAME_NEW_STAR)])


def observations(raw: dict[str, DataFrame]) -> DataFrame:
    """Designations of all six sources in one shape, with the order in which sources are read."""
    def rows(df: DataFrame, order: int, id_type: str, value: str, source: str, tic: str | None,
             kepid: str | None = None, host: str | None = None, planet: str | None = None):
        def optional(column, kind):
            return (F.col(column) if column else F.lit(None)).cast(kind)

        return df.filter(F.col(value).isNotNull()).select(
            F.lit(order).alias("source_order"), "raw_id", F.lit(id_type).alias("id_type"),
            F.col(value).cast("string").alias("id_value"), F.lit(source).alias("source"),
            optional(tic, "bigint").alias("tic_id"), optional(kepid, "bigint").alias("kepid"),
            optional(host, "string").alias("hostname"),
            F.col("period_days").alias("period"), optional(planet, "string").alias("planet_name"))

    frames = []
    if "raw_exofop_toi" in raw:
        frames.append(rows(raw["raw_exofop_toi"], 0, "toi", "toi", "exofop", "tic_id"))
    if "raw_nea_toi" in raw:
        frames.append(rows(raw["raw_nea_toi"], 1, "toi", "toi", "nea", "tid"))
    if "raw_exofop_ctoi" in raw:
        frames.append(rows(raw["raw_exofop_ctoi"], 2, "ctoi", "ctoi", "exofop", "tic_id"))
    if "raw_koi_cumulative" in raw:
        frames.append(rows(raw["raw_koi_cumulative"], 3, "koi", "kepoi_name", "nea", None,
                           "kepid", planet="kepler_name"))
    if "raw_ps" in raw:
        default = picks.row_per_planet(
            raw["raw_ps"].filter(F.col("pl_name").isNotNull()).select(
                "pl_name", "default_flag", "period_days", "tic_id", "hostname", "raw_id"))
        frames.append(rows(default, 4, "name", "pl_name", "nea", "tic_id", host="hostname",
                           planet="pl_name"))
    if "raw_pscomppars" in raw:
        frames.append(rows(raw["raw_pscomppars"], 5, "name", "pl_name", "nea", "tic_id",
                           host="hostname", planet="pl_name"))
    return lk.union_all(frames)


def build_graph(raw: dict[str, DataFrame], vocabulary: DataFrame, precedence: DataFrame,
                tol_arcsec: float = specs.SKY_TOLERANCE_ARCSEC) -> Graph:
    """All passes over one set of snapshots.

    Stars, designations, clusters and links are each materialised once: everything after them reads
    them several times.
    """
    catalog_stars = cut_lineage(build_catalog_stars(raw))
    link_frames = [star_links(raw, catalog_stars)]
    stars = catalog_stars
    kic_stars = catalog_stars.sparkSession.createDataFrame([], "kepid bigint, star_id bigint")
    if "raw_koi_cumulative" in raw:
        minted, matched_links, new_links = match_kois(raw, catalog_stars, tol_arcsec)
        stars = catalog_stars.unionByName(minted)
        koi_links = matched_links.unionByName(new_links)
        link_frames.append(koi_links)
        kic_stars = koi_links.select(F.col("id_value").cast("bigint").alias("kepid"), "star_id")
    attached = lk.attach_star(
        observations(raw),
        catalog_stars.filter(F.col("tic_id").isNotNull()).select("tic_id", "star_id"),
        kic_stars,
        catalog_stars.filter(F.col("pass") == 2).select(
            F.col("canonical_name").alias("hostname"), "star_id"))
    clustered = cut_lineage(dz.cluster(cut_lineage(dz.collapse(attached))))
    candidate_rows = dz.candidates(clustered)
    link_frames.append(dz.candidate_links(clustered, candidate_rows))
    links = cut_lineage(lk.union_all(link_frames))
    return Graph(raw, stars, candidate_rows, links, dz.ambiguous(clustered), vocabulary, precedence)


def build_sizes(graph: Graph) -> DataFrame:
    """One row: table sizes and pass statistics of the build itself, before claims and winners."""
    return table_counts({
        "stars": graph.star_rows, "candidates": graph.candidate_rows, "crosswalk_rows": graph.links,
        "merge_log_rows": graph.audit,
        "koi_coord_matched": graph.links.filter(F.col("rule") == lk.COORD_MATCH),
        "koi_new_stars": graph.links.filter(F.col("rule") == lk.KOI_NEW_STAR),
        "ambiguous_period_candidates": graph.ambiguous})


def build_summary(graph: Graph) -> DataFrame:
    """One row: table sizes, pass statistics, resolution coverage, unmapped disposition words."""
    sizes = table_counts({
        "stars": graph.stars, "candidates": graph.candidates, "crosswalk_rows": graph.links,
        "source_assertions": graph.claims, "merge_log_rows": graph.audit,
        "koi_coord_matched": graph.links.filter(F.col("rule") == lk.COORD_MATCH),
        "koi_new_stars": graph.links.filter(F.col("rule") == lk.KOI_NEW_STAR),
        "ambiguous_period_candidates": graph.ambiguous,
        "disposition_resolved": resolution.resolve_dispositions(graph.votes)})
    on_candidates = resolution.coverage(graph.candidates, specs.RESOLVED_CANDIDATE_ATTRIBUTES,
                                        "candidate")
    on_stars = resolution.coverage(graph.stars, specs.RESOLVED_STAR_ATTRIBUTES, "star")
    words = resolution.unmapped_words(graph.votes)
    unmapped = words.agg(F.count(F.lit(1)).alias("unmapped_dispositions"))
    return sizes.select("*", *[one_row.select(c).scalar().alias(c)
                               for one_row in (on_candidates, on_stars, unmapped)
                               for c in one_row.columns])


def audit_by_rule(graph: Graph) -> DataFrame:
    return count_by(graph.audit, "rule_fired")
