"""Report tables: catalog statistics, the conflict report, the recovery report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import conflicts as cf
from starledger.operators import grading as gr
from starledger.operators.picks import last_per_endpoint
from starledger.session import cut_lineage

CATALOG_SOURCES = ["exofop", "nea"]


def catalog_stats(tables: dict[str, DataFrame], vocabulary: DataFrame,
                  ledger: DataFrame) -> dict[str, DataFrame]:
    """Totals, conflict counts and the last load of every catalog endpoint.

    The ledger also holds per-target photometry loads; only the catalog sources are listed.
    """
    return {"totals": cf.table_counts(tables),
            "conflicts": cf.conflict_counts(tables["source_assertion"], vocabulary),
            "ingest_runs": last_per_endpoint(ledger, "started_at", CATALOG_SOURCES)}


def _examples(rows: DataFrame, order) -> DataFrame:
    return rows.orderBy(*order).limit(specs.REPORT_EXAMPLES)


def conflict_report(tables: dict[str, DataFrame], vocabulary: DataFrame,
                    ledger: DataFrame) -> dict[str, DataFrame]:
    """Every table of the conflict report; example lists are its fixed top twelve.

    ``tables`` as in :meth:`starledger.plans.graph.Graph.tables`.
    """
    claims, crosswalk = tables["source_assertion"], tables["entity_identifier"]
    candidates, stars = tables["candidate"], tables["star"]
    out = {"totals": cf.table_counts(tables),
           "ledger": last_per_endpoint(ledger, "finished_at")}
    star_level = ("teff_k", "rstar_rsun")
    levels = {a: "star_id" if a in star_level else "candidate_id" for a in specs.REPORT_TOLERANCE}
    # The claims are read once; what follows reads a row per entity, attribute and source, then conflicts only.
    digest = cut_lineage(cf.claim_digest(claims, vocabulary, levels), "digest")
    fights = cut_lineage(cf.disposition_fights(digest.filter("attribute = 'disposition'").select(
        "eid", "source", F.explode("canons").alias("canon"))), "fights")
    dramatic = fights.filter("has_fp AND has_confirmed")
    most_words = [F.col("n_dispo").desc(), F.col("eid")]
    out["disposition_counts"] = fights.agg(
        F.count(F.lit(1)).alias("fights"),
        F.count(F.when(F.col("has_fp") & F.col("has_confirmed"), 1)).alias("dramatic"))
    out["dramatic_examples"] = cf.label_few(_examples(dramatic, most_words), candidates, stars)
    out["fight_examples"] = cf.label_few(_examples(fights, most_words), candidates, stars)
    largest = [F.col("spread").desc(), F.col("eid")]
    reported = cut_lineage(cf.report_tables(digest, specs.REPORT_TOLERANCE), "reported")
    for attribute in specs.REPORT_TOLERANCE:
        found = reported.filter(F.col("attribute") == attribute).drop("attribute")
        out[f"{attribute}_count"] = found.agg(F.count(F.lit(1)).alias("n"))
        top = _examples(found, largest)
        if attribute in star_level:
            hosts = stars.select(F.col("star_id").alias("eid"),
                                 F.col("canonical_name").alias("host"), "tic_id")
            out[f"{attribute}_examples"] = hosts.join(F.broadcast(top), "eid")     # twelve rows
        else:
            out[f"{attribute}_examples"] = cf.label_few(top, candidates, stars)
    out["identifiers_by_type"] = cf.count_by(crosswalk, "id_type")
    out["identifier_breadth"] = cf.identifier_breadth(crosswalk)
    out["audit_by_rule"] = cf.count_by(tables["merge_log"], "rule_fired")
    return out


def recovery_report(targets: DataFrame, runs: DataFrame,
                    detections: DataFrame) -> dict[str, DataFrame]:
    """Every table of the recovery report."""
    current = gr.current_detections(runs, detections)
    return {"counts": gr.recovery_counts(targets, runs, current),
            "planets": gr.planet_table(targets, current),
            "methods": gr.method_credit(targets, current),
            "false_positives": gr.false_positive_table(targets, current),
            "discovery": gr.discovery_table(targets, current),
            "failures": gr.failure_table(targets, runs),
            "runtimes": gr.runtime_summary(runs)}
