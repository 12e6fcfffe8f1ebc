"""Report tables, flattened to (section, ...) rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger import specs
from starledger.operators.links import union_all
from starledger.plans import reports
from starledger.registry import query
from starledger.registry.aggregates import (CONFLICT_COUNTS, FIGHT_ROWS, GRADE_VIEWS, GRADED,
                                            GRAPH_VIEWS, RECOVERY_COUNTS, RUNTIMES, TOTALS, _count_sql,
                                            graph_tables, report_sql)
from starledger.registry.views import Tables, with_views


def _section(name: str, df, key, value):
    return df.select(F.lit(name).alias("section"), key.cast("string").alias("item"),
                     value.cast("bigint").alias("n"))


def _wide(name: str, df):
    """A one-row table as one (section, item, n) row per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("bigint").alias("n"))
                                for c in df.columns])).alias("p")
    return df.select(F.lit(name).alias("section"), pairs).select("section", "p.*")


def _report_counts() -> str:
    """The length of each numeric conflict list, and its largest rows with their detail."""
    parts = []
    for attribute, tolerance in specs.REPORT_TOLERANCE.items():
        eid = "star_id" if attribute in ("teff_k", "rstar_rsun") else "candidate_id"
        owner = "stars o ON o.star_id = eid" if eid == "star_id" else "candidates o ON o.candidate_id = eid"
        found = f"WITH {report_sql(eid, attribute, tolerance)} SELECT * FROM reported"
        parts.append(f"SELECT '{attribute}_count' AS section, 'n' AS item, (SELECT count(*) FROM ({found})) AS n")
        parts.append(f"SELECT '{attribute}_examples', CAST(eid AS VARCHAR), n_src FROM ("
                     f"SELECT * FROM ({found}) "
                     f"ORDER BY (max - min) / max DESC, eid LIMIT {specs.REPORT_EXAMPLES}) JOIN {owner}")
    return " UNION ALL ".join(parts)


@query("r01_conflict_report", with_views(*GRAPH_VIEWS, "vocab", "ledger") + f", {FIGHT_ROWS}" + f"""
    , totals AS (SELECT {TOTALS})
    SELECT 'totals' AS section, item, n FROM (UNPIVOT totals ON COLUMNS(*) INTO NAME item VALUE n)
    UNION ALL SELECT 'disposition_counts', 'fights', count(*) FROM fights
    UNION ALL SELECT 'disposition_counts', 'dramatic', count(*) FROM fights WHERE has_fp AND has_confirmed
    UNION ALL SELECT 'ledger', source || '/' || endpoint, ingest_run_id FROM (
        SELECT DISTINCT ON (source, endpoint) * FROM ledger
        ORDER BY source, endpoint, finished_at DESC NULLS LAST, ingest_run_id DESC)
    UNION ALL SELECT 'dramatic_examples', CAST(eid AS VARCHAR), n_dispo FROM (SELECT * FROM fights
        JOIN candidates ON candidate_id = eid WHERE has_fp AND has_confirmed
        ORDER BY n_dispo DESC, eid LIMIT 12)
    UNION ALL SELECT 'fight_examples', eid || ' ' || detail, n_dispo FROM (SELECT * FROM fights
        JOIN candidates ON candidate_id = eid ORDER BY n_dispo DESC, eid LIMIT 12)
    UNION ALL SELECT 'identifiers_by_type', id_type, count(*) FROM identifiers GROUP BY 2
    UNION ALL SELECT 'identifier_breadth', CAST(k AS VARCHAR), count(*) FROM (SELECT star_id,
        count(DISTINCT id_type) AS k FROM identifiers WHERE star_id IS NOT NULL GROUP BY 1) GROUP BY 2
    UNION ALL SELECT 'audit_by_rule', rule_fired, count(*) FROM audit GROUP BY 2
    UNION ALL {_report_counts()}""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = reports.conflict_report(graph_tables(t), specs.vocabulary(spark), t.ledger)
    n, item = F.col("n"), F.lit("n")
    counts = [_section(f"{a}_count", out[f"{a}_count"], item, n) for a in specs.REPORT_TOLERANCE]
    counts += [_section(f"{a}_examples", out[f"{a}_examples"], F.col("eid"), F.col("n_src"))
               for a in specs.REPORT_TOLERANCE]
    return union_all([
        _wide("totals", out["totals"]), _wide("disposition_counts", out["disposition_counts"]),
        _section("ledger", out["ledger"], F.concat_ws("/", "source", "endpoint"),
                 F.col("ingest_run_id")),
        _section("dramatic_examples", out["dramatic_examples"], F.col("eid"), F.col("n_dispo")),
        _section("fight_examples", out["fight_examples"], F.concat_ws(" ", "eid", "detail"), F.col("n_dispo")),
        _section("identifiers_by_type", out["identifiers_by_type"], F.col("id_type"), n),
        _section("identifier_breadth", out["identifier_breadth"], F.col("n_types"), F.col("stars")),
        _section("audit_by_rule", out["audit_by_rule"], F.col("rule_fired"), n), *counts])


@query("r02_recovery_report", with_views(*GRADE_VIEWS) + f", {GRADED}, {RUNTIMES}" + f"""
    , newest_run AS (SELECT DISTINCT ON (target_id) * FROM runs ORDER BY target_id, pipeline_run_id DESC),
    counts AS (SELECT {RECOVERY_COUNTS}),
    tested AS (SELECT t.target_id, best_period, best_snr, len(list_filter([1e0, 2e0, 0.5e0, 3e0,
        1e0 / 3e0, 1.5e0, 2e0 / 3e0], lambda h: best_period > 0 AND known_period_days > 0
        AND abs(best_period - known_period_days * h) / (known_period_days * h) <= 0.01e0)) > 0 AS hit
        FROM targets t LEFT JOIN strongest USING (target_id) WHERE cohort = 'gold_fp')
    SELECT 'counts' AS section, item, NULL AS word, CAST(n AS DOUBLE) AS value
        FROM (UNPIVOT counts ON COLUMNS(*) INTO NAME item VALUE n)
    UNION ALL SELECT 'planets', CAST(t.target_id AS VARCHAR), coalesce(r.method, 'MISS'), round(r.snr, 6)
        FROM targets t LEFT JOIN recovered r USING (target_id) WHERE t.cohort = 'gold_planet'
    UNION ALL SELECT 'methods', method, NULL, count(DISTINCT target_id) FROM graded
        WHERE cohort = 'gold_planet' AND harmonic IS NOT NULL AND snr >= 7 GROUP BY 2
    UNION ALL SELECT 'false_positives', CAST(target_id AS VARCHAR), CASE WHEN hit THEN 'signal@catalog-P'
        WHEN best_snr >= 7 THEN 'signal' ELSE 'no signal' END, round(best_snr, 6) FROM tested
    UNION ALL SELECT 'failures', CAST(target_id AS VARCHAR), status || ': ' || newest_run.notes, NULL
        FROM targets JOIN newest_run USING (target_id) WHERE status <> 'ok'
    UNION ALL SELECT 'discovery', CAST(target_id AS VARCHAR), CAST(coalesce(event_snr, 0) >= 7
        OR coalesce(best_snr, 0) >= 7 AS VARCHAR), round(event_snr, 6) FROM targets
        LEFT JOIN strongest USING (target_id) LEFT JOIN event USING (target_id) WHERE cohort = 'discovery'
    UNION ALL SELECT 'runtimes', 'median_s', NULL, round(CAST(r[len(r) // 2 + 1] AS DOUBLE), 6) FROM timed
    UNION ALL SELECT 'runtimes', 'max_s', NULL, round(CAST(r[-1] AS DOUBLE), 6) FROM timed""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = reports.recovery_report(t.targets, t.runs, t.detections)
    none = F.lit(None).cast("string")

    def rows(name, df, item, word, value):
        return df.select(F.lit(name).alias("section"), item.cast("string").alias("item"),
                         word.cast("string").alias("word"), F.round(value.cast("double"), 6).alias("value"))

    counts = _wide("counts", out["counts"])
    times = out["runtimes"]
    return union_all([
        rows("counts", counts, F.col("item"), none, F.col("n")),
        rows("planets", out["planets"], F.col("target_id"), F.coalesce("method", F.lit("MISS")), F.col("snr")),
        rows("methods", out["methods"], F.col("method"), none, F.col("recovered")),
        rows("false_positives", out["false_positives"], F.col("target_id"), F.col("verdict"), F.col("best_snr")),
        rows("failures", out["failures"], F.col("target_id"), F.concat("status", F.lit(": "), "why"), F.lit(None)),
        rows("discovery", out["discovery"], F.col("target_id"), F.col("credible"), F.col("event_snr")),
        rows("runtimes", times, F.lit("median_s"), none, F.col("median_s")),
        rows("runtimes", times, F.lit("max_s"), none, F.col("max_s"))])


@query("r03_catalog_stats", with_views(*GRAPH_VIEWS, "vocab", "ledger") + _count_sql() + f"""
    , totals AS (SELECT {TOTALS}), counts AS (SELECT {CONFLICT_COUNTS})
    SELECT 'totals' AS section, item, n FROM (UNPIVOT totals ON COLUMNS(*) INTO NAME item VALUE n)
    UNION ALL SELECT 'conflicts', item, n FROM (UNPIVOT counts ON COLUMNS(*) INTO NAME item VALUE n)
    UNION ALL SELECT 'ingest_runs', source || '/' || endpoint, ingest_run_id FROM (
        SELECT DISTINCT ON (source, endpoint) * FROM ledger WHERE source IN ('exofop', 'nea')
        ORDER BY source, endpoint, started_at DESC NULLS LAST, ingest_run_id DESC)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = reports.catalog_stats(graph_tables(t), specs.vocabulary(spark), t.ledger)
    return union_all([
        _wide("totals", out["totals"]), _wide("conflicts", out["conflicts"]),
        _section("ingest_runs", out["ingest_runs"], F.concat_ws("/", "source", "endpoint"),
                 F.col("ingest_run_id"))])
