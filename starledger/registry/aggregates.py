"""Conflict, provenance, density and summary aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.numeric import rounded
from starledger.operators import conflicts as cf
from starledger.operators import designations as dz
from starledger.operators import dossier as ds
from starledger.operators import grading, orbits, resolution, selection, sightline
from starledger.registry import query
from starledger.registry.joins import (CURRENT, MAPPED, OWNER, OWNERS, SIGHT, numeric_conflict_sql,
                                       representative_targets, sight_tables)
from starledger.registry.snapshots import CURRENT_ELEMENTS
from starledger.registry.views import Tables, with_views
from starledger.sources import lightcurves


def _double(*columns):
    return [F.col(c).cast("double").alias(c) for c in columns]


def _conflict_query(eid: str, attribute: str, threshold: str):
    def run(spark, sf_dir):
        found = cf.numeric_conflicts(Tables(spark, sf_dir).claims, eid, attribute, threshold)
        return found.select("eid", *_double("mn", "mx"), "n_sources",
                            F.round("spread", 6).alias("spread"))
    return run


for _eid, _attribute, _threshold in (("candidate_id", "period_days", "0.01"),
                                     ("candidate_id", "planet_radius_re", "0.10"),
                                     ("star_id", "teff_k", "0.05")):
    query(f"a01_numeric_conflict_{_attribute}", with_views("claims") + ", "
          + numeric_conflict_sql(_eid, _attribute, _threshold) + """
    SELECT eid, CAST(mn AS DOUBLE) AS mn, CAST(mx AS DOUBLE) AS mx, n_sources,
           round(spread, 6) AS spread FROM conflicted""")(
        _conflict_query(_eid, _attribute, _threshold))


FIGHTS = f"""{MAPPED}, conflicted AS (SELECT eid, bool_or(canon = 'FALSE_POSITIVE') AND bool_or(canon
    IN ('CONFIRMED', 'KNOWN_PLANET')) AS dramatic, list_sort(list(DISTINCT canon)) AS words
    FROM mapped GROUP BY eid HAVING count(DISTINCT canon) >= 2)"""


@query("a02_disposition_conflict", with_views("claims", "vocab") + f", {FIGHTS}" + """
    SELECT eid, array_to_string(words, ',') AS dispositions, dramatic FROM conflicted""")
def _(spark, sf_dir):
    mapped = cf.mapped_dispositions(Tables(spark, sf_dir).claims, specs.vocabulary(spark))
    return cf.disposition_conflicts(mapped).withColumn(
        "dispositions", F.array_join("dispositions", ","))


FIGHT_ROWS = f"""{MAPPED}, fights AS (SELECT eid, count(DISTINCT canon) AS n_dispo,
    bool_or(canon = 'FALSE_POSITIVE') AS has_fp,
    bool_or(canon IN ('CONFIRMED', 'KNOWN_PLANET')) AS has_confirmed,
    array_to_string(list_sort(list(DISTINCT source || '=' || canon)), '; ') AS detail
    FROM mapped GROUP BY eid HAVING count(DISTINCT canon) >= 2)"""


@query("a03_disposition_fights", with_views("claims", "vocab") + f", {FIGHT_ROWS}"
       + " SELECT * FROM fights")
def _(spark, sf_dir):
    return cf.disposition_fights(cf.mapped_dispositions(
        Tables(spark, sf_dir).claims, specs.vocabulary(spark)))


def _by_source_sql(pattern: str) -> str:
    return f"""SELECT {{eid}} AS eid, source, min(v) AS mn, max(v) AS mx, count(*) AS n FROM (
        SELECT *, CAST(TRY_CAST(value AS DOUBLE) AS DECIMAL(28,10)) AS v FROM claims
        WHERE attribute = '{{attribute}}' AND {{eid}} IS NOT NULL
        AND regexp_matches(value, '{pattern}')) GROUP BY 1, 2"""


@query("a04_range_per_source", with_views("claims") + ", r AS ("
       + _by_source_sql(specs.NUMBER_PATTERN.replace("{", "{{")).format(
           eid="candidate_id", attribute="depth_ppm") + """)
    SELECT eid, source, CAST(mn AS DOUBLE) AS mn, CAST(mx AS DOUBLE) AS mx, n FROM r""")
def _(spark, sf_dir):
    return cf.numeric_by_source(Tables(spark, sf_dir).claims, "candidate_id", "depth_ppm").select(
        "eid", "source", *_double("mn", "mx"), "n")


def _g4(x: str) -> str:
    """Four significant digits of a number between 10 and 13."""
    return f"rtrim(rtrim(format('{{:.2f}}', CAST({x} AS DOUBLE)), '0'), '.')"


def report_sql(eid: str, attribute: str, tolerance: float) -> str:
    return ("r AS (" + _by_source_sql(specs.REPORT_NUMBER_PATTERN).format(
        eid=eid, attribute=attribute) + f"""),
    reported AS (SELECT eid, count(*) AS n_src, CAST(min(mn) AS DOUBLE) AS min,
        CAST(max(mx) AS DOUBLE) AS max,
        string_agg(source || ': ' || CASE WHEN mn = mx THEN {_g4('mn')} ELSE {_g4('mn')} || '–' ||
        {_g4('mx')} || ' (' || n || ')' END, '; ' ORDER BY source) AS detail
        FROM r GROUP BY eid HAVING count(*) >= 2 AND max(mx) > 0
        AND (CAST(max(mx) AS DOUBLE) - CAST(min(mn) AS DOUBLE)) / CAST(max(mx) AS DOUBLE)
            > {tolerance!r}::DOUBLE)""")


@query("a05_report_numeric_conflict", with_views("claims") + ", "
       + report_sql("candidate_id", "planet_radius_re", 0.1) + """
    SELECT eid, n_src, min, max, detail, round((max - min) / max, 6) AS spread FROM reported""")
def _(spark, sf_dir):
    found = cf.report_conflicts(Tables(spark, sf_dir).claims, "candidate_id",
                                "planet_radius_re", 0.10)
    return found.withColumn("spread", F.round("spread", 6))


def _count_sql() -> str:
    radius = numeric_conflict_sql("candidate_id", "planet_radius_re", "0.10")
    teff = numeric_conflict_sql("star_id", "teff_k", "0.05")
    for name in ("vals", "agg", "conflicted"):
        radius = radius.replace(f"{name} AS (", f"r_{name} AS (").replace(
            f"FROM {name} ", f"FROM r_{name} ")
        teff = teff.replace(f"{name} AS (", f"t_{name} AS (").replace(
            f"FROM {name} ", f"FROM t_{name} ")
    return f", {FIGHTS}, {radius}, {teff}"


CONFLICT_COUNTS = """(SELECT count(*) FROM conflicted) AS disposition,
    (SELECT count(*) FROM conflicted WHERE dramatic) AS disposition_dramatic,
    (SELECT count(*) FROM r_conflicted) AS radius, (SELECT count(*) FROM t_conflicted) AS teff"""


@query("a06_conflict_counts", with_views("claims", "vocab") + _count_sql()
       + f" SELECT {CONFLICT_COUNTS}")
def _(spark, sf_dir):
    return cf.conflict_counts(Tables(spark, sf_dir).claims, specs.vocabulary(spark))


GRAPH_VIEWS = ("stars", "candidates", "identifiers", "claims", "audit")


def graph_tables(t: Tables) -> dict:
    return {"star": t.stars, "candidate": t.candidates, "entity_identifier": t.identifiers,
            "source_assertion": t.claims, "merge_log": t.audit}


TOTALS = """(SELECT count(*) FROM stars) AS star, (SELECT count(*) FROM candidates) AS candidate,
    (SELECT count(*) FROM identifiers) AS entity_identifier,
    (SELECT count(*) FROM claims) AS source_assertion, (SELECT count(*) FROM audit) AS merge_log"""


@query("a07_graph_totals", with_views(*GRAPH_VIEWS) + f"SELECT {TOTALS}")
def _(spark, sf_dir):
    return cf.table_counts(graph_tables(Tables(spark, sf_dir)))


@query("a08_identifiers_by_type", with_views("identifiers") + """
    SELECT id_type, count(*) AS n FROM identifiers GROUP BY 1""")
def _(spark, sf_dir):
    return cf.count_by(Tables(spark, sf_dir).identifiers, "id_type")


@query("a08_audit_by_rule", with_views("audit") + """
    SELECT rule_fired, count(*) AS n FROM audit GROUP BY 1""")
def _(spark, sf_dir):
    return cf.count_by(Tables(spark, sf_dir).audit, "rule_fired")


@query("a09_identifier_breadth", with_views("identifiers") + """
    SELECT n_types, count(*) AS stars FROM (SELECT star_id, count(DISTINCT id_type) AS n_types
    FROM identifiers WHERE star_id IS NOT NULL GROUP BY 1) GROUP BY 1""")
def _(spark, sf_dir):
    return cf.identifier_breadth(Tables(spark, sf_dir).identifiers)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_REP = """rep AS (SELECT star_id, min(candidate_id) AS target_id FROM candidates GROUP BY 1)"""
SAID = f"""{_REP}, worded AS (SELECT c.*, canonical AS word,
        CASE WHEN regexp_matches(trim(c.value), '{_NUMBER}') THEN TRY_CAST(c.value AS DOUBLE) END AS num
        FROM claims c LEFT JOIN vocab v ON attribute = 'disposition' AND v.source = c.source
        AND v.source_value = c.value),
    said AS (SELECT target_id, 'candidate' AS claim_level, w.* FROM rep JOIN worded w
             ON w.candidate_id = rep.target_id
             UNION ALL SELECT target_id, 'star', w.* FROM rep JOIN worded w ON w.star_id = rep.star_id)"""
FLAGS = f"""{SAID}, rolled AS (SELECT target_id, attribute, count(*) AS n_claims, min(num) AS mn,
        max(num) AS mx, count(DISTINCT CASE WHEN num IS NOT NULL THEN source END) AS n_sources,
        count(DISTINCT word) AS n_words FROM said GROUP BY 1, 2),
    flags AS (SELECT target_id, r.attribute, a.level, a.unit, a.kind, n_claims, CASE
        WHEN a.kind = 'disposition' THEN n_words >= 2
        ELSE coalesce(n_sources >= 2 AND mn <> mx AND mx > 0 AND (mx - mn) / mx > threshold, false)
        END AS conflict, axis_rank FROM rolled r JOIN axes a USING (attribute))"""


def said_of(spark, t: Tables):
    return ds.target_claims(representative_targets(t), t.claims, specs.vocabulary(spark))


@query("a10_who_says_what", with_views("candidates", "claims", "vocab", "axes") + f", {FLAGS}" + """
    SELECT target_id, attribute, level, unit, kind, n_claims, conflict,
           CAST(axis_rank AS INTEGER) AS axis_rank FROM flags""")
def _(spark, sf_dir):
    return ds.attribute_flags(said_of(spark, Tables(spark, sf_dir)), specs.attribute_axes(spark))


@query("a11_designation_collapse", with_views("designations") + """
    SELECT star_id, id_type, id_value,
           arg_min(period, [source_order, raw_id]) FILTER (WHERE period IS NOT NULL) AS period,
           arg_min(planet_name, [source_order, raw_id]) FILTER (WHERE planet_name <> '')
           AS planet_name, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
    FROM designations GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return dz.collapse(Tables(spark, sf_dir).designations).withColumn(
        "sources", F.array_join("sources", ","))


_PLACED = "placed AS (SELECT * FROM stars WHERE ra_deg IS NOT NULL AND dec_deg IS NOT NULL)"


@query("a12_host_candidate_rollup", with_views("stars", "candidates") + f", {_PLACED}" + """
    SELECT p.star_id, p.canonical_name AS host, tic_id, count(*) OVER (PARTITION BY p.star_id)
           AS n_candidates, candidate_id, c.canonical_name AS candidate, disposition
    FROM placed p JOIN candidates c USING (star_id)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.host_candidates(t.stars, t.candidates)


HOSTS = f"""{_PLACED}, ranked AS (SELECT star_id, candidate_id, canonical_name AS candidate,
        coalesce(disposition, 'UNKNOWN') AS disposition FROM candidates),
    rolled_hosts AS (SELECT star_id, count(*) AS n_candidates,
        bool_or(disposition = 'AMBIGUOUS') AS has_conflict FROM ranked GROUP BY 1),
    best_candidate AS (SELECT DISTINCT ON (star_id) * FROM ranked ORDER BY star_id, CASE disposition
        WHEN 'CONFIRMED' THEN 0 WHEN 'KNOWN_PLANET' THEN 1 WHEN 'CANDIDATE' THEN 2
        WHEN 'AMBIGUOUS' THEN 3 WHEN 'FALSE_POSITIVE' THEN 4 ELSE 9 END, candidate, candidate_id),
    hosts AS (SELECT star_id, canonical_name AS host, tic_id, round(ra_deg, 6) AS ra_deg,
        round(dec_deg, 6) AS dec_deg, candidate_id, candidate, disposition, has_conflict, n_candidates
        FROM placed JOIN best_candidate USING (star_id) JOIN rolled_hosts USING (star_id))"""


@query("a13_representative_disposition", with_views("stars", "candidates") + f", {HOSTS}"
       + " SELECT * FROM hosts")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.host_targets(t.stars, t.candidates)


BINS = f"""now AS ({CURRENT_ELEMENTS}), bins AS (
    SELECT CAST(floor((apogee_km + perigee_km) / 2 / 50) * 50 AS BIGINT) AS alt_bin_km,
           CAST(floor(inclination / 5) * 5 AS BIGINT) AS inc_bin_deg, count(*) AS object_count
    FROM now WHERE inclination IS NOT NULL AND (apogee_km + perigee_km) / 2 < 2000 GROUP BY 1, 2),
    shells AS (SELECT alt_bin_km // 200 * 200 AS alt_lo_km, CAST(sum(object_count) AS BIGINT)
               AS objects FROM bins GROUP BY 1)"""


@query("a14_density_bins", with_views("elements") + f", {BINS}" + " SELECT * FROM bins")
def _(spark, sf_dir):
    return orbits.density_bins(Tables(spark, sf_dir).elements)


@query("a15_shell_rollup", with_views("elements") + f", {BINS}" + """
    SELECT alt_lo_km, alt_lo_km + 200 AS alt_hi_km, objects FROM shells""")
def _(spark, sf_dir):
    return orbits.shells(orbits.density_bins(Tables(spark, sf_dir).elements))


@query("a15_density_peak", with_views("elements") + f", {BINS}" + """
    SELECT (SELECT CAST(sum(object_count) AS BIGINT) FROM bins) AS leo_objects,
           alt_bin_km AS peak_alt_km, inc_bin_deg AS peak_inc_deg, object_count AS peak_count
    FROM bins ORDER BY object_count DESC, alt_bin_km, inc_bin_deg LIMIT 1""")
def _(spark, sf_dir):
    return orbits.density_peak(orbits.density_bins(Tables(spark, sf_dir).elements))


AS_OF = "2025-01-05"


@query("a16_catalog_summary", with_views("satellites", "elements") + f"""
    SELECT (SELECT count(*) FROM satellites) AS catalog_objects,
           (SELECT count(*) FROM satellites WHERE object_type = 'PAYLOAD'
            AND launch_date > DATE '{AS_OF}' - 365) AS payloads_launched_1y,
           (SELECT count(*) FROM satellites WHERE object_type = 'PAYLOAD'
            AND launch_date > DATE '{AS_OF}' - 30) AS payloads_launched_30d,
           (SELECT count(DISTINCT norad_id) FROM elements WHERE source = 'celestrak_gp')
           AS tracked_with_elements""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return orbits.catalog_summary(t.satellites, t.elements, AS_OF)


_TOP = f"""{OWNERS}, top AS (SELECT operator, count(*) AS payloads FROM satellites
    JOIN owners USING (satellite_id) WHERE object_type = 'PAYLOAD' GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 8)"""


@query("a17_top_owners", with_views("satellites", "ownership", "operators") + f", {_TOP}"
       + " SELECT * FROM top")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return orbits.top_owners(t.satellites, orbits.current_owners(t.ownership, t.operators))


_CLOSEST = f"""{SIGHT}, closest AS (SELECT DISTINCT ON (request_id, satellite_id) request_id,
    satellite_id, step, sep FROM near WHERE sep < 10 ORDER BY request_id, satellite_id, sep, step)"""


@query("a18_closest_approach", with_views("circular", "requests") + f", {_CLOSEST}" + """
    SELECT request_id, satellite_id, c.alt_km, round(sep, 6) AS sep_deg
    FROM closest JOIN circular c USING (satellite_id, step)""")
def _(spark, sf_dir):
    hits = sightline.closest_fixed_approaches(*sight_tables(Tables(spark, sf_dir)), 10.0, 20.0, ["alt_km"])
    return hits.select("request_id", "satellite_id", "alt_km", rounded(F.col("sep_deg"), 6).alias("sep_deg"))


HITS = f"""{_CLOSEST}, {OWNER}, hits AS (SELECT c.*, operator FROM closest c
    LEFT JOIN owner USING (satellite_id))"""
HIT_VIEWS = ("circular", "requests", "ownership", "operators")


def owned_hits(t: Tables):
    """Satellites at their closest step, counted by request and owner; owners are looked up before the pairs multiply them."""
    track, seen = sight_tables(t)
    owned = sightline.with_owner(seen, orbits.current_owners(t.ownership, t.operators))
    return sightline.closest_fixed_approaches(track, owned, 10.0, 20.0, ["operator"], tally=True)


@query("a19_owner_tally", with_views(*HIT_VIEWS) + f", {HITS}" + """
    SELECT request_id, coalesce(operator, 'Unattributed') AS operator, count(*) AS hits
    FROM hits GROUP BY 1, 2""")
def _(spark, sf_dir):
    return sightline.owner_tally(owned_hits(Tables(spark, sf_dir)), counted=True)


@query("a20_target_visibility", with_views("circular") + """
    SELECT satellite_id AS request_id, round(max(degrees(asin(z / sqrt(x*x + y*y + z*z)))), 1) + 0e0
           AS target_max_alt_deg, bool_or(degrees(asin(z / sqrt(x*x + y*y + z*z))) >= 20)
           AS target_visible FROM circular GROUP BY 1""")
def _(spark, sf_dir):
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    track = Tables(spark, sf_dir).circular.select(
        F.col("satellite_id").alias("request_id"),
        F.degrees(F.asin(F.col("z") / norm)).alias("target_alt_deg"))
    return sightline.target_visibility(track, 20.0)


@query("a21_claims_by_source", with_views("candidates", "claims", "vocab") + f", {SAID}" + """
    SELECT target_id, attribute, source, min(num) AS numeric_min, max(num) AS numeric_max,
           count(*) AS n_claims, coalesce(array_to_string(list_sort(list(DISTINCT word) FILTER (WHERE
           word IS NOT NULL)), ','), '') AS dispositions,
           arg_max(trim(regexp_replace(source_ref, '<[^>]+>', '', 'g')), [lpad(CAST(epoch_us(observed_at)
           AS VARCHAR), 20, '0'), trim(regexp_replace(source_ref, '<[^>]+>', '', 'g'))])
           FILTER (WHERE source_ref <> '') AS first_reference
    FROM said GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    rows = ds.claims_by_source(said_of(spark, Tables(spark, sf_dir)))
    return rows.withColumn("dispositions", F.array_join("dispositions", ","))


@query("a22_crosswalk_by_source", with_views("candidates", "identifiers") + f", {_REP}" + """
    , owned AS (SELECT target_id, i.* FROM rep JOIN identifiers i ON i.candidate_id = target_id
        UNION ALL SELECT target_id, i.* FROM rep JOIN identifiers i ON i.star_id = rep.star_id)
    SELECT target_id, source, count(*) AS n_identifiers,
           array_to_string(list_sort(list(DISTINCT id_type)), ',') AS id_types
    FROM owned GROUP BY 1, 2""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = ds.identifiers_by_source(ds.identifiers(representative_targets(t), t.identifiers))
    return rows.withColumn("id_types", F.array_join("id_types", ","))


@query("a23_density_levels", with_views("elements") + f", {BINS}" + """
    SELECT *, CAST(least(5, greatest(0, ceil(ln(object_count + 1) / ln((SELECT max(object_count)
           FROM bins) + 1) * 6) - 1)) AS INTEGER) AS level FROM bins""")
def _(spark, sf_dir):
    return orbits.density_levels(orbits.density_bins(Tables(spark, sf_dir).elements))


HARMONIC = """list_filter([1e0, 2e0, 0.5e0, 3e0, 1e0 / 3e0, 1.5e0, 2e0 / 3e0],
    lambda h: abs({found} - known_period_days * h) / (known_period_days * h) <= 0.01e0)[1]"""
GRADED = f"""{CURRENT}, graded AS (SELECT c.*, t.cohort, known_period_days, known_epoch_bjd,
    CASE WHEN c.period_days > 0 AND known_period_days > 0 THEN
    {HARMONIC.format(found='c.period_days')} END AS harmonic
    FROM current c JOIN targets t USING (target_id) WHERE method <> 'single_event'),
    recovered AS (SELECT DISTINCT ON (target_id) * FROM graded WHERE harmonic IS NOT NULL AND snr >= 7
        ORDER BY target_id, abs(harmonic - 1), method, rank, period_days, snr, epoch_bjd),
    strongest AS (SELECT DISTINCT ON (target_id) target_id, period_days AS best_period, snr AS best_snr
        FROM current WHERE method <> 'single_event'
        ORDER BY target_id, coalesce(snr, 0) DESC, method, rank, period_days, snr NULLS FIRST,
                 epoch_bjd),
    event AS (SELECT DISTINCT ON (target_id) target_id, snr AS event_snr FROM current
        WHERE method = 'single_event' ORDER BY target_id, rank, snr NULLS FIRST)"""
GRADE_VIEWS = ("runs", "detections", "targets")


RECOVERY_COUNTS = """(SELECT count(*) FROM targets) AS targets,
        (SELECT count(*) FROM newest JOIN runs USING (pipeline_run_id) WHERE status = 'ok')
        AS processed_ok,
        (SELECT count(*) FROM targets WHERE cohort = 'gold_planet') AS gold_planet,
        (SELECT count(*) FROM recovered WHERE cohort = 'gold_planet') AS recovered,
        (SELECT count(*) FROM targets WHERE cohort = 'gold_fp') AS gold_fp,
        (SELECT count(*) FROM strongest JOIN targets USING (target_id) WHERE cohort = 'gold_fp'
         AND best_snr >= 7) AS fp_signal,
        (SELECT count(*) FROM targets WHERE cohort = 'discovery') AS discovery,
        (SELECT count(*) FROM targets LEFT JOIN strongest USING (target_id)
         LEFT JOIN event USING (target_id) WHERE cohort = 'discovery'
         AND (coalesce(best_snr, 0) >= 7 OR coalesce(event_snr, 0) >= 7)) AS credible"""


@query("a24_recovery_counts", with_views(*GRADE_VIEWS) + f", {GRADED} SELECT {RECOVERY_COUNTS}")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grading.recovery_counts(t.targets, t.runs,
                                   grading.current_detections(t.runs, t.detections))


RUNTIMES = """newest_runs AS (SELECT DISTINCT ON (target_id) * FROM runs
        ORDER BY target_id, pipeline_run_id DESC),
    timed AS (SELECT list_sort(list(runtime_s)) AS r FROM newest_runs WHERE runtime_s > 0)"""


@query("a25_runtime_upper_median", with_views("runs") + f", {RUNTIMES}" + """
    SELECT r[len(r) // 2 + 1] AS median_s, r[-1] AS max_s,
           (SELECT CAST(max(data_vintage) AS VARCHAR) FROM newest_runs) AS vintage FROM timed""")
def _(spark, sf_dir):
    return grading.runtime_summary(Tables(spark, sf_dir).runs).withColumn(
        "vintage", F.col("vintage").cast("string"))


LAST_CLAIM = """latest AS (SELECT {eid} AS eid, attribute, source, arg_max(value, [lpad(CAST(epoch_us(
    observed_at) AS VARCHAR), 20, '0'), lpad(CAST(ingest_run_id AS VARCHAR), 20, '0'), source_key,
    lpad(CAST(raw_id AS VARCHAR), 20, '0'), value]) AS value
    FROM claims WHERE {eid} IS NOT NULL GROUP BY 1, 2, 3)"""
VOTES = LAST_CLAIM.format(eid="candidate_id") + """, votes AS (
    SELECT eid, l.source, l.value, rank, canonical FROM latest l JOIN ranks r
        ON r.attribute = l.attribute AND r.source = l.source
        LEFT JOIN vocab v ON v.source = l.source AND v.source_value = l.value
    WHERE l.attribute = 'disposition'),
    winners AS (SELECT eid, arg_min(canonical, rank) AS disposition, min(rank) AS won FROM votes
        WHERE canonical IS NOT NULL GROUP BY 1)"""


@query("a26_build_summary", with_views(*GRAPH_VIEWS, "ranks", "vocab") + f", {VOTES}" + f"""
    SELECT {TOTALS}, (SELECT count(*) FROM winners) AS disposition_resolved,
        (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT v.source || '=' || v.value AS w
         FROM votes v LEFT JOIN winners USING (eid) WHERE canonical IS NULL
         AND (won IS NULL OR rank < won))) AS unmapped""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    votes = resolution.disposition_votes(
        resolution.last_per_source(t.claims, "candidate_id"), specs.precedence(spark),
        specs.vocabulary(spark))
    resolved = resolution.resolve_dispositions(votes).agg(
        F.count(F.lit(1)).alias("disposition_resolved"))
    # Distinct words of a handful of sources.
    words = resolution.unmapped_words(votes).agg(F.array_join(F.array_sort(F.collect_set(
        F.concat_ws("=", "source", "value"))), ",").alias("unmapped"))
    return cf.table_counts(graph_tables(t)).select(
        "*", resolved.scalar().alias("disposition_resolved"), words.scalar().alias("unmapped"))


@query("a27_selection_summary", with_views("targets") + """
    SELECT cohort, count(*) AS n, count(DISTINCT tic_id) AS n_tic FROM targets GROUP BY 1""")
def _(spark, sf_dir):
    return selection.cohort_summary(Tables(spark, sf_dir).targets)


@query("a28_run_totals", with_views("runs") + """
    SELECT count(*) AS n_runs, count(*) FILTER (WHERE status = 'ok') AS n_ok,
           count(*) FILTER (WHERE status <> 'ok') AS n_not_ok,
           count(*) FILTER (WHERE status = 'error') AS n_error, CAST(sum(n_points) AS BIGINT) AS n_points
    FROM runs""")
def _(spark, sf_dir):
    return grading.run_totals(Tables(spark, sf_dir).runs)


@query("a28_fetch_totals", with_views("runs") + """
    SELECT count(DISTINCT tic_id) AS n_tics, count(*) FILTER (WHERE status = 'ok') AS new_sectors,
           CAST(coalesce(sum(n_points) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS bytes,
           count(*) FILTER (WHERE status = 'error') AS errors FROM runs""")
def _(spark, sf_dir):
    return lightcurves.fetch_totals(Tables(spark, sf_dir).runs.withColumnRenamed("n_points", "bytes"))


@query("a29_owner_share", with_views("satellites", "ownership", "operators", "elements")
       + f", {_TOP}, {BINS}" + """
    SELECT operator, payloads, CAST(floor(100.0 * payloads / (SELECT sum(object_count) FROM bins)
           + 0.5) AS BIGINT) AS share_pct
    FROM top WHERE operator ILIKE '%nation_1%' ORDER BY payloads DESC, operator LIMIT 1""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    top = orbits.top_owners(t.satellites, orbits.current_owners(t.ownership, t.operators))
    return orbits.owner_share(top, orbits.density_peak(orbits.density_bins(t.elements)), "nation_1")


@query("a29_shell_bars", with_views("elements") + f", {BINS}" + """
    SELECT alt_lo_km, objects, round(100e0 * objects / (SELECT max(objects) FROM shells), 6)
           AS width_pct FROM shells WHERE alt_lo_km < 1400""")
def _(spark, sf_dir):
    rows = orbits.shell_bars(orbits.shells(orbits.density_bins(Tables(spark, sf_dir).elements)))
    return rows.select("alt_lo_km", "objects", F.round("width_pct", 6).alias("width_pct"))
