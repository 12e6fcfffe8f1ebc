"""Latest-row picks and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import matched_number
from starledger.operators import lightcurve, orbits, picks, selection, sightline
from starledger.plans import graph
from starledger.registry import query
from starledger.registry.views import Tables, with_views
from starledger.session import scratch_path
from starledger.sources.current import CurrentRows

_COORDINATES = "round(ra, 6) AS ra, round(dec, 6) AS dec"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("q01_latest_ok_run", with_views("landed_rows", "ledger") + """
    SELECT r.* FROM landed_rows r WHERE ingest_run_id = (
        SELECT max(r2.ingest_run_id) FROM landed_rows r2 JOIN ledger l USING (ingest_run_id)
        WHERE l.status = 'ok')""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return picks.latest_snapshot(t.landed_rows, t.ledger)


_STAR_ROWS = """star_rows AS (
    SELECT tic_id AS tic, CAST(NULL AS VARCHAR) AS hostname, ra_deg AS ra, dec_deg AS dec
    FROM raw_exofop_ctoi
    UNION ALL SELECT tid, NULL, ra_deg, dec_deg FROM raw_nea_toi
    UNION ALL SELECT tic_id, NULL, NULL, NULL FROM raw_exofop_toi
    UNION ALL SELECT tic_id, hostname, ra_deg, dec_deg FROM raw_ps
    UNION ALL SELECT tic_id, hostname, ra_deg, dec_deg FROM raw_pscomppars)"""
_RAW = ("raw_exofop_toi", "raw_exofop_ctoi", "raw_nea_toi", "raw_ps", "raw_pscomppars",
        "raw_koi_cumulative")


def raw_tables(t: Tables) -> dict:
    return {name: getattr(t, name) for name in _RAW}


@query("q02_star_per_tic", with_views(*_RAW) + ", " + _STAR_ROWS + f"""
    SELECT DISTINCT ON (tic) tic, hostname, {_COORDINATES} FROM star_rows WHERE tic IS NOT NULL
    ORDER BY tic, hostname IS NULL, ra IS NULL, dec IS NULL, hostname NULLS FIRST,
             ra NULLS FIRST, dec NULLS FIRST""")
def _(spark, sf_dir):
    rows = graph.star_observations(raw_tables(Tables(spark, sf_dir)))
    return _rounded(picks.star_per_tic(rows), "ra", "dec")


@query("q03_row_per_hostname", with_views("raw_ps") + f"""
    SELECT DISTINCT ON (hostname) hostname, {_COORDINATES}
    FROM (SELECT hostname, ra_deg AS ra, dec_deg AS dec FROM raw_ps)
    ORDER BY hostname, ra IS NULL, dec IS NULL, ra NULLS FIRST, dec NULLS FIRST""")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw_ps.select(
        "hostname", F.col("ra_deg").alias("ra"), F.col("dec_deg").alias("dec"))
    return _rounded(picks.row_per_hostname(rows), "ra", "dec")


@query("q04_row_per_kepid", """
    SELECT DISTINCT ON (kepid) kepid, kepler_name, kepoi
    FROM (SELECT o_custkey AS kepid, CASE WHEN o_orderkey % 3 = 0 THEN 'Kepler-' || o_orderkey END
          AS kepler_name, o_orderkey AS kepoi FROM orders)
    ORDER BY kepid, kepler_name IS NULL, kepler_name NULLS FIRST, kepoi""")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(
        F.col("o_custkey").alias("kepid"),
        F.when(F.col("o_orderkey") % 3 == 0,
               F.concat(F.lit("Kepler-"), F.col("o_orderkey").cast("string"))).alias("kepler_name"),
        F.col("o_orderkey").alias("kepoi"))
    return picks.row_per_kepid(rows)


@query("q05_row_per_planet", with_views("raw_ps") + """
    SELECT DISTINCT ON (pl_name) pl_name, default_flag, CAST(period_days AS DOUBLE) AS period_days,
           raw_id
    FROM raw_ps ORDER BY pl_name, default_flag DESC NULLS LAST, period_days IS NULL,
         period_days NULLS FIRST, raw_id""")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw_ps.select("pl_name", "default_flag", "period_days", "raw_id")
    return picks.row_per_planet(rows).withColumn("period_days", F.col("period_days").cast("double"))


_LAST = """SELECT DISTINCT ON (source, endpoint) source, endpoint, ingest_run_id, status,
           rows_ingested, bytes_downloaded FROM ledger {where}
           ORDER BY source, endpoint, {by} DESC NULLS LAST, ingest_run_id DESC"""


@query("q06_last_run_per_endpoint_started", with_views("ledger") + _LAST.format(
    where="WHERE source IN ('exofop', 'nea')", by="started_at"))
def _(spark, sf_dir):
    return picks.last_per_endpoint(Tables(spark, sf_dir).ledger, "started_at", ["exofop", "nea"]
                                   ).select("source", "endpoint", "ingest_run_id", "status",
                                            "rows_ingested", "bytes_downloaded")


@query("q06_last_run_per_endpoint_finished", with_views("ledger") + _LAST.format(
    where="", by="finished_at"))
def _(spark, sf_dir):
    return picks.last_per_endpoint(Tables(spark, sf_dir).ledger, "finished_at").select(
        "source", "endpoint", "ingest_run_id", "status", "rows_ingested", "bytes_downloaded")


@query("q07_latest_run_per_target", with_views("runs") + """
    SELECT DISTINCT ON (target_id) target_id, pipeline_run_id, status, runtime_s, notes FROM runs
    ORDER BY target_id, pipeline_run_id DESC""")
def _(spark, sf_dir):
    return picks.latest_run_per_target(Tables(spark, sf_dir).runs).select(
        "target_id", "pipeline_run_id", "status", "runtime_s", "notes")


@query("q08_leading_box_detection", with_views("runs", "detections") + """
    SELECT DISTINCT ON (target_id) target_id, d.pipeline_run_id, rank, round(period_days, 6)
           AS period_days, epoch_bjd, snr
    FROM detections d JOIN runs USING (pipeline_run_id) WHERE method = 'bls'
    ORDER BY target_id, d.pipeline_run_id DESC, rank, period_days, epoch_bjd, depth_ppm,
             duration_hr, snr NULLS FIRST""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return picks.leading_box_detection(t.runs, t.detections).select(
        "target_id", "pipeline_run_id", "rank", F.round("period_days", 6).alias("period_days"),
        "epoch_bjd", "snr")


_ELEMENT_ORDER = """epoch DESC, source DESC, mean_motion DESC, eccentricity DESC,
    inclination DESC NULLS LAST, ra_of_asc_node DESC, arg_of_pericenter DESC, mean_anomaly DESC,
    perigee_km DESC"""
LATEST_ELEMENTS = f"SELECT DISTINCT ON (norad_id) * FROM elements ORDER BY norad_id, {_ELEMENT_ORDER}"
CURRENT_ELEMENTS = ("SELECT DISTINCT ON (norad_id) * FROM elements WHERE source = 'celestrak_gp' "
                    f"ORDER BY norad_id, {_ELEMENT_ORDER}")
_ELEMENT_COLUMNS = ("norad_id, epoch_us(epoch) AS epoch_us, source, perigee_km, apogee_km, "
                    "inclination, mean_anomaly")


def _element_columns(df):
    return df.select("norad_id", F.unix_micros("epoch").alias("epoch_us"), "source", "perigee_km",
                     "apogee_km", "inclination", "mean_anomaly")


@query("q09_latest_elements", with_views("elements", "satellites") + f"""
    SELECT {_ELEMENT_COLUMNS} FROM ({LATEST_ELEMENTS}) WHERE norad_id IN
    (SELECT norad_id FROM satellites WHERE object_type = 'PAYLOAD')""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    payloads = t.satellites.filter("object_type = 'PAYLOAD'").select("norad_id")
    return _element_columns(picks.latest_elements(
        t.elements.join(payloads, "norad_id", "left_semi")))


@query("q09_maintained_elements", with_views("elements") + f"""
    SELECT {_ELEMENT_COLUMNS} FROM ({LATEST_ELEMENTS})""")
def _(spark, sf_dir):
    """The history arrives in three deliveries, newer and older rows mixed; the table is read, not the history."""
    elements = Tables(spark, sf_dir).elements
    table = CurrentRows(spark, scratch_path(spark, "current-elements"), ["norad_id"], picks.latest_elements)
    for part in range(3):
        table.fold(elements.filter(F.pmod(F.xxhash64("epoch", "mean_anomaly"), F.lit(3)) == part))
    return _element_columns(table.read())


@query("q10_latest_elements_of_source", with_views("elements") + f"""
    SELECT {_ELEMENT_COLUMNS} FROM ({CURRENT_ELEMENTS})""")
def _(spark, sf_dir):
    return _element_columns(picks.latest_elements(Tables(spark, sf_dir).elements, "celestrak_gp"))


def _number_sql(pattern: str) -> str:
    return (f"CASE WHEN regexp_matches(value, '{pattern}') "
            "THEN CAST(TRY_CAST(value AS DOUBLE) AS DECIMAL(28,10)) END")


@query("p01_numeric_text_guard", with_views("claims") + f"""
    SELECT attribute, source, count({_number_sql(specs.NUMBER_PATTERN)}) AS n_api,
           count({_number_sql(specs.REPORT_NUMBER_PATTERN)}) AS n_report,
           round(CAST(sum({_number_sql(specs.NUMBER_PATTERN)}) AS DOUBLE), 4) AS total
    FROM claims GROUP BY 1, 2""")
def _(spark, sf_dir):
    api = matched_number(F.col("value"), specs.NUMBER_PATTERN)
    report = matched_number(F.col("value"), specs.REPORT_NUMBER_PATTERN)
    return Tables(spark, sf_dir).claims.groupBy("attribute", "source").agg(
        F.count(api).alias("n_api"), F.count(report).alias("n_report"),
        F.round(F.sum(api).cast("double"), 4).alias("total"))


@query("p02_case_insensitive_match", with_views("candidates") + """
    SELECT candidate_id, lower(canonical_name) = lower('RED BOLT 17') AS exact,
           canonical_name ILIKE 'RED%' AS prefix, canonical_name ILIKE '%gear_1%' AS inside
    FROM candidates WHERE canonical_name ILIKE '%gear_1%' OR canonical_name ILIKE 'RED%'""")
def _(spark, sf_dir):
    name = F.col("canonical_name")
    return Tables(spark, sf_dir).candidates.filter(
        name.ilike("%gear_1%") | name.ilike("RED%")).select(
        "candidate_id", (F.lower(name) == "red bolt 17").alias("exact"),
        name.ilike("RED%").alias("prefix"), name.ilike("%gear_1%").alias("inside"))


@query("p03_membership_and_exclusion", with_views("pool", "stars") + """
    SELECT candidate_id, tfopwg_disp FROM pool WHERE tfopwg_disp IN ('CP', 'KP')
    AND tic_id NOT IN (SELECT tic_id FROM stars WHERE tic_id IS NOT NULL)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    used = t.stars.filter("tic_id IS NOT NULL").select("tic_id")
    return (t.pool.filter(F.col("tfopwg_disp").isin("CP", "KP"))
            .join(used, "tic_id", "left_anti").select("candidate_id", "tfopwg_disp"))


@query("p04_target_eligibility", with_views("pool") + """
    SELECT candidate_id, tmag, depth_ppm FROM pool WHERE tfopwg_disp IN ('FP', 'FA')
    AND period_days > 0 AND epoch_bjd IS NOT NULL AND depth_ppm IS NOT NULL AND tmag IS NOT NULL""")
def _(spark, sf_dir):
    return selection.eligible_gold(Tables(spark, sf_dir).pool, ["FP", "FA"]).select(
        "candidate_id", "tmag", "depth_ppm")


MIN_GOOD = 12
GOOD = f"""good AS (SELECT * FROM points WHERE quality = 0 QUALIFY
           count(*) OVER (PARTITION BY tic_id, sector) >= {MIN_GOOD})"""


@query("p05_quality_mask", with_views("points") + ", " + GOOD + """
    SELECT tic_id, sector, count(*) AS n, round(sum(flux), 6) AS flux_sum FROM good
    GROUP BY 1, 2""")
def _(spark, sf_dir):
    good = lightcurve.good_cadences(Tables(spark, sf_dir).points, MIN_GOOD)
    return good.groupBy("tic_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("flux"), 6).alias("flux_sum"))


@query("p06_observability_mask", with_views("circular") + """
    SELECT satellite_id, CAST(step AS INTEGER) AS step FROM circular WHERE z > 0 AND error = 0""")
def _(spark, sf_dir):
    seen = Tables(spark, sf_dir).circular.withColumn("sat_alt_deg", F.col("z"))
    return sightline.observable(seen).select("satellite_id", F.col("step").cast("int").alias("step"))


@query("p07_leo_payload_filter", with_views("satellites", "elements") + f"""
    , e AS ({LATEST_ELEMENTS})
    SELECT s.satellite_id, e.norad_id, round((perigee_km + apogee_km) / 2, 1) AS alt_km
    FROM satellites s JOIN e ON e.norad_id = s.norad_id
    WHERE object_type = 'PAYLOAD' AND (perigee_km + apogee_km) / 2 < 2000""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return orbits.leo_payloads(t.satellites, t.elements).select(
        "satellite_id", "norad_id", "alt_km")


@query("p08_orbit_bin_guard", with_views("elements") + """
    SELECT source, count(*) AS n FROM elements WHERE inclination IS NOT NULL
    AND perigee_km IS NOT NULL AND apogee_km IS NOT NULL AND (apogee_km + perigee_km) / 2 < 2000
    GROUP BY 1""")
def _(spark, sf_dir):
    return orbits.low_orbit_bins(Tables(spark, sf_dir).elements).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))
