"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger.functions import frames, numeric, text
from starledger.operators import periodsearch
from starledger.operators.quantiles import robust_sigma
from starledger.registry import query
from starledger.registry.aggregates import HARMONIC
from starledger.registry.views import Tables, with_views

_NAMES = """names AS (SELECT 'd' || doc_id AS k, text AS name FROM documents
    UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'n' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
        || '-' || l_quantity || '-' || l_extendedprice, NULL FROM lineitem WHERE l_orderkey < 0)"""


@query("f01_norm_name", f"""WITH {_NAMES}
    SELECT k, md5(coalesce(trim(regexp_replace(regexp_replace(replace(replace(lower(name), 'ß', 'ss'),
           'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), '')) AS digest,
           length(coalesce(trim(regexp_replace(regexp_replace(replace(replace(lower(name), 'ß', 'ss'),
           'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), '')) AS n
    FROM names""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"),
                               F.col("text").alias("name")).unionByName(
        t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"),
                          F.col("s_name").alias("name")))
    key = text.norm_name(F.col("name"))
    return names.select("k", F.md5(key.cast("binary")).alias("digest"),
                        F.length(key).cast("bigint").alias("n"))


_PAIRS = """pairs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN
    CAST(round(o_totalprice) AS BIGINT) % 97 - 3e0 END AS a,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice) AS BIGINT) % 96 + 0.5e0 END AS b
    FROM orders)"""


def _pairs(t: Tables):
    price = F.round("o_totalprice").cast("bigint")
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, price % 97 - 3.0).alias("a"),
        F.when(F.col("o_orderkey") % 11 != 0, price % 96 + 0.5).alias("b"))


@query("f02_relative_difference", f"""WITH {_PAIRS}
    SELECT o_orderkey, round(CASE WHEN a > 0 AND b > 0 THEN abs(a - b) / greatest(a, b) END, 6) AS diff
    FROM pairs""")
def _(spark, sf_dir):
    return _pairs(Tables(spark, sf_dir)).select(
        "o_orderkey", F.round(numeric.rel_diff(F.col("a"), F.col("b")), 6).alias("diff"))


@query("f03_periods_match", f"""WITH {_PAIRS}
    SELECT o_orderkey, coalesce(a > 0 AND b > 0 AND abs(a - b) / greatest(a, b) < 0.05e0, false)
    AS matches FROM pairs""")
def _(spark, sf_dir):
    return _pairs(Tables(spark, sf_dir)).select(
        "o_orderkey", numeric.periods_match(F.col("a"), F.col("b"), 0.05).alias("matches"))


@query("f04_host_of_planet", """
    WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Kepler-' || p_partkey || ' b'
        WHEN 1 THEN ' b' WHEN 2 THEN p_name || ' B' ELSE p_name || '  c' END AS name FROM part)
    SELECT p_partkey, nullif(trim(regexp_replace(name, '\\s+[a-z]$', '')), '') AS host FROM n""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    name = (F.when(key % 4 == 0, F.concat(F.lit("Kepler-"), key.cast("string"), F.lit(" b")))
            .when(key % 4 == 1, " b").when(key % 4 == 2, F.concat("p_name", F.lit(" B")))
            .otherwise(F.concat("p_name", F.lit("  c"))))
    return Tables(spark, sf_dir).part.select("p_partkey", text.host_of_planet(name).alias("host"))


@query("f05_canonical_name", """
    SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 AND p_size % 4 <> 0 THEN p_name END,
        'TOI ' || CASE WHEN p_size % 3 = 0 THEN p_partkey || '.01' END,
        'KOI ' || CASE WHEN p_size % 5 = 0 THEN 'K' || p_partkey END,
        'CTOI ' || CASE WHEN p_size % 7 = 0 THEN p_partkey || '.02' END,
        'star ' || p_partkey) AS name FROM part""")
def _(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    return Tables(spark, sf_dir).part.select("p_partkey", text.canonical_name(
        F.when(size % 4 == 0, "").when(size % 2 == 0, F.col("p_name")),
        F.when(size % 3 == 0, F.concat(key, F.lit(".01"))),
        F.when(size % 5 == 0, F.concat(F.lit("K"), key)),
        F.when(size % 7 == 0, F.concat(key, F.lit(".02"))),
        F.concat(F.lit("star "), key)).alias("name"))


@query("f06_percent_to_ppm", with_views("raw_ps") + """
    SELECT raw_id, CAST(depth_pct * 10000 AS DOUBLE) AS depth_ppm FROM raw_ps""")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).raw_ps.select(
        "raw_id", numeric.percent_to_ppm(F.col("depth_pct")).cast("double").alias("depth_ppm"))


@query("f07_controversy_override", with_views("raw_ps") + """
    SELECT raw_id, CASE WHEN pl_controv_flag = 1 THEN 'CONTROVERSIAL' ELSE soltype END AS word
    FROM raw_ps""")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).raw_ps.select("raw_id", text.solution_type(
        F.col("pl_controv_flag"), F.col("soltype")).alias("word"))


@query("f08_stratum_label", with_views("pool") + """
    SELECT candidate_id, CASE WHEN depth_ppm >= 3000 AND period_days < 10 THEN 'deep_short'
        WHEN depth_ppm >= 3000 AND period_days >= 10 THEN 'deep_long'
        WHEN period_days < 10 THEN 'shallow_short' ELSE 'shallow_long' END AS stratum FROM pool""")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).pool.select("candidate_id", numeric.stratum(
        F.col("depth_ppm"), F.col("period_days")).alias("stratum"))


@query("f09_text_to_number", with_views("cells") + r"""
    SELECT p_partkey, CASE WHEN regexp_matches(trim(cell),
           '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
           THEN TRY_CAST(trim(cell) AS DOUBLE) END AS number FROM cells""")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).cells.select(
        "p_partkey", text.to_number(F.col("cell")).alias("number"))


_CLEAN = "nullif(trim(regexp_replace(ref, '<[^>]+>', '', 'g')), '')"


@query("f10_clean_reference", with_views("citations") + f"""
    SELECT page_id, md5(CASE WHEN ref = '' THEN ref ELSE {_CLEAN} END) AS digest, count(*) AS n
    FROM citations GROUP BY 1, 2""")
def _(spark, sf_dir):
    clean = text.clean_reference(F.col("ref"))
    return Tables(spark, sf_dir).citations.groupBy(
        "page_id", F.md5(clean.cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_iso_timestamp", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0
           THEN strftime(ts, '.%f') ELSE '' END || 'Z' AS iso FROM events
    UNION ALL SELECT -1 - o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' FROM orders""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.events.select("event_id", frames.iso_utc(F.col("ts")).alias("iso")).unionByName(
        t.orders.select((-1 - F.col("o_orderkey")).alias("event_id"),
                        frames.iso_utc(F.col("o_orderdate")).alias("iso")))


@query("f12_iso_parse", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000000
           * 1000000 WHEN 2 THEN epoch_us(ts) - 7200000000 END AS us FROM events""")
def _(spark, sf_dir):
    ts = F.col("ts")
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spelled = (F.when(F.col("event_id") % 4 == 0, F.concat(micros, F.lit("Z")))
               .when(F.col("event_id") % 4 == 1, plain)
               .when(F.col("event_id") % 4 == 2, F.concat(micros, F.lit("+02:00")))
               .otherwise(F.concat(F.lit("soon, "), plain)))
    return Tables(spark, sf_dir).events.select(
        "event_id", F.unix_micros(frames.parse_iso(spelled)).alias("us"))


@query("f13_detail_json", with_views("identifiers") + """
    SELECT candidate_id, id_value, source, '{"id_type":"' || id_type || '","id_value":"' || id_value
           || '","source":"' || source || '"' || CASE WHEN star_id IS NOT NULL
           THEN ',"star_id":' || star_id ELSE '' END || '}' AS details FROM identifiers""")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).identifiers.select(
        "candidate_id", "id_value", "source", text.detail_json(
            id_type=F.col("id_type"), id_value=F.col("id_value"), source=F.col("source"),
            star_id=F.col("star_id")).alias("details"))


@query("f14_julian_date", """
    SELECT event_id, epoch_us(ts) / 86400000000e0 + 2440587.5e0 AS jd FROM events""")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).events.select(
        "event_id", frames.julian_date(F.col("ts")).alias("jd"))


_GMST = """radians((280.46061837e0 + 360.98564736629e0 * ({jd} - 2451545e0)
    + 0.000387933e0 * pow(({jd} - 2451545e0) / 36525e0, 2)
    - pow(({jd} - 2451545e0) / 36525e0, 3) / 38710000e0) % 360e0)"""


@query("f15_sidereal_angle", f"""
    WITH j AS (SELECT event_id, epoch_us(ts) / 86400000000e0 + 2440587.5e0 AS jd FROM events)
    SELECT event_id, round({_GMST.format(jd='jd')}, 5) AS angle FROM j""")
def _(spark, sf_dir):
    jd = frames.julian_date(F.col("ts"))
    return Tables(spark, sf_dir).events.select(
        "event_id", F.round(frames.sidereal_angle(jd), 5).alias("angle"))


_SITE = """site AS (SELECT s_suppkey, s_suppkey % 180 - 90e0 AS lat, s_suppkey * 7 % 360 - 180e0 AS lon,
    s_suppkey % 40 / 10e0 AS elev FROM supplier),
    normal AS (SELECT *, 6378.137e0 / sqrt(1 - (2 - 1 / 298.257223563e0) / 298.257223563e0
        * pow(sin(radians(lat)), 2)) AS n FROM site)"""


@query("f16_observer_vectors", f"""WITH {_SITE}
    SELECT s_suppkey, round((n + elev) * cos(radians(lat)) * cos(radians(lon)), 5) + 0e0 AS obs_x,
        round((n + elev) * cos(radians(lat)) * sin(radians(lon)), 5) + 0e0 AS obs_y,
        round((n * (1 - (2 - 1 / 298.257223563e0) / 298.257223563e0) + elev) * sin(radians(lat)), 5)
        + 0e0 AS obs_z, round(sin(radians(lat)), 6) + 0e0 AS up_z FROM normal""")
def _(spark, sf_dir):
    key = F.col("s_suppkey")
    v = frames.observer_vectors(key % 180 - 90.0, key * 7 % 360 - 180.0, key % 40 / 10.0)
    return Tables(spark, sf_dir).supplier.select(
        key, *[F.round(v[c], 5).alias(c) for c in ("obs_x", "obs_y", "obs_z")],
        F.round(v["up_z"], 6).alias("up_z"))


@query("f17_harmonic_match", f"""
    WITH p AS (SELECT o_orderkey, o_totalprice % 50 AS period, CASE WHEN o_orderkey % 9 <> 0 THEN
        o_custkey % 20 + 0.5e0 END AS known_period_days FROM orders)
    SELECT o_orderkey, round(CASE WHEN period > 0 AND known_period_days > 0 THEN
        {HARMONIC.format(found='period')} END, 6) AS harmonic FROM p""")
def _(spark, sf_dir):
    known = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") % 20 + 0.5)
    return Tables(spark, sf_dir).orders.select(
        "o_orderkey", F.round(numeric.harmonic_of(F.col("o_totalprice") % 50, known), 6)
        .alias("harmonic"))


_PMOD = "((({a}) % {b}) + {b}) % {b}"


@query("f18_epoch_phase_offset", f"""
    WITH e AS (SELECT o_orderkey, o_totalprice / 100e0 AS found, 2457500.25e0 + o_custkey % 400 AS known,
        CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 20 + 0.5e0 ELSE 0e0 END AS period FROM orders),
    d AS (SELECT o_orderkey, CASE WHEN period > 0 THEN {_PMOD.format(a='found - (known - 2457000)',
        b='period')} / period END AS d FROM e)
    SELECT o_orderkey, round(least(d, 1 - d), 5) AS phase FROM d""")
def _(spark, sf_dir):
    period = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") % 20 + 0.5).otherwise(
        F.lit(0.0))
    phase = numeric.epoch_phase_offset(F.col("o_totalprice") / 100.0,
                                       F.lit(2457500.25) + F.col("o_custkey") % 400,
                                       F.when(period > 0, period))
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.round(phase, 5).alias("phase"))


MISS = """CASE WHEN known_period_days > 50 THEN 'P=' || format('{:.1f}', known_period_days)
        || ' d > 50 d periodic-search cap (blind spot; needs single-event)'
    WHEN known_depth_ppm < 500 THEN 'shallow (' || format('{:.0f}', known_depth_ppm)
        || ' ppm); best BLS/TLS SNR=' || format('{:.1f}', coalesce(best_snr, 0e0)) || ' < 7'
    WHEN coalesce(best_snr, 0) < 7 THEN 'no signal above SNR 7 (best='
        || format('{:.1f}', coalesce(best_snr, 0e0)) || '); detrending/short baseline?'
    ELSE 'strongest signal did not match catalog P (best SNR='
        || format('{:.1f}', best_snr) || '); wrong-alias/blend?' END"""


@query("f19_miss_reason", with_views("targets") + f"""
    , m AS (SELECT *, CASE WHEN target_id % 5 <> 0 THEN target_id % 20 + 0.3e0 END AS best_snr
            FROM targets)
    SELECT target_id, {MISS} AS reason FROM m""")
def _(spark, sf_dir):
    from starledger.operators.grading import miss_reason

    snr = F.when(F.col("target_id") % 5 != 0, F.col("target_id") % 20 + 0.3)
    return Tables(spark, sf_dir).targets.select("target_id", miss_reason(
        F.col("known_period_days"), F.col("known_depth_ppm"), snr).alias("reason"))


@query("f20_transit_mask", with_views("series") + f"""
    SELECT tic_id, count(*) AS n, round(sum(time), 5) AS kept FROM series
    WHERE abs({_PMOD.format(a='time - 1.3e0 + 1.25e0', b='2.5e0')} - 1.25e0) > 6e0 / 24 / 2 * 1.1e0
    GROUP BY 1""")
def _(spark, sf_dir):
    kept = Tables(spark, sf_dir).series.filter(numeric.outside_transit(
        F.col("time"), F.lit(2.5), F.lit(1.3), F.lit(6.0)))
    return kept.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum("time"), 5).alias("kept"))


_GRID = """g AS (SELECT tic_id, max(time) - min(time) AS baseline FROM series GROUP BY 1),
    s AS (SELECT tic_id, CAST(ceil(ln(13e0 / 0.6e0) / (0.05e0 / greatest(baseline, 1e0) / 2e0))
          AS BIGINT) AS want FROM g),
    n AS (SELECT tic_id, CAST(greatest(want, 3000) AS INTEGER) AS n FROM s)"""


@query("f21_log_period_grid", with_views("series") + f", {_GRID}" + """
    , p AS (SELECT tic_id, n, unnest(range(0, n)) AS i FROM n)
    SELECT tic_id, n, count(*) AS trials, round(sum(0.6e0 * exp(i * ln(13e0 / 0.6e0) / (n - 1))),
           2) AS total FROM p GROUP BY 1, 2""")
def _(spark, sf_dir):
    baseline = Tables(spark, sf_dir).series.groupBy("tic_id").agg(
        (F.max("time") - F.min("time")).alias("baseline"))
    low, high = F.lit(0.6), F.lit(13.0)
    sized = baseline.select("tic_id", numeric.grid_size(F.col("baseline"), low, high).alias("n"))
    trials = periodsearch.trial_periods(sized, F.col("n"), low, high)
    return trials.groupBy("tic_id", "n").agg(
        F.count(F.lit(1)).alias("trials"), F.round(F.sum("period"), 2).alias("total"))


@query("f22_detection_significance", with_views("series") + """
    SELECT tic_id, round(max(flux), 6) AS peak, round((max(flux) - median(flux)) / stddev_pop(flux), 5)
           AS sde FROM series GROUP BY 1""")
def _(spark, sf_dir):
    rows = periodsearch.significance(Tables(spark, sf_dir).series, ["tic_id"], "flux")
    return rows.select("tic_id", F.round("peak", 6).alias("peak"), F.round("sde", 5).alias("sde"))


SIGMA = """med AS (SELECT tic_id, median(flux) AS centre, stddev_pop(flux) AS std FROM series GROUP BY 1),
    mad AS (SELECT tic_id, median(abs(flux - centre)) * 1.4826e0 AS mad FROM series
            JOIN med USING (tic_id) GROUP BY 1),
    noise AS (SELECT tic_id, centre, CASE WHEN mad > 0 THEN mad WHEN std > 0 THEN std ELSE 1e-9 END
              AS sigma FROM med JOIN mad USING (tic_id))"""


@query("f23_robust_scatter", with_views("series") + f", {SIGMA}" + """
    SELECT tic_id, round(centre, 8) AS centre, round(sigma, 10) AS sigma FROM noise""")
def _(spark, sf_dir):
    rows = robust_sigma(Tables(spark, sf_dir).series, ["tic_id"], "flux")
    return rows.select("tic_id", F.round("centre", 8).alias("centre"),
                       F.round("sigma", 10).alias("sigma"))
