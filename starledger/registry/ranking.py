"""Windows, sorts, pages and top-k lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import blocks, dips, orbits, search, selection, sightline
from starledger.operators import conflicts as cf
from starledger.operators import dossier as ds
from starledger.registry import query
from starledger.registry.aggregates import (FIGHTS, FLAGS, HIT_VIEWS, HITS, HOSTS, report_sql,
                                            said_of)
from starledger.registry.joins import SEARCH, numeric_conflict_sql, sight_tables
from starledger.registry.views import Tables, with_views
from starledger.session import scratch_path
from starledger.sources import paged

STRATA = """eligible AS (SELECT *, CASE
        WHEN depth_ppm >= 3000 AND period_days < 10 THEN 'deep_short'
        WHEN depth_ppm >= 3000 AND period_days >= 10 THEN 'deep_long'
        WHEN period_days < 10 THEN 'shallow_short' ELSE 'shallow_long' END AS stratum
        FROM pool WHERE period_days > 0 AND epoch_bjd IS NOT NULL AND depth_ppm IS NOT NULL
        AND tmag IS NOT NULL),
    planets AS (SELECT *, 'gold_planet' AS cohort FROM eligible WHERE tfopwg_disp IN ('CP', 'KP')
        QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY tmag, tic_id, toi) <= 5),
    fps AS (SELECT *, 'gold_fp' AS cohort FROM eligible WHERE tfopwg_disp IN ('FP', 'FA')
        QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY tmag, tic_id, toi) <= 5),
    gold_tics AS (SELECT tic_id FROM planets UNION SELECT tic_id FROM fps),
    singles AS (SELECT *, 'single_transit' AS stratum, 'discovery' AS cohort FROM pool
        WHERE tfopwg_disp IN ('PC', 'APC') AND (period_days IS NULL OR period_days = 0)
        AND epoch_bjd IS NOT NULL AND tmag IS NOT NULL
        AND tic_id NOT IN (SELECT tic_id FROM gold_tics) ORDER BY tmag, tic_id, toi LIMIT 8),
    longs AS (SELECT *, 'long_period' AS stratum, 'discovery' AS cohort FROM pool
        WHERE tfopwg_disp IN ('PC', 'APC') AND period_days >= 30 AND epoch_bjd IS NOT NULL
        AND tmag IS NOT NULL AND tic_id NOT IN (SELECT tic_id FROM gold_tics)
        AND tic_id NOT IN (SELECT tic_id FROM singles) ORDER BY tmag, tic_id, toi LIMIT 10),
    selected AS (SELECT * FROM planets UNION ALL SELECT * FROM fps UNION ALL
        SELECT * FROM singles UNION ALL SELECT * FROM longs)"""


@query("w01_stratified_top_n", with_views("pool") + f", {STRATA}" + """
    SELECT candidate_id, stratum, tmag FROM planets""")
def _(spark, sf_dir):
    rows = selection.gold_cohort(Tables(spark, sf_dir).pool, ["CP", "KP"])
    return rows.select("candidate_id", "stratum", "tmag")


@query("w02_cohort_quota_subset", with_views("targets", "points") + """
    SELECT target_id, cohort, tmag FROM targets t
    WHERE EXISTS (SELECT 1 FROM points p WHERE p.tic_id = t.tic_id)
    QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY tmag NULLS LAST, tic_id, target_id)
        <= CASE cohort WHEN 'gold_planet' THEN 4 ELSE 3 END""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.vetting_subset(t.targets, t.points).select("target_id", "cohort", "tmag")


GAP = 1.5
SEGMENTS = f"""stepped AS (SELECT *, time - lag(time) OVER (PARTITION BY tic_id ORDER BY time, event_id)
        AS step FROM series),
    segmented AS (SELECT *, sum(CASE WHEN step > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY tic_id
        ORDER BY time, event_id) AS segment FROM stepped),
    spans AS (SELECT tic_id, segment, count(*) AS n, min(time) AS first, max(time) AS last
        FROM segmented GROUP BY 1, 2),
    longest AS (SELECT DISTINCT ON (tic_id) * FROM spans
        ORDER BY tic_id, last - first DESC, segment)"""


@query("w03_gap_segmentation", with_views("series") + f", {SEGMENTS}" + """
    SELECT tic_id, CAST(segment AS BIGINT) AS segment, n, round(first, 6) AS first,
           round(last, 6) AS last FROM spans""")
def _(spark, sf_dir):
    parts = blocks.gap_segments(Tables(spark, sf_dir).series, ["tic_id"], "time", GAP)
    return parts.groupBy("tic_id", "segment").agg(
        F.sum("_rows").alias("n"), F.round(F.min("_first"), 6).alias("first"),
        F.round(F.max("_last"), 6).alias("last"))


@query("w03_longest_segment", with_views("series") + f", {SEGMENTS}" + """
    SELECT tic_id, CAST(segment AS BIGINT) AS segment, n, round(first, 6) AS first,
           round(last, 6) AS last FROM longest""")
def _(spark, sf_dir):
    rows = blocks.longest_segment(Tables(spark, sf_dir).series, ["tic_id"], "time", GAP)
    return rows.groupBy("tic_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("time"), 6).alias("first"),
        F.round(F.max("time"), 6).alias("last"))


BOX_DAYS = [0.5, 1.0, 2.0]
BOXES = ", ".join(f"avg(flux) OVER b{i} AS mean_{i}, count(*) OVER b{i} AS count_{i}"
                  for i in range(len(BOX_DAYS)))
BOX_WINDOWS = ", ".join(
    f"b{i} AS (PARTITION BY tic_id ORDER BY time RANGE BETWEEN {d / 2}e0 PRECEDING "
    f"AND {d / 2}e0 FOLLOWING)" for i, d in enumerate(BOX_DAYS))


OWN_DAYS = specs.TRIAL_DURATIONS_DAYS


@query("w04_sliding_box_widths", with_views("monitor") + ", wide AS (" + " UNION ALL ".join(f"""
    SELECT tic_id, event_id, {i} AS width, avg(flux) OVER w AS mean, count(*) OVER w AS n FROM monitor
    WINDOW w AS (PARTITION BY tic_id ORDER BY time RANGE BETWEEN {d / 2}e0 PRECEDING AND {d / 2}e0 FOLLOWING)"""
    for i, d in enumerate(OWN_DAYS)) + """)
    SELECT tic_id, event_id, width, round(mean, 8) AS mean, n FROM wide""")
def _(spark, sf_dir):
    """All eight widths of the operator over dense series, one row per cadence and width."""
    boxed = blocks.sliding_boxes(Tables(spark, sf_dir).monitor, ["tic_id"], "time", "flux", OWN_DAYS)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("width"), F.round(f"mean_{i}", 8).alias("mean"),
                                        F.col(f"count_{i}").alias("n")) for i in range(len(OWN_DAYS))]))
    return boxed.select("tic_id", "event_id", each.alias("box")).select("tic_id", "event_id", "box.*")


@query("w04_sliding_time_box", with_views("series") + f"""
    , boxed AS (SELECT tic_id, event_id, {BOXES} FROM series WINDOW {BOX_WINDOWS})
    SELECT tic_id, event_id, round(mean_0 * count_0, 6) AS sum_0, count_0,
           round(mean_1 * count_1, 6) AS sum_1, count_1, round(mean_2 * count_2, 6) AS sum_2, count_2
    FROM boxed""")
def _(spark, sf_dir):
    boxed = blocks.sliding_boxes(Tables(spark, sf_dir).series, ["tic_id"], "time", "flux", BOX_DAYS)
    return boxed.select("tic_id", "event_id", *[c for i in range(len(BOX_DAYS)) for c in (
        F.round(F.col(f"mean_{i}") * F.col(f"count_{i}"), 6).alias(f"sum_{i}"),
        F.col(f"count_{i}"))])


CENTRES = 20


@query("w05_box_centre_subsample", with_views("series") + f"""
    , numbered AS (SELECT tic_id, event_id, row_number() OVER (PARTITION BY tic_id ORDER BY time)
        - 1 AS i, count(*) OVER (PARTITION BY tic_id) AS n FROM series)
    SELECT tic_id, event_id FROM numbered WHERE i % greatest(1, n // {CENTRES}) = 0""")
def _(spark, sf_dir):
    series = Tables(spark, sf_dir).series
    return dips.box_centres(series, series, ["tic_id"], "time", 4.0, CENTRES).select(
        "tic_id", "event_id")


# --- pages and lists ------------------------------------------------------------------------------


@query("t01_page_of_radius_conflicts", with_views("claims", "candidates", "stars") + ", "
       + numeric_conflict_sql("candidate_id", "planet_radius_re", "0.10") + """
    SELECT eid AS candidate_id, c.canonical_name AS target, s.canonical_name AS host,
           CAST(mn AS DOUBLE) AS min, CAST(mx AS DOUBLE) AS max, n_sources,
           round(spread * 100, 1) AS spread_pct
    FROM conflicted JOIN candidates c ON c.candidate_id = eid JOIN stars s USING (star_id)
    ORDER BY spread DESC, target, eid LIMIT 25 OFFSET 25""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    page = cf.conflict_page(t.claims, t.candidates, t.stars, specs.vocabulary(spark), "radius",
                            25, 25)
    return page.select("candidate_id", "target", "host", F.col("mn").cast("double").alias("min"),
                       F.col("mx").cast("double").alias("max"), "n_sources", "spread_pct")


@query("t01_deep_page_of_a_stored_list", with_views("claims", "candidates", "stars") + ", "
       + numeric_conflict_sql("candidate_id", "planet_radius_re", "0.10") + """
    SELECT row_number() OVER (ORDER BY spread DESC, c.canonical_name, eid) - 1 AS place, eid AS candidate_id,
           c.canonical_name AS target, round(spread * 100, 1) AS spread_pct
    FROM conflicted JOIN candidates c ON c.candidate_id = eid QUALIFY place BETWEEN 990 AND 1039""")
def _(spark, sf_dir):
    """Fifty rows across two ranges of the stored list; the others are not read."""
    t = Tables(spark, sf_dir)
    rows, order = cf.conflict_list(t.claims, t.candidates, t.stars, specs.vocabulary(spark), "radius")
    path = scratch_path(spark, "radius-list")
    paged.store_list(rows, order, path, places=1000)
    return paged.read_page(spark, path, 50, 990, places=1000).select("place", "candidate_id", "target", "spread_pct")


@query("t01_page_of_teff_conflicts", with_views("claims", "candidates", "stars") + ", "
       + numeric_conflict_sql("star_id", "teff_k", "0.05") + """
    , rep AS (SELECT DISTINCT ON (star_id) star_id, candidate_id, canonical_name AS target
              FROM candidates ORDER BY star_id, candidate_id)
    SELECT candidate_id, target, s.canonical_name AS host, n_sources,
           round(spread * 100, 1) AS spread_pct
    FROM conflicted JOIN stars s ON s.star_id = eid JOIN rep USING (star_id)
    ORDER BY spread DESC, host, eid LIMIT 50""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    page = cf.conflict_page(t.claims, t.candidates, t.stars, specs.vocabulary(spark), "teff")
    return page.select("candidate_id", "target", "host", "n_sources", "spread_pct")


@query("t01_page_of_disposition_conflicts", with_views("claims", "vocab", "candidates", "stars")
       + f", {FIGHTS}" + """
    SELECT eid, c.canonical_name AS target, s.canonical_name AS host, dramatic,
           array_to_string(words, ',') AS dispositions
    FROM conflicted JOIN candidates c ON c.candidate_id = eid JOIN stars s USING (star_id)
    ORDER BY dramatic DESC, target, eid LIMIT 50 OFFSET 100""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    page = cf.conflict_page(t.claims, t.candidates, t.stars, specs.vocabulary(spark),
                            "disposition", 50, 100)
    return page.select("eid", "target", "host", "dramatic",
                       F.array_join("dispositions", ",").alias("dispositions"))


@query("t01_conflict_list_totals", with_views("claims", "vocab") + ", "
       + numeric_conflict_sql("candidate_id", "planet_radius_re", "0.10") + """
    SELECT count(*) AS n FROM conflicted""")
def _(spark, sf_dir):
    return cf.conflict_total(Tables(spark, sf_dir).claims, specs.vocabulary(spark), "radius")


@query("t02_ranked_search", with_views("candidates", "stars", "identifiers") + ", "
       + SEARCH.format(q="host 1") + """
    SELECT candidate_id, c.canonical_name AS target, disposition, s.canonical_name AS host, tic_id,
           CAST(rank AS BIGINT) AS rank
    FROM best JOIN candidates c USING (candidate_id) JOIN stars s USING (star_id)
    ORDER BY rank, target, candidate_id LIMIT 50""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.search(t.candidates, t.stars, t.identifiers, " Host 1 ")


# Strings of all kinds: whole names, beginnings, insides, wildcards, a single letter, what no text holds.
_STRINGS = """CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ' ' || CAST(p_partkey % 97 AS STRING)
    WHEN 1 THEN '  Host ' || CAST(p_partkey % 300 AS STRING) || ' ' WHEN 2 THEN CAST(p_partkey * 7 AS STRING)
    WHEN 3 THEN '%g_t ' || CAST(p_partkey % 40 AS STRING) WHEN 4 THEN CAST(p_partkey AS STRING) || '.0'
    ELSE CASE p_partkey % 50 WHEN 5 THEN '%' WHEN 11 THEN 'b' WHEN 17 THEN ' ' WHEN 23 THEN '_9'
    ELSE 'nothing ' || CAST(p_partkey AS STRING) END END"""


@query("t02_search_table_of_strings", with_views("candidates", "stars", "identifiers") + f"""
    , asked AS (SELECT DISTINCT trim({_STRINGS}) AS query FROM part),
    named AS (SELECT canonical_name AS text, candidate_id, NULL AS star_id, 0 AS least FROM candidates
        UNION ALL SELECT id_value, candidate_id, star_id, 0 FROM identifiers
        UNION ALL SELECT canonical_name, NULL, star_id, 2 FROM stars),
    hits AS (SELECT query, candidate_id, star_id, greatest(least, CASE WHEN lower(text) = lower(query) THEN 0
        WHEN text ILIKE query || '%' THEN 1 ELSE 2 END) AS rank
        FROM asked JOIN named ON text ILIKE '%' || query || '%' WHERE query <> ''),
    best AS (SELECT query, candidate_id, min(rank) AS rank FROM (
        SELECT query, candidate_id, rank FROM hits WHERE candidate_id IS NOT NULL UNION ALL
        SELECT query, c.candidate_id, rank FROM hits h JOIN candidates c ON c.star_id = h.star_id
        WHERE h.candidate_id IS NULL) GROUP BY 1, 2)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY rank, c.canonical_name, candidate_id) AS INTEGER)
        AS place, candidate_id, c.canonical_name AS target, s.canonical_name AS host, CAST(rank AS BIGINT) AS rank
    FROM best JOIN candidates c USING (candidate_id) JOIN stars s USING (star_id)
    QUALIFY place <= 50""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    strings = t.part.select(F.expr(_STRINGS).alias("query"))
    return search.search_many(strings, t.candidates, t.stars, t.identifiers, 50).select(
        "query", "place", "candidate_id", "target", "host", "rank")


@query("t03_attribute_display_order", with_views("candidates", "claims", "vocab", "axes")
       + f", {FLAGS}" + """
    SELECT target_id, attribute, row_number() OVER (PARTITION BY target_id
           ORDER BY conflict DESC, axis_rank, attribute) AS place FROM flags""")
def _(spark, sf_dir):
    flags = ds.attribute_flags(said_of(spark, Tables(spark, sf_dir)), specs.attribute_axes(spark))
    # A target has at most as many rows as there are attributes.
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(
        F.col("conflict").desc(), "axis_rank", "attribute"))
    return ds.display_order(flags.withColumn("place", place.cast("bigint"))).select(
        "target_id", "attribute", "place")


@query("t04_discovery_picks", with_views("pool") + f", {STRATA}" + """
    SELECT candidate_id, stratum, tmag FROM singles UNION ALL
    SELECT candidate_id, stratum, tmag FROM longs""")
def _(spark, sf_dir):
    rows = selection.select_targets(Tables(spark, sf_dir).pool)
    return rows.filter("cohort = 'discovery'").select("candidate_id", "stratum", "tmag")


@query("t05_curated_host_list", with_views("stars", "candidates") + f", {HOSTS}" + """
    , famous AS (SELECT * FROM hosts WHERE host IN ('Host 7', 'Host 42', 'TRAPPIST-1'))
    SELECT star_id, host, 'famous' AS category FROM famous
    UNION ALL SELECT * FROM (SELECT star_id, host, 'conflict' FROM hosts WHERE has_conflict
        AND host NOT IN ('Host 7', 'Host 42', 'TRAPPIST-1') ORDER BY host, star_id LIMIT 24)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hosts = selection.host_targets(t.stars, t.candidates)
    return selection.curated_hosts(hosts, ["Host 7", "Host 42", "TRAPPIST-1"]).select(
        "star_id", "host", "category")


@query("t06_capped_pass_list", with_views(*HIT_VIEWS) + f", {HITS}" + """
    SELECT request_id, satellite_id, round(sep, 6) AS sep_deg, row_number() OVER w AS place,
           count(*) OVER (PARTITION BY request_id) > 5 AS truncated
    FROM hits WINDOW w AS (PARTITION BY request_id ORDER BY round(sep, 6), satellite_id)
    QUALIFY row_number() OVER w <= 5""")
def _(spark, sf_dir):
    # Satellites on one orbit are equally far up to the last bit: rank by the rounded separation.
    t = Tables(spark, sf_dir)
    closest = sightline.closest_few(*sight_tables(t), [], 10.0, 20.0, 6)      # one more tells what is cut off
    hits = sightline.with_owner(closest, orbits.current_owners(t.ownership, t.operators)).withColumn(
        "sep_deg", F.round("sep_deg", 6))
    counts = sightline.hit_counts(hits, 5)
    return sightline.capped_hits(hits, 5).join(counts, "request_id").select(
        "request_id", "satellite_id", "sep_deg", F.col("place").cast("bigint").alias("place"), "truncated")


@query("t07_report_examples", with_views("claims") + ", "
       + report_sql("star_id", "teff_k", 0.05) + """
    SELECT eid, detail, round((max - min) / max, 6) AS spread FROM reported
    ORDER BY (max - min) / max DESC, eid LIMIT 12""")
def _(spark, sf_dir):
    found = cf.report_conflicts(Tables(spark, sf_dir).claims, "star_id", "teff_k", 0.05)
    top = cf.page(found, [F.col("spread").desc(), F.col("eid")], specs.REPORT_EXAMPLES)
    return top.select("eid", "detail", F.round("spread", 6).alias("spread"))
