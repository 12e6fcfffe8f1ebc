"""Identifier links, sky match, claim extraction and the other joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.numeric import rounded
from starledger.operators import claims as cl
from starledger.operators import conflicts as cf
from starledger.operators import dossier as ds
from starledger.operators import grading, links, orbits, search, selection, sightline
from starledger.operators import skymatch
from starledger.plans import graph
from starledger.registry import query
from starledger.registry.snapshots import raw_tables
from starledger.registry.views import Tables, with_views

_TIC_RAW = ("raw_exofop_toi", "raw_exofop_ctoi", "raw_nea_toi", "raw_ps", "raw_pscomppars")
_TAGGED = [("raw_exofop_toi", "tic_id", "exofop"), ("raw_exofop_ctoi", "tic_id", "exofop"),
           ("raw_nea_toi", "tid", "nea"), ("raw_ps", "tic_id", "nea"),
           ("raw_pscomppars", "tic_id", "nea")]
_TIC_SEEN = "seen AS (" + " UNION ".join(
    f"SELECT {c} AS tic_id, '{tag}' AS source FROM {t} WHERE {c} IS NOT NULL"
    for t, c, tag in _TAGGED) + ")"


@query("j01_exact_tic_link", with_views("stars", *_TIC_RAW) + ", " + _TIC_SEEN + """
    SELECT s.star_id, 'tic' AS id_type, CAST(seen.tic_id AS VARCHAR) AS id_value, source,
           'tic_exact' AS rule, 1e0 AS score
    FROM seen JOIN stars s ON s.tic_id = seen.tic_id""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = raw_tables(t)
    rows = links.tic_links(t.stars.filter("tic_id IS NOT NULL"),
                           [(raw[n], c, tag) for n, c, tag in _TAGGED])
    return rows.select("star_id", "id_type", "id_value", "source", "rule",
                       F.col("score").cast("double").alias("score"))


_HOST_ROWS = """hosts AS (
    SELECT tic_id, hostname, gaia_id, hd_name, hip_name, ra_deg AS ra, dec_deg AS dec FROM raw_ps
    UNION ALL SELECT tic_id, hostname, gaia_id, hd_name, hip_name, ra_deg, dec_deg
    FROM raw_pscomppars)"""
_SECONDARY = "named AS (" + " UNION ".join(
    f"SELECT tic_id, '{k}' AS id_type, {c} AS id_value FROM hosts"
    for k, c in graph.SECONDARY_IDS.items()) + ")"


@query("j02_secondary_identifier_link", with_views("stars", "raw_ps", "raw_pscomppars") + ", "
       + _HOST_ROWS + ", " + _SECONDARY + """
    SELECT s.star_id, id_type, id_value, 'nea' AS source, 'catalog_xref' AS rule
    FROM named n JOIN stars s ON s.tic_id = n.tic_id
    WHERE id_value IS NOT NULL AND id_value <> ''""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = links.secondary_links(t.stars.filter("tic_id IS NOT NULL"),
                                 graph.host_rows(raw_tables(t)), graph.SECONDARY_IDS)
    return rows.select("star_id", "id_type", "id_value", "source", "rule")


@query("j03_hosts_without_star", with_views("raw_ps", "raw_pscomppars") + ", " + _HOST_ROWS + """
    SELECT hostname, count(*) AS n FROM hosts h
    WHERE tic_id IS NULL AND hostname IS NOT NULL AND hostname <> '' AND NOT EXISTS (
        SELECT 1 FROM hosts k WHERE k.hostname = h.hostname AND k.tic_id IS NOT NULL)
    GROUP BY 1""")
def _(spark, sf_dir):
    hosts = graph.host_rows(raw_tables(Tables(spark, sf_dir)))
    named = hosts.filter("tic_id IS NOT NULL AND hostname <> ''").select("hostname").distinct()
    return links.hosts_without_star(hosts, named).groupBy("hostname").agg(
        F.count(F.lit(1)).alias("n"))


# Host stars as a sky catalog; Kepler hosts lie 0 to 2.4 arcsec away or have no position.
_SKY = """sky AS (SELECT DISTINCT ON (o_custkey) o_custkey AS star_id, ra, dec FROM (
        SELECT o_custkey, (o_custkey * 137.50776405003785e0) % 360e0 AS ra,
               degrees(asin(2e0 * ((o_custkey * 0.7548776662466927e0) % 1e0) - 1e0)) AS dec
        FROM orders) ORDER BY o_custkey, ra, dec),
    near AS (SELECT kepid, star_id, 3600 * degrees(2 * asin(sqrt(
        pow(sin(radians(s.dec - k.dec_deg) / 2), 2) + cos(radians(s.dec)) * cos(radians(k.dec_deg))
        * pow(sin(radians(s.ra - k.ra_deg) / 2), 2)))) AS sep
        FROM raw_koi_cumulative k JOIN sky s ON abs(s.dec - k.dec_deg) < 0.001
        WHERE k.ra_deg IS NOT NULL),
    best AS (SELECT DISTINCT ON (kepid) * FROM near WHERE sep < 2 ORDER BY kepid, sep, star_id)"""


def _sky(t: Tables):
    key = F.col("o_custkey")
    return t.orders.select(key).distinct().select(
        key.alias("star_id"), ((key * F.lit(137.50776405003785)) % F.lit(360.0)).alias("ra_deg"),
        F.degrees(F.asin(F.lit(2.0) * ((key * F.lit(0.7548776662466927)) % F.lit(1.0)) - F.lit(1.0)))
        .alias("dec_deg"))


@query("j04_sky_match", with_views("raw_koi_cumulative") + ", " + _SKY + """
    SELECT kepid, star_id, round(sep, 3) AS sep_arcsec, round(1 - sep / 2, 2) AS score,
           round(greatest(0.8, 1 - sep / 2), 2) AS confidence FROM best""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = skymatch.nearest_star(_sky(t), t.raw_koi_cumulative, "kepid")
    sep = F.col("sep_arcsec")
    return found.select("kepid", "star_id", F.round(sep, 3).alias("sep_arcsec"),
                        F.round(skymatch.match_score(sep), 2).alias("score"),
                        skymatch.match_confidence(sep).alias("confidence"))


@query("j05_unmatched_probes_mint_stars", with_views("raw_koi_cumulative") + ", " + _SKY + """
    , top AS (SELECT max(star_id) AS m FROM sky)
    SELECT kepid, coalesce(nullif(trim(regexp_replace(kepler_name, '\\s+[a-z]$', '')), ''),
           'KIC ' || kepid) AS canonical_name, m + row_number() OVER (ORDER BY kepid) AS star_id
    FROM raw_koi_cumulative, top WHERE kepid NOT IN (SELECT kepid FROM best)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    minted, _, _ = graph.match_kois({"raw_koi_cumulative": t.raw_koi_cumulative}, _sky(t),
                                    specs.SKY_TOLERANCE_ARCSEC)
    kepid = F.regexp_extract("canonical_name", "([0-9]+)", 1).cast("bigint")
    return minted.select(kepid.alias("kepid"), "canonical_name", "star_id")


_OBS = """obs AS (
    SELECT 0 AS source_order, raw_id, 'toi' AS id_type, toi AS id_value, 'exofop' AS source, tic_id,
           CAST(NULL AS BIGINT) AS kepid, CAST(NULL AS VARCHAR) AS hostname,
           CAST(period_days AS DOUBLE) AS period, CAST(NULL AS VARCHAR) AS planet_name
    FROM raw_exofop_toi
    UNION ALL SELECT 1, raw_id, 'toi', toi, 'nea', tid, NULL, NULL, period_days, NULL FROM raw_nea_toi
    UNION ALL SELECT 2, raw_id, 'ctoi', ctoi, 'exofop', tic_id, NULL, NULL, period_days, NULL
              FROM raw_exofop_ctoi
    UNION ALL SELECT 3, raw_id, 'koi', kepoi_name, 'nea', NULL, kepid, NULL, period_days, kepler_name
              FROM raw_koi_cumulative
    UNION ALL SELECT 4, raw_id, 'name', pl_name, 'nea', tic_id, NULL, hostname, period_days, pl_name
              FROM (SELECT DISTINCT ON (pl_name) * FROM raw_ps ORDER BY pl_name,
                    default_flag DESC NULLS LAST, period_days IS NULL, period_days NULLS FIRST,
                    tic_id NULLS FIRST, hostname, raw_id)
    UNION ALL SELECT 5, raw_id, 'name', pl_name, 'nea', tic_id, NULL, hostname, period_days, pl_name
              FROM raw_pscomppars)"""
OBS_VIEWS = ("raw_exofop_toi", "raw_nea_toi", "raw_exofop_ctoi", "raw_koi_cumulative", "raw_ps",
             "raw_pscomppars")


@query("u03_union_of_observations", with_views(*OBS_VIEWS) + ", " + _OBS + """
    SELECT source_order, id_type, source, count(*) AS n, count(period) AS n_period,
           count(planet_name) AS n_planet, count(tic_id) AS n_tic FROM obs GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    rows = graph.observations(raw_tables(Tables(spark, sf_dir)))
    return rows.groupBy("source_order", "id_type", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("period").alias("n_period"),
        F.count("planet_name").alias("n_planet"), F.count("tic_id").alias("n_tic"))


# Lookup tables for J06: TICs not divisible by three, KICs below the TICs' range, bare hosts.
@query("j06_observation_to_star", with_views("stars", *OBS_VIEWS) + ", " + _OBS + """
    , hit AS (SELECT obs.*, coalesce(s.star_id, k.star_id, h.star_id) AS star FROM obs
      LEFT JOIN stars s ON s.tic_id = obs.tic_id
      LEFT JOIN stars k ON k.star_id = obs.kepid
      LEFT JOIN (SELECT star_id, 'HD ' || star_id AS name FROM stars WHERE tic_id IS NULL) h
             ON h.name = obs.hostname)
    SELECT star AS star_id, source_order, id_type, id_value FROM hit
    WHERE star IS NOT NULL AND id_value <> ''""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    bare = t.stars.filter("tic_id IS NULL").select(
        F.concat(F.lit("HD "), F.col("star_id").cast("string")).alias("hostname"), "star_id")
    rows = links.attach_star(
        graph.observations(raw_tables(t)),
        t.stars.filter("tic_id IS NOT NULL").select("tic_id", "star_id"),
        t.stars.select(F.col("star_id").alias("kepid"), "star_id"), bare)
    return rows.select("star_id", "source_order", "id_type", "id_value")


# Planet names attached to one candidate per order and customer: many-to-many on purpose.
_NAME_LINKS = """name_links AS (SELECT DISTINCT 'HD ' || o_custkey || CASE o_orderkey % 3
    WHEN 0 THEN ' b' WHEN 1 THEN ' c' ELSE ' d' END AS id_value, o_custkey * 3 + o_orderkey % 2
    AS candidate_id FROM orders)"""
_PS_CLAIMS = """said AS (
    SELECT pl_name, raw_id, pl_refname, 'period_days' AS attribute, CAST(period_days AS DOUBLE) AS v,
           NULL AS word, 'days' AS unit FROM raw_ps
    UNION ALL SELECT pl_name, raw_id, pl_refname, 'planet_radius_re', planet_radius_re, NULL,
              'R_earth' FROM raw_ps
    UNION ALL SELECT pl_name, raw_id, pl_refname, 'depth_ppm', CAST(depth_pct AS DOUBLE) * 10000,
              NULL, 'ppm' FROM raw_ps
    UNION ALL SELECT pl_name, raw_id, pl_refname, 'duration_hr', duration_hr, NULL, 'hr' FROM raw_ps
    UNION ALL SELECT pl_name, raw_id, pl_refname, 'epoch_bjd', epoch_bjd, NULL, 'bjd' FROM raw_ps
    UNION ALL SELECT pl_name, raw_id, pl_refname, 'disposition', NULL, CASE WHEN pl_controv_flag = 1
              THEN 'CONTROVERSIAL' ELSE soltype END, NULL FROM raw_ps)"""


@query("j07_claim_extraction", with_views("raw_ps") + f", {_NAME_LINKS}, {_PS_CLAIMS}" + """
    SELECT candidate_id, pl_name AS source_key, attribute, unit, 'ps' AS source,
           pl_refname AS source_ref, raw_id, round(v, 6) AS number, word
    FROM said JOIN name_links ON id_value = pl_name WHERE v IS NOT NULL OR word IS NOT NULL""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    letter = (F.when(F.col("o_orderkey") % 3 == 0, " b").when(F.col("o_orderkey") % 3 == 1, " c")
              .otherwise(" d"))
    owned = t.orders.select(
        F.lit(None).cast("bigint").alias("star_id"),
        (F.col("o_custkey") * 3 + F.col("o_orderkey") % 2).alias("candidate_id"),
        F.lit("name").alias("id_type"),
        F.concat(F.lit("HD "), F.col("o_custkey").cast("string"), letter).alias("id_value"),
        F.lit("nea").alias("source")).distinct()
    spec = next(s for s in cl.CLAIM_SOURCES if s.source == "ps" and s.owner == "candidate")
    said = cl.claims_of(t.raw_ps, owned, spec)
    is_word = F.col("attribute") == "disposition"
    return said.select(
        "candidate_id", "source_key", "attribute", "unit", "source", "source_ref", "raw_id",
        F.round(F.when(~is_word, F.col("value").try_cast("double")), 6).alias("number"),
        F.when(is_word, F.col("value")).alias("word"))


def _said_by_all() -> str:
    """Every value of every claim source, one SELECT per attribute."""
    parts = []
    for spec in cl.CLAIM_SOURCES:
        attributes = cl.CANDIDATE_UNITS if spec.owner == "candidate" else [
            (a, u) for a, u in cl.STAR_UNITS if a in cl.STAR_ATTRIBUTES[spec.source]]
        for attribute, unit in attributes:
            number, word = f"CAST({attribute} AS DOUBLE)", "NULL"
            if attribute == "depth_ppm" and spec.source in ("ps", "pscomppars"):
                number = "CAST(depth_pct AS DOUBLE) * 10000"
            if attribute == "disposition":
                number, word = "NULL", {
                    "ps": "CASE WHEN pl_controv_flag = 1 THEN 'CONTROVERSIAL' ELSE soltype END",
                    "pscomppars": "'CONFIRMED'"}.get(spec.source) or cl.DISPOSITION_COLUMN[spec.source]
            parts.append(f"SELECT '{spec.owner}' AS owner, '{spec.id_type}' AS id_type, '{spec.asserted_by}' AS asserted_by, "
                         f"CAST({spec.key} AS VARCHAR) AS source_key, '{spec.source}' AS source, "
                         f"'{attribute}' AS attribute, {f"'{unit}'" if unit else 'NULL'} AS unit, "
                         f"{spec.reference or 'NULL'} AS source_ref, raw_id, {number} AS number, {word} AS word "
                         f"FROM {spec.table}")
    return "said_all AS (" + " UNION ALL ".join(parts) + ")"


@query("j07_claims_of_all_sources", with_views(*OBS_VIEWS) + f", {_said_by_all()}" + """
    , keys AS (SELECT owner, id_type, asserted_by, source_key, min(raw_id) AS owner_id FROM said_all
               WHERE source_key IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT owner, owner_id, source_key, attribute, unit, source, source_ref, raw_id,
           round(number, 6) AS number, word
    FROM said_all JOIN keys USING (owner, id_type, asserted_by, source_key)
    WHERE number IS NOT NULL OR word IS NOT NULL""")
def _(spark, sf_dir):
    raw = raw_tables(Tables(spark, sf_dir))
    # One entity per identifier: the first row that carries it.
    keys = links.union_all([
        raw[s.table].select(F.lit(s.owner).alias("owner"), F.lit(s.id_type).alias("id_type"),
                            F.lit(s.asserted_by).alias("source"), F.col(s.key).cast("string").alias("id_value"),
                            "raw_id").filter("id_value IS NOT NULL") for s in cl.CLAIM_SOURCES])
    owned = keys.groupBy("owner", "id_type", "source", "id_value").agg(F.min("raw_id").alias("id")).select(
        "id_type", "source", "id_value", F.when(F.col("owner") == "star", F.col("id")).alias("star_id"),
        F.when(F.col("owner") == "candidate", F.col("id")).alias("candidate_id"))
    is_word = F.col("attribute") == "disposition"
    return cl.all_claims(raw, owned).select(
        F.when(F.col("star_id").isNotNull(), "star").otherwise("candidate").alias("owner"),
        F.coalesce("star_id", "candidate_id").alias("owner_id"), "source_key", "attribute", "unit", "source",
        "source_ref", "raw_id", F.round(F.when(~is_word, F.col("value").try_cast("double")), 6).alias("number"),
        F.when(is_word, F.col("value")).alias("word"))


MAPPED = """mapped AS (SELECT candidate_id AS eid, c.source, canonical AS canon FROM claims c
    JOIN vocab v ON v.source = c.source AND v.source_value = c.value
    WHERE attribute = 'disposition' AND candidate_id IS NOT NULL)"""


@query("j08_claims_with_vocabulary", with_views("claims", "vocab") + f", {MAPPED}" + """
    SELECT eid, source, canon, count(*) AS n FROM mapped GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    mapped = cf.mapped_dispositions(Tables(spark, sf_dir).claims, specs.vocabulary(spark))
    return mapped.groupBy("eid", "source", "canon").agg(F.count(F.lit(1)).alias("n"))


@query("j09_optional_vocabulary", with_views("claims", "vocab") + """
    SELECT attribute, c.source, canonical AS canonical_disposition, count(*) AS n
    FROM claims c LEFT JOIN vocab v ON c.attribute = 'disposition' AND v.source = c.source
         AND v.source_value = c.value GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    said = ds.claims_with_words(Tables(spark, sf_dir).claims, specs.vocabulary(spark))
    return said.groupBy("attribute", "source", "canonical_disposition").agg(
        F.count(F.lit(1)).alias("n"))


def numeric_conflict_sql(eid: str, attribute: str, threshold: str) -> str:
    return f"""vals AS (SELECT {eid} AS eid, CAST(TRY_CAST(value AS DOUBLE) AS DECIMAL(28,10)) AS v,
        source FROM claims WHERE attribute = '{attribute}' AND {eid} IS NOT NULL
        AND regexp_matches(value, '{specs.NUMBER_PATTERN}')),
    agg AS (SELECT eid, min(v) AS mn, max(v) AS mx, count(DISTINCT v) AS n_values,
        count(DISTINCT source) AS n_sources FROM vals GROUP BY eid),
    conflicted AS (SELECT eid, mn, mx, n_sources, CAST(mx - mn AS DOUBLE) / CAST(mx AS DOUBLE)
        AS spread FROM agg WHERE n_values >= 2 AND n_sources >= 2 AND mx > 0
        AND (mx - mn) > CAST('{threshold}' AS DECIMAL(3,2)) * mx)"""


_REP = """rep AS (SELECT DISTINCT ON (star_id) star_id, candidate_id, canonical_name AS target,
    disposition FROM candidates ORDER BY star_id, candidate_id)"""


@query("j10_conflicts_with_labels", with_views("claims", "candidates", "stars") + ", "
       + numeric_conflict_sql("candidate_id", "planet_radius_re", "0.10") + """
    SELECT eid, c.canonical_name AS target, c.disposition, s.canonical_name AS host, s.tic_id,
           round(spread, 6) AS spread
    FROM conflicted JOIN candidates c ON c.candidate_id = eid JOIN stars s USING (star_id)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = cf.numeric_conflicts(t.claims, "candidate_id", "planet_radius_re", "0.10")
    return cf.label_candidates(found, t.candidates, t.stars).select(
        "eid", "target", "disposition", "host", "tic_id", F.round("spread", 6).alias("spread"))


@query("j11_representative_candidate", with_views("candidates") + f", {_REP}" + """
    SELECT star_id, candidate_id, target, disposition FROM rep""")
def _(spark, sf_dir):
    return cf.first_candidate(Tables(spark, sf_dir).candidates)


SEARCH_HOST = "host 12"


@query("j12_host_hit_expands", with_views("candidates", "stars", "identifiers") + f"""
    , hosts AS (SELECT star_id FROM stars WHERE canonical_name ILIKE '%{SEARCH_HOST}%'
        UNION SELECT star_id FROM identifiers WHERE star_id IS NOT NULL AND id_value ILIKE '%{SEARCH_HOST}%'),
    hit AS (SELECT candidate_id FROM candidates JOIN hosts USING (star_id)
        UNION SELECT candidate_id FROM candidates WHERE canonical_name ILIKE '%{SEARCH_HOST}%'
        UNION SELECT candidate_id FROM identifiers WHERE candidate_id IS NOT NULL
              AND id_value ILIKE '%{SEARCH_HOST}%')
    SELECT c.candidate_id, c.canonical_name AS target, s.canonical_name AS host
    FROM hit JOIN candidates c USING (candidate_id) JOIN stars s USING (star_id)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.search(t.candidates, t.stars, t.identifiers, SEARCH_HOST, None).select(
        "candidate_id", "target", "host")


# Tokens of all kinds: ids, TOIs, shared planet names, host names, TICs, and nonsense.
_IDENTS = """idents AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS VARCHAR)
    WHEN 1 THEN upper(p_name) || ' B' WHEN 2 THEN ' HOST ' || (p_partkey // 8) WHEN 3
    THEN p_partkey || '.01' WHEN 4 THEN CAST(p_partkey * 7 AS VARCHAR) ELSE 'nothing ' || p_partkey
    END AS ident FROM part)"""


@query("j13_batch_target_resolution", with_views("candidates", "stars", "identifiers")
       + f", {_IDENTS}" + """
    , t AS (SELECT ident, lower(trim(ident)) AS token FROM idents),
    first AS (SELECT star_id, min(candidate_id) AS candidate_id FROM candidates GROUP BY 1),
    hits AS (
        SELECT ident, 0 AS tier, c.candidate_id FROM t JOIN candidates c
               ON regexp_matches(token, '^[0-9]+$') AND TRY_CAST(token AS BIGINT) = c.candidate_id
        UNION ALL SELECT ident, 1, c.candidate_id FROM t JOIN candidates c
               ON lower(c.canonical_name) = token
        UNION ALL SELECT ident, 1, i.candidate_id FROM t JOIN identifiers i
               ON lower(i.id_value) = token AND i.candidate_id IS NOT NULL
        UNION ALL SELECT ident, 2, f.candidate_id FROM t JOIN stars s
               ON lower(s.canonical_name) = token JOIN first f USING (star_id)
        UNION ALL SELECT ident, 2, f.candidate_id FROM t JOIN identifiers i
               ON lower(i.id_value) = token AND i.star_id IS NOT NULL
               JOIN first f ON f.star_id = i.star_id)
    SELECT DISTINCT ON (ident) ident, candidate_id FROM hits ORDER BY ident, tier, candidate_id""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    ident = (F.when(key % 6 == 0, text)
             .when(key % 6 == 1, F.concat(F.upper("p_name"), F.lit(" B")))
             .when(key % 6 == 2, F.concat(F.lit(" HOST "),
                                          F.floor(key / 8).cast("bigint").cast("string")))
             .when(key % 6 == 3, F.concat(text, F.lit(".01")))
             .when(key % 6 == 4, (key * 7).cast("string"))
             .otherwise(F.concat(F.lit("nothing "), text)))
    return search.resolve_idents(t.part.select(ident.alias("ident")), t.candidates, t.stars,
                                 t.identifiers)


def representative_targets(t: Tables):
    """One target per star: its first candidate."""
    return cf.first_candidate(t.candidates).select("candidate_id", "star_id")


@query("j14_sibling_candidates", with_views("candidates") + f", {_REP}" + """
    SELECT r.candidate_id AS target_id, c.candidate_id, c.canonical_name, c.disposition
    FROM rep r JOIN candidates c ON c.star_id = r.star_id AND c.candidate_id <> r.candidate_id""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ds.siblings(representative_targets(t), t.candidates)


@query("j15_crosswalk_fetch", with_views("candidates", "identifiers") + f", {_REP}" + """
    SELECT r.candidate_id AS target_id, CASE WHEN i.candidate_id IS NOT NULL THEN 'candidate'
           ELSE 'star' END AS owner, id_type, id_value, source, confidence
    FROM rep r JOIN identifiers i ON i.candidate_id = r.candidate_id
    UNION ALL SELECT r.candidate_id, 'star', id_type, id_value, source, confidence
    FROM rep r JOIN identifiers i ON i.star_id = r.star_id""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ds.identifiers(representative_targets(t), t.identifiers)


_PAGE = """page AS (SELECT eid FROM conflicted JOIN candidates c ON c.candidate_id = eid
    ORDER BY spread DESC, c.canonical_name, eid LIMIT 50)"""


@query("j16_page_provenance_numeric", with_views("claims", "candidates") + ", "
       + numeric_conflict_sql("candidate_id", "planet_radius_re", "0.10") + f", {_PAGE}" + """
    SELECT eid, source, CAST(min(v) AS DOUBLE) AS mn, CAST(max(v) AS DOUBLE) AS mx, count(*) AS n
    FROM vals WHERE eid IN (SELECT eid FROM page) GROUP BY 1, 2""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    page = cf.conflict_page(t.claims, t.candidates, t.stars, specs.vocabulary(spark), "radius")
    return cf.provenance_numeric(t.claims, "candidate_id", "planet_radius_re", page).select(
        "eid", "source", F.col("mn").cast("double").alias("mn"),
        F.col("mx").cast("double").alias("mx"), "n")


@query("j16_page_provenance_disposition", with_views("claims", "vocab", "candidates")
       + f", {MAPPED}" + """
    , conflicted AS (SELECT eid, bool_or(canon = 'FALSE_POSITIVE') AND bool_or(canon IN
        ('CONFIRMED', 'KNOWN_PLANET')) AS dramatic FROM mapped GROUP BY eid
        HAVING count(DISTINCT canon) >= 2),
    page AS (SELECT eid FROM conflicted JOIN candidates c ON c.candidate_id = eid
        ORDER BY dramatic DESC, c.canonical_name, eid LIMIT 50)
    SELECT DISTINCT eid, source, canon FROM mapped WHERE eid IN (SELECT eid FROM page)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    words = specs.vocabulary(spark)
    page = cf.conflict_page(t.claims, t.candidates, t.stars, words, "disposition")
    return cf.provenance_dispositions(t.claims, words, page)


@query("j17_target_pool", with_views("candidates", "stars", "identifiers", "raw_exofop_toi") + """
    SELECT DISTINCT ON (c.candidate_id) c.candidate_id, s.tic_id, i.id_value AS toi,
           c.disposition AS canonical_disp, r.tfopwg_disposition AS tfopwg_disp,
           CAST(r.period_days AS DOUBLE) AS period_days, CAST(r.tmag AS DOUBLE) AS tmag
    FROM candidates c JOIN stars s ON s.star_id = c.star_id AND s.tic_id IS NOT NULL
    JOIN identifiers i ON i.candidate_id = c.candidate_id AND i.id_type = 'toi'
    JOIN raw_exofop_toi r ON r.toi = i.id_value ORDER BY c.candidate_id, r.raw_id""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = selection.target_pool(t.candidates, t.stars, t.identifiers, t.raw_exofop_toi)
    return rows.select("candidate_id", "tic_id", "toi", "canonical_disp", "tfopwg_disp",
                       F.col("period_days").cast("double").alias("period_days"),
                       F.col("tmag").cast("double").alias("tmag"))


@query("j18_targets_with_light_curve", with_views("targets", "points") + """
    SELECT target_id, tic_id FROM targets t
    WHERE EXISTS (SELECT 1 FROM points p WHERE p.tic_id = t.tic_id)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.targets.join(t.points.select("tic_id").distinct(), "tic_id", "left_semi").select(
        "target_id", "tic_id")


CURRENT = """newest AS (SELECT target_id, max(pipeline_run_id) AS pipeline_run_id FROM runs GROUP BY 1),
    current AS (SELECT target_id, d.* FROM detections d JOIN newest USING (pipeline_run_id))"""


@query("j19_detections_of_latest_run", with_views("runs", "detections") + f", {CURRENT}" + """
    SELECT target_id, pipeline_run_id, method, rank, round(snr, 6) AS snr FROM current""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grading.current_detections(t.runs, t.detections).select(
        "target_id", "pipeline_run_id", "method", "rank", F.round("snr", 6).alias("snr"))


OWNERS = """owners AS (SELECT satellite_id, o.canonical_name AS operator FROM ownership
    JOIN operators o USING (operator_id) WHERE role = 'owner' AND valid_to IS NULL)"""
# One label per satellite: the first by name where several owners are open.
OWNER = f"{OWNERS}, owner AS (SELECT satellite_id, min(operator) AS operator FROM owners GROUP BY 1)"


@query("j20_current_owner_labels", with_views("satellites", "ownership", "operators")
       + f", {OWNER}" + """
    SELECT s.satellite_id, coalesce(operator, 'Unattributed') AS operator
    FROM satellites s LEFT JOIN owner USING (satellite_id)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    owners = orbits.current_owners(t.ownership, t.operators)
    return sightline.with_owner(t.satellites, owners).select(
        "satellite_id", F.coalesce("operator", F.lit("Unattributed")).alias("operator"))


# Directions of the closed-form satellites against one sightline per supplier, 10 degrees apart.
SIGHT = """dirs AS (SELECT satellite_id, step, x / sqrt(x*x + y*y + z*z) AS ux,
        y / sqrt(x*x + y*y + z*z) AS uy, z / sqrt(x*x + y*y + z*z) AS uz FROM circular
        WHERE error = 0 AND z > 0),
    lines AS (SELECT request_id, cos(radians(dec)) * cos(radians(ra)) AS gx,
        cos(radians(dec)) * sin(radians(ra)) AS gy, sin(radians(dec)) AS gz FROM requests
        WHERE dec >= 20),
    near AS (SELECT request_id, satellite_id, step, degrees(acos(least(1, greatest(-1,
        ux*gx + uy*gy + uz*gz)))) AS sep FROM lines CROSS JOIN dirs
        WHERE ux*gx + uy*gy + uz*gz > cos(radians(11)))"""


def sight_tables(t: Tables):
    """(sightlines, directions): one line per request, the closed-form satellites at every step."""
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    seen = t.circular.withColumns({f"u_{a}": F.col(a) / norm for a in "xyz"}).withColumn(
        "sat_alt_deg", F.col("z")).drop("x", "y", "z")
    ra, dec = F.radians("ra"), F.radians("dec")
    track = t.requests.select(
        "request_id", (F.cos(dec) * F.cos(ra)).alias("g_x"), (F.cos(dec) * F.sin(ra)).alias("g_y"),
        F.sin(dec).alias("g_z"), F.col("dec").alias("target_alt_deg"), F.col("start").alias("instant"))
    return track, seen


def sight_pairs(t: Tables):
    """Close approaches of the closed-form satellites, every step seen by every request."""
    return sightline.fixed_approaches(*sight_tables(t), 10.0, 20.0, [])


@query("j21_sightline_proximity", with_views("circular", "requests") + f", {SIGHT}" + """
    SELECT request_id, satellite_id, CAST(step AS INTEGER) AS step, round(sep, 6) AS sep_deg
    FROM near WHERE sep < 10""")
def _(spark, sf_dir):
    return sight_pairs(Tables(spark, sf_dir)).select(
        "request_id", "satellite_id", F.col("step").cast("int").alias("step"),
        rounded(F.col("sep_deg"), 6).alias("sep_deg"))


# --- set operations ------------------------------------------------------------------------------


@query("u01_union_of_star_sources", with_views(*_TIC_RAW) + """
    SELECT tic, count(*) AS n, count(hostname) AS n_named, count(ra) AS n_placed FROM (
        SELECT tic_id AS tic, NULL AS hostname, ra_deg AS ra FROM raw_exofop_ctoi
        UNION ALL SELECT tid, NULL, ra_deg FROM raw_nea_toi
        UNION ALL SELECT tic_id, NULL, NULL FROM raw_exofop_toi
        UNION ALL SELECT tic_id, hostname, ra_deg FROM raw_ps
        UNION ALL SELECT tic_id, hostname, ra_deg FROM raw_pscomppars) WHERE tic IS NOT NULL
    GROUP BY 1""")
def _(spark, sf_dir):
    rows = graph.star_observations(raw_tables(Tables(spark, sf_dir)))
    return rows.groupBy("tic").agg(F.count(F.lit(1)).alias("n"),
                                   F.count("hostname").alias("n_named"),
                                   F.count("ra").alias("n_placed"))


SEARCH = """matches AS (
    SELECT candidate_id, CASE WHEN lower(canonical_name) = lower('{q}') THEN 0
           WHEN canonical_name ILIKE '{q}%' THEN 1 ELSE 2 END AS rank FROM candidates
    WHERE canonical_name ILIKE '%{q}%'
    UNION ALL SELECT candidate_id, CASE WHEN lower(id_value) = lower('{q}') THEN 0
           WHEN id_value ILIKE '{q}%' THEN 1 ELSE 2 END FROM identifiers
    WHERE candidate_id IS NOT NULL AND id_value ILIKE '%{q}%'
    UNION ALL SELECT c.candidate_id, 2 FROM candidates c JOIN stars s USING (star_id)
    WHERE s.canonical_name ILIKE '%{q}%'
    UNION ALL SELECT c.candidate_id, CASE WHEN lower(id_value) = lower('{q}') THEN 0
           WHEN id_value ILIKE '{q}%' THEN 1 ELSE 2 END
    FROM identifiers i JOIN candidates c ON c.star_id = i.star_id
    WHERE i.star_id IS NOT NULL AND id_value ILIKE '%{q}%'),
    best AS (SELECT candidate_id, min(rank) AS rank FROM matches GROUP BY 1)"""


@query("u02_union_of_match_branches", with_views("candidates", "stars", "identifiers") + ", "
       + SEARCH.format(q="17") + """
    SELECT candidate_id, CAST(rank AS BIGINT) AS rank FROM best""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.search(t.candidates, t.stars, t.identifiers, "17", None).select(
        "candidate_id", "rank")


@query("u04_cohort_union_without_reuse", with_views("pool") + """
    , gold AS (SELECT DISTINCT tic_id FROM pool WHERE tfopwg_disp IN ('CP', 'KP', 'FP', 'FA'))
    SELECT candidate_id, tic_id, 'gold' AS cohort FROM pool WHERE tfopwg_disp IN ('CP', 'KP', 'FP', 'FA')
    UNION ALL SELECT candidate_id, tic_id, 'discovery' FROM pool
    WHERE tfopwg_disp IN ('PC', 'APC') AND tic_id NOT IN (SELECT tic_id FROM gold)""")
def _(spark, sf_dir):
    pool = Tables(spark, sf_dir).pool
    gold = pool.filter(F.col("tfopwg_disp").isin("CP", "KP", "FP", "FA"))
    rest = pool.filter(F.col("tfopwg_disp").isin("PC", "APC")).join(
        gold.select("tic_id").distinct(), "tic_id", "left_anti")
    return links.union_all([gold.withColumn("cohort", F.lit("gold")),
                            rest.withColumn("cohort", F.lit("discovery"))]).select(
        "candidate_id", "tic_id", "cohort")


@query("u05_insert_if_absent", with_views("identifiers") + """
    SELECT DISTINCT star_id, candidate_id, id_type, id_value, source FROM identifiers i
    WHERE NOT EXISTS (SELECT 1 FROM identifiers k WHERE k.source = 'exofop'
        AND k.id_type = i.id_type AND k.id_value = i.id_value AND k.source = i.source
        AND k.star_id IS NOT DISTINCT FROM i.star_id
        AND k.candidate_id IS NOT DISTINCT FROM i.candidate_id)""")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).identifiers
    existing = rows.filter("source = 'exofop'")
    return links.drop_existing(rows.unionByName(rows), existing).select(
        "star_id", "candidate_id", "id_type", "id_value", "source")
