"""Clustering, links with audit, resolution, dossiers, selection and the whole graph build."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import designations as dz
from starledger.operators import dossier as ds
from starledger.operators import links, resolution, selection
from starledger.operators.claims import (CANDIDATE_UNITS, CLAIM_SOURCES, DISPOSITION_COLUMN,
                                          STAR_ATTRIBUTES)
from starledger.plans import graph
from starledger.registry import query
from starledger.registry.aggregates import FLAGS, LAST_CLAIM, VOTES, representative_targets
from starledger.registry.joins import OBS_VIEWS, _HOST_ROWS, _OBS, _SECONDARY, _TIC_SEEN
from starledger.registry.ranking import STRATA
from starledger.registry.snapshots import _STAR_ROWS, raw_tables
from starledger.registry.views import Tables, ctes, with_views
from starledger.session import cut_lineage, scratch_path
from starledger.sources import sinks


def _clusters(source: str) -> str:
    """Sequential leader clustering of ``source`` (star_id, id_type, id_value, period, ...)."""
    return f"""grp AS (SELECT star_id, id_type, id_value,
        arg_min(period, [source_order, raw_id]) FILTER (WHERE period IS NOT NULL) AS period,
        arg_min(planet_name, [source_order, raw_id]) FILTER (WHERE planet_name <> '') AS planet_name,
        list_sort(list(DISTINCT source)) AS sources FROM {source} GROUP BY 1, 2, 3),
    ord AS (SELECT *, id_type || ':' || id_value AS own, row_number() OVER (PARTITION BY star_id
        ORDER BY id_type, id_value) AS rn FROM grp),
    rec AS (SELECT star_id, rn, own, own AS seed, CAST([] AS VARCHAR[]) AS hits,
                   [{{'k': own, 'p': period}}] AS seeds FROM ord WHERE rn = 1
        UNION ALL SELECT star_id, rn, own, CASE WHEN len(h) = 1 THEN h[1] ELSE own END, h,
            CASE WHEN len(h) = 1 THEN seeds ELSE list_append(seeds, {{'k': own, 'p': period}}) END
        FROM (SELECT o.star_id, o.rn, o.own, o.period, r.seeds, list_transform(list_filter(r.seeds,
                  lambda s: s.p > 0 AND o.period > 0
                  AND abs(s.p - o.period) / greatest(s.p, o.period) < 0.01e0), lambda s: s.k) AS h
              FROM rec r JOIN ord o ON o.star_id = r.star_id AND o.rn = r.rn + 1)),
    clustered AS (SELECT o.*, seed, hits, CASE WHEN seed = rec.own THEN 'candidate_seed'
        ELSE 'period_match<1pct' END AS rule FROM rec JOIN ord o USING (star_id, rn)),
    cands AS (SELECT star_id, seed, row_number() OVER (ORDER BY star_id, min(id_type) FILTER
            (WHERE own = seed), min(id_value) FILTER (WHERE own = seed)) AS candidate_id,
        coalesce(arg_max(CASE WHEN planet_name <> '' THEN planet_name WHEN id_type = 'name'
            THEN id_value END, [id_type, id_value]) FILTER (WHERE planet_name <> ''
            OR id_type = 'name'),
            'TOI ' || max(id_value) FILTER (WHERE id_type = 'toi'),
            'KOI ' || max(id_value) FILTER (WHERE id_type = 'koi'),
            'CTOI ' || max(id_value) FILTER (WHERE id_type = 'ctoi'),
            'star ' || star_id) AS canonical_name
        FROM clustered GROUP BY 1, 2),
    cand_links AS (SELECT candidate_id, id_type, id_value, source, arg_max(rule, [oid, oval]) AS rule
        FROM (SELECT candidate_id, id_type, id_value, unnest(sources) AS source, rule, id_type AS oid,
                     id_value AS oval FROM clustered JOIN cands USING (star_id, seed)
              UNION ALL SELECT candidate_id, 'name', planet_name, 'nea', rule, id_type, id_value
              FROM clustered JOIN cands USING (star_id, seed)
              WHERE planet_name <> '' AND id_type <> 'name') GROUP BY 1, 2, 3, 4)"""


_ORDERS = "WITH RECURSIVE " + ctes("designations") + ", " + _clusters("designations")


def _clustered(t: Tables):
    return cut_lineage(dz.cluster(dz.collapse(t.designations)))


@query("e01_period_clustering", _ORDERS + """
    SELECT star_id, id_type, id_value, seed, rule, len(hits) > 1 AS ambiguous FROM clustered""")
def _(spark, sf_dir):
    return _clustered(Tables(spark, sf_dir)).select(
        "star_id", "id_type", "id_value", F.concat_ws(":", "seed_type", "seed_value").alias("seed"),
        "rule", F.col("competing").isNotNull().alias("ambiguous"))


@query("e02_candidate_construction", _ORDERS + """
    SELECT candidate_id, star_id, seed, canonical_name FROM cands""")
def _(spark, sf_dir):
    rows = dz.candidates(_clustered(Tables(spark, sf_dir)))
    return rows.select("candidate_id", "star_id",
                       F.concat_ws(":", "seed_type", "seed_value").alias("seed"), "canonical_name")


@query("e03_links_with_audit", _ORDERS + """
    SELECT 'candidate' AS entity_type, candidate_id AS surviving_id, rule AS rule_fired, 1e0 AS score,
        '{"id_type":"' || id_type || '","id_value":"' || id_value || '","source":"' || source || '"}'
        AS details FROM cand_links""")
def _(spark, sf_dir):
    clustered = _clustered(Tables(spark, sf_dir))
    rows = links.audit_of_links(dz.candidate_links(clustered, dz.candidates(clustered)))
    return rows.select("entity_type", "surviving_id", "rule_fired",
                       F.col("score").cast("double").alias("score"), "details")


@query("e04_flagged_non_merges", _ORDERS + """
    SELECT star_id AS surviving_id, 'period_ambiguous' AS rule_fired, own AS designation,
        array_to_string(hits, '|') AS competing FROM clustered WHERE len(hits) > 1""")
def _(spark, sf_dir):
    rows = links.audit_of_ambiguous(dz.ambiguous(_clustered(Tables(spark, sf_dir))))
    detail = F.from_json("details", "designation string, competing_seed_designations array<string>")
    return rows.withColumn("d", detail).select(
        "surviving_id", "rule_fired", "d.designation",
        F.array_join("d.competing_seed_designations", "|").alias("competing"))


@query("e05_audit_invariant", _ORDERS + """
    SELECT (SELECT count(*) FROM cand_links) AS n_links,
           (SELECT count(*) FROM clustered WHERE len(hits) > 1) AS n_ambiguous,
           (SELECT count(*) FROM cand_links) + (SELECT count(*) FROM clustered WHERE len(hits) > 1)
           AS n_audit, CAST(0 AS BIGINT) AS violations""")
def _(spark, sf_dir):
    clustered = _clustered(Tables(spark, sf_dir))
    rows = dz.candidate_links(clustered, dz.candidates(clustered))
    flagged = dz.ambiguous(clustered)
    audit = links.audit_of_links(rows).unionByName(links.audit_of_ambiguous(flagged))
    broken = (links.audit_gap(rows, flagged, audit).select(F.lit("x").alias("kind"))
              .unionByName(links.bad_owner(rows).select(F.lit("x").alias("kind"))))
    marks = links.union_all([rows.select(F.lit("link").alias("kind")),
                             flagged.select(F.lit("flag").alias("kind")),
                             audit.select(F.lit("audit").alias("kind")), broken])
    return marks.agg(*[F.count(F.when(F.col("kind") == kind, 1)).alias(name) for kind, name in (
        ("link", "n_links"), ("flag", "n_ambiguous"), ("audit", "n_audit"), ("x", "violations"))])


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PICKS = """picked AS (SELECT DISTINCT ON (eid, attribute) eid, attribute, source, value
        FROM latest JOIN ranks USING (attribute, source) ORDER BY eid, attribute, rank),
    numeric AS (SELECT eid, attribute, source, TRY_CAST(value AS DOUBLE) AS value FROM picked
        WHERE attribute <> 'disposition' AND regexp_matches(value, '""" + _NUMBER + """'))"""


@query("e06_precedence_pick", with_views("claims", "ranks") + ", "
       + LAST_CLAIM.format(eid="candidate_id") + f", {_PICKS}" + " SELECT * FROM numeric")
def _(spark, sf_dir):
    latest = resolution.last_per_source(Tables(spark, sf_dir).claims, "candidate_id")
    return resolution.pick_numeric(latest, specs.precedence(spark))


@query("e07_disposition_resolution", with_views("claims", "ranks", "vocab") + f", {VOTES}" + """
    SELECT eid, disposition FROM winners""")
def _(spark, sf_dir):
    latest = resolution.last_per_source(Tables(spark, sf_dir).claims, "candidate_id")
    return resolution.resolve_dispositions(resolution.disposition_votes(
        latest, specs.precedence(spark), specs.vocabulary(spark)))


@query("e07_unmapped_words", with_views("claims", "ranks", "vocab") + f", {VOTES}" + """
    SELECT DISTINCT v.source, v.value FROM votes v LEFT JOIN winners USING (eid)
    WHERE canonical IS NULL AND (won IS NULL OR rank < won)""")
def _(spark, sf_dir):
    latest = resolution.last_per_source(Tables(spark, sf_dir).claims, "candidate_id")
    return resolution.unmapped_words(resolution.disposition_votes(
        latest, specs.precedence(spark), specs.vocabulary(spark)))


@query("e08_resolved_candidates", with_views("claims", "ranks", "vocab", "candidates")
       + f", {VOTES}, {_PICKS}" + """
    SELECT c.candidate_id, c.canonical_name, w.disposition, p.value AS period_days,
           r.value AS planet_radius_re
    FROM candidates c LEFT JOIN winners w ON w.eid = c.candidate_id
    LEFT JOIN numeric p ON p.eid = c.candidate_id AND p.attribute = 'period_days'
    LEFT JOIN numeric r ON r.eid = c.candidate_id AND r.attribute = 'planet_radius_re'""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ranks = specs.precedence(spark)
    latest = resolution.last_per_source(t.claims, "candidate_id")
    votes = resolution.disposition_votes(latest, ranks, specs.vocabulary(spark))
    return resolution.write_winners(
        t.candidates, "candidate_id", resolution.pick_numeric(latest, ranks),
        specs.RESOLVED_CANDIDATE_ATTRIBUTES, resolution.resolve_dispositions(votes)).select(
        "candidate_id", "canonical_name", "disposition", "period_days", "planet_radius_re")


@query("e08_star_coverage", with_views("claims", "ranks", "stars") + ", "
       + LAST_CLAIM.format(eid="star_id") + f", {_PICKS}" + """
    SELECT (SELECT count(*) FROM numeric JOIN stars ON star_id = eid WHERE attribute = 'teff_k')
        AS star_teff_k_resolved, CAST(0 AS BIGINT) AS star_logg_resolved,
        CAST(0 AS BIGINT) AS star_rstar_rsun_resolved""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    picked = resolution.pick_numeric(resolution.last_per_source(t.claims, "star_id"),
                                     specs.precedence(spark))
    resolved = resolution.write_winners(t.stars, "star_id", picked, specs.RESOLVED_STAR_ATTRIBUTES)
    return resolution.coverage(resolved, specs.RESOLVED_STAR_ATTRIBUTES, "star")


# The whole build in SQL: every link with its rule.
_BUILD = ("WITH RECURSIVE " + ctes(*OBS_VIEWS) + f", {_STAR_ROWS}, {_HOST_ROWS}, {_SECONDARY}, "
          f"{_TIC_SEEN}, {_OBS}" + """,
    tic_star AS (SELECT DISTINCT ON (tic) tic, ra, dec, 't' || lpad(CAST(tic AS VARCHAR), 12, '0') AS k FROM star_rows
        WHERE tic IS NOT NULL ORDER BY tic, hostname IS NULL, ra IS NULL, dec IS NULL),
    host_star AS (SELECT DISTINCT ON (hostname) hostname, ra, dec, 'u' || hostname AS k FROM hosts h
        WHERE tic_id IS NULL AND hostname <> '' AND NOT EXISTS (SELECT 1 FROM hosts g
            WHERE g.hostname = h.hostname AND g.tic_id IS NOT NULL)
        ORDER BY hostname, ra IS NULL, dec IS NULL),
    placed AS (SELECT k, ra, dec FROM tic_star WHERE ra IS NOT NULL AND dec IS NOT NULL
        UNION ALL SELECT k, ra, dec FROM host_star WHERE ra IS NOT NULL AND dec IS NOT NULL),
    near AS (SELECT kepid, k, 3600 * degrees(2 * asin(sqrt(
        pow(sin(radians(s.dec - c.dec_deg) / 2), 2) + cos(radians(s.dec)) * cos(radians(c.dec_deg))
        * pow(sin(radians(s.ra - c.ra_deg) / 2), 2)))) AS sep
        FROM raw_koi_cumulative c JOIN placed s ON abs(s.dec - c.dec_deg) < 0.001
        WHERE c.ra_deg IS NOT NULL),
    matched AS (SELECT DISTINCT ON (kepid) * FROM near WHERE sep < 2 ORDER BY kepid, sep, k),
    kic AS (SELECT c.kepid, coalesce(m.k, 'v' || lpad(CAST(c.kepid AS VARCHAR), 12, '0')) AS k
        FROM raw_koi_cumulative c LEFT JOIN matched m USING (kepid)),
    attached AS (SELECT coalesce(t.k, q.k, h.k) AS star_id, obs.* FROM obs
        LEFT JOIN tic_star t ON t.tic = obs.tic_id LEFT JOIN kic q ON q.kepid = obs.kepid
        LEFT JOIN host_star h ON h.hostname = obs.hostname
        WHERE coalesce(t.k, q.k, h.k) IS NOT NULL AND id_value <> ''), """ + _clusters("attached"))


@query("e09_graph_build_audit", _BUILD + """
    SELECT 'tic_exact' AS rule_fired, count(*) AS n FROM seen
    UNION ALL SELECT 'catalog_xref', count(*) FROM named WHERE tic_id IS NOT NULL AND id_value <> ''
    UNION ALL SELECT 'hostname_new_star', count(*) FROM host_star
    UNION ALL SELECT 'coord_match<2arcsec', count(*) FROM matched
    UNION ALL SELECT 'koi_new_star', count(*) FROM kic WHERE k LIKE 'v%'
    UNION ALL SELECT rule, count(*) FROM cand_links GROUP BY 1
    UNION ALL SELECT 'period_ambiguous', count(*) FROM clustered WHERE len(hits) > 1""")
def _(spark, sf_dir):
    return graph.audit_by_rule(_graph(spark, sf_dir))


def _graph(spark, sf_dir):
    return graph.build_graph(raw_tables(Tables(spark, sf_dir)), specs.vocabulary(spark),
                             specs.precedence(spark))


@query("e09_graph_build_candidates", _BUILD + """
    , numbered AS (SELECT k, row_number() OVER (ORDER BY k) AS sid FROM (SELECT k FROM tic_star
        UNION ALL SELECT k FROM host_star UNION ALL SELECT k FROM kic WHERE k LIKE 'v%'))
    SELECT sid AS star_id, row_number() OVER (ORDER BY candidate_id) AS candidate_id,
        CASE WHEN canonical_name LIKE 'star %' THEN 'star ' || sid ELSE canonical_name END
        AS canonical_name FROM cands JOIN numbered ON k = star_id""")
def _(spark, sf_dir):
    return _graph(spark, sf_dir).candidate_rows.select("star_id", "candidate_id", "canonical_name")


def _claim_counts() -> str:
    """Claims per source, level and attribute, one SELECT for each."""
    word = {**DISPOSITION_COLUMN, "ps": "soltype", "pscomppars": "pl_name"}
    parts = []
    for spec in CLAIM_SOURCES:
        owners = {"candidate": f"cand_links l ON l.id_type = '{spec.id_type}' AND l.source = "
                               f"'{spec.asserted_by}' AND l.id_value = CAST(r.{spec.key} AS VARCHAR)",
                  "star": f"seen l ON l.source = '{spec.asserted_by}' AND l.tic_id = r.{spec.key}"}
        owner = ("kic l ON l.kepid = r.kepid" if spec.id_type == "kic" else owners[spec.owner])
        attributes = (CANDIDATE_UNITS if spec.owner == "candidate" else
                      [(a, None) for a in STAR_ATTRIBUTES[spec.source]])
        for attribute, _ in attributes:
            column = attribute
            if attribute == "disposition":
                column = word[spec.source]
            elif attribute == "depth_ppm" and spec.source in ("ps", "pscomppars"):
                column = "depth_pct"
            if spec.source == "exofop_ctoi" and spec.owner == "star":
                continue
            parts.append(f"SELECT '{spec.source}' AS source, '{spec.owner}' AS level, '{attribute}' "
                         f"AS attribute, count(*) AS n FROM {spec.table} r JOIN {owner} "
                         f"WHERE r.{column} IS NOT NULL")
    return " SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query("e09_graph_build_claims", _BUILD + _claim_counts())
def _(spark, sf_dir):
    level = F.when(F.col("star_id").isNotNull(), "star").otherwise("candidate").alias("level")
    return _graph(spark, sf_dir).claim_rows().groupBy("source", level, "attribute").agg(
        F.count(F.lit(1)).alias("n"))


@query("e09_graph_build_sizes", _BUILD + """
    , counted AS (SELECT (SELECT count(*) FROM seen) + (SELECT count(*) FROM named
            WHERE tic_id IS NOT NULL AND id_value <> '') + (SELECT count(*) FROM host_star)
            + (SELECT count(*) FROM matched) + (SELECT count(*) FROM kic WHERE k LIKE 'v%')
            + (SELECT count(*) FROM cand_links) AS n_links,
        (SELECT count(*) FROM clustered WHERE len(hits) > 1) AS n_ambiguous)
    SELECT (SELECT count(*) FROM tic_star) + (SELECT count(*) FROM host_star)
            + (SELECT count(*) FROM kic WHERE k LIKE 'v%') AS stars,
        (SELECT count(*) FROM cands) AS candidates, n_links AS crosswalk_rows,
        n_links + n_ambiguous AS merge_log_rows, (SELECT count(*) FROM matched) AS koi_coord_matched,
        (SELECT count(*) FROM kic WHERE k LIKE 'v%') AS koi_new_stars,
        n_ambiguous AS ambiguous_period_candidates FROM counted""")
def _(spark, sf_dir):
    return graph.build_sizes(_graph(spark, sf_dir))


@query("e09_graph_build_summary")
def _(spark, sf_dir):
    return graph.build_summary(_graph(spark, sf_dir))


_SECTIONS = f"""{FLAGS}, owned AS (SELECT target_id, id_type, id_value, source FROM rep
        JOIN identifiers i ON i.candidate_id = target_id
        UNION ALL SELECT target_id, id_type, id_value, source FROM rep JOIN identifiers i
        ON i.star_id = rep.star_id)"""


@query("e10_target_dossier", with_views("candidates", "stars", "identifiers", "claims", "vocab", "axes")
       + f", {_SECTIONS}" + """
    SELECT 'identity' AS section, target_id, c.canonical_name AS item, s.canonical_name AS word, 1 AS n
    FROM rep JOIN candidates c ON c.candidate_id = target_id JOIN stars s ON s.star_id = rep.star_id
    UNION ALL SELECT 'identifiers', target_id, id_type || ' ' || id_value, source, count(*) FROM owned
        GROUP BY 2, 3, 4
    UNION ALL SELECT 'claims', target_id, attribute || ' ' || source, coalesce(word, value), count(*)
        FROM said GROUP BY 2, 3, 4
    UNION ALL SELECT 'attributes', target_id, attribute, CASE WHEN conflict THEN 'conflict' END, n_claims
        FROM flags
    UNION ALL SELECT 'siblings', target_id, c.canonical_name, c.disposition, c.candidate_id FROM rep
        JOIN candidates c ON c.star_id = rep.star_id AND c.candidate_id <> target_id""")
def _(spark, sf_dir):
    sections = _dossier(spark, Tables(spark, sf_dir))

    def rows(name, item, word, n=None, key="target_id"):
        df = sections[name].select(F.lit(name).alias("section"), F.col(key).alias("target_id"),
                                   item.alias("item"), word.alias("word"),
                                   F.lit(1).cast("bigint").alias("n") if n is None else n.cast("bigint").alias("n"))
        return df if n is not None else df.groupBy("section", "target_id", "item", "word").agg(
            F.count(F.lit(1)).alias("n"))

    return links.union_all([
        rows("identity", F.col("target"), F.col("host"), key="candidate_id"),
        rows("identifiers", F.concat_ws(" ", "id_type", "id_value"), F.col("source")),
        rows("claims", F.concat_ws(" ", "attribute", "source"), F.coalesce("canonical_disposition", "value")),
        rows("attributes", F.col("attribute"), F.when(F.col("conflict"), F.lit("conflict")), F.col("n_claims")),
        rows("siblings", F.col("canonical_name"), F.col("disposition"), F.col("candidate_id"))])


def _dossier(spark, t: Tables):
    return ds.dossier(representative_targets(t), t.candidates, t.stars, t.identifiers, t.claims,
                      specs.vocabulary(spark), specs.attribute_axes(spark))


@query("e10_dossier_attributes", with_views("candidates", "stars", "claims", "vocab", "axes")
       + f", {FLAGS}" + """
    SELECT target_id, attribute, n_claims, conflict, CASE WHEN attribute = 'disposition'
           THEN c.disposition END AS resolved
    FROM flags JOIN candidates c ON c.candidate_id = target_id""")
def _(spark, sf_dir):
    return _dossier(spark, Tables(spark, sf_dir))["attributes"].select(
        "target_id", "attribute", "n_claims", "conflict", "resolved")


@query("e11_target_conflicts", with_views("candidates", "stars", "claims", "vocab", "axes")
       + f", {FLAGS}" + """
    SELECT rep.target_id, c.canonical_name AS target, s.canonical_name AS host,
           (SELECT count(*) FROM flags f WHERE f.target_id = rep.target_id AND conflict) AS n_conflicts
    FROM rep JOIN candidates c ON c.candidate_id = rep.target_id
    JOIN stars s ON s.star_id = rep.star_id""")
def _(spark, sf_dir):
    return ds.conflicts_only(_dossier(spark, Tables(spark, sf_dir)))["summary"]


@query("e12_target_selection", with_views("pool") + f", {STRATA}" + """
    SELECT candidate_id, tic_id, cohort, stratum, 'TFOPWG ' || tfopwg_disp || '; ' || CASE
        WHEN cohort <> 'discovery' THEN 'stratum ' || stratum WHEN stratum = 'single_transit'
        THEN 'single-transit (period unknown)' ELSE 'P>=30d' END || '; brightest-first' AS select_rule
    FROM selected""")
def _(spark, sf_dir):
    return selection.select_targets(Tables(spark, sf_dir).pool).select(
        "candidate_id", "tic_id", "cohort", "stratum", "select_rule")


@query("e13_stable_id_upsert", with_views("pool") + """
    , old AS (SELECT CASE WHEN candidate_id % 3 = 0 THEN candidate_id ELSE -candidate_id END AS candidate_id,
        candidate_id * 10 AS target_id FROM pool),
    chosen AS (SELECT candidate_id, toi FROM pool)
    SELECT candidate_id, toi, target_id FROM chosen JOIN old USING (candidate_id)
    UNION ALL SELECT candidate_id, toi, (SELECT max(target_id) FROM old) + row_number() OVER (
        ORDER BY candidate_id) FROM chosen WHERE candidate_id NOT IN (SELECT candidate_id FROM old)""")
def _(spark, sf_dir):
    pool = Tables(spark, sf_dir).pool
    # Two of three stored targets are no longer chosen and go.
    old = pool.select(F.when(F.col("candidate_id") % 3 == 0, F.col("candidate_id"))
                      .otherwise(-F.col("candidate_id")).alias("candidate_id"),
                      (F.col("candidate_id") * 10).alias("target_id"))
    return selection.upsert_targets(old, pool.select("candidate_id", "toi"))


@query("e14_replace_by_key", with_views("detections") + """
    , old AS (SELECT pipeline_run_id, method AS tool, rank, 'old' AS version FROM detections),
    new AS (SELECT pipeline_run_id, method AS tool, rank, 'new' AS version FROM detections
            WHERE rank % 2 = 0)
    SELECT tool, version, count(*) AS n FROM (SELECT * FROM new UNION ALL SELECT * FROM old o
        WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.pipeline_run_id = o.pipeline_run_id
                          AND n.tool = o.tool)) GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).detections.select("pipeline_run_id",
                                                   F.col("method").alias("tool"), "rank")
    merged = sinks.replace_by_key(rows.withColumn("version", F.lit("old")),
                                  rows.filter("rank % 2 = 0").withColumn("version", F.lit("new")),
                                  ["pipeline_run_id", "tool"])
    return merged.groupBy("tool", "version").agg(F.count(F.lit(1)).alias("n"))


@query("e14_partition_overwrite", with_views("detections") + """
    SELECT tool, version, count(*) AS n FROM (SELECT method AS tool, CASE method WHEN 'bls' THEN 'new'
        ELSE 'old' END AS version FROM detections) GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).detections.select(F.col("method").alias("tool"), "pipeline_run_id")
    path = scratch_path(spark, "scenarios")
    sinks.overwrite_partitions(rows.withColumn("version", F.lit("old")), path, "tool")
    sinks.overwrite_partitions(rows.filter("tool = 'bls'").withColumn("version", F.lit("new")),
                               path, "tool")
    return spark.read.parquet(path).groupBy("tool", "version").agg(F.count(F.lit(1)).alias("n"))
