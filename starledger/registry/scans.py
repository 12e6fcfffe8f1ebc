"""Sources, landing, ledger and product queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import coerce_cell, sector_number
from starledger.operators import selection
from starledger.operators.resolution import latest_seed
from starledger.registry import query
from starledger.registry.views import Tables, with_views
from starledger.session import scratch_path
from starledger.sources import catalog_csv, landing, ledger, lightcurves, sinks



def _toi_csv(t: Tables):
    """The part table as a TOI list file: shuffled case and blanks in the headers, text cells."""
    return t.part.select(
        F.when(F.col("p_partkey") % 10 == 0, "").otherwise(
            F.col("p_partkey").cast("string")).alias(" tic id "),
        F.concat(F.col("p_partkey").cast("string"), F.lit(".01")).alias("TOI"),
        F.concat(F.lit(" "), F.col("p_brand")).alias("TFOPWG Disposition"),
        F.when(F.col("p_size") == 9, "bad").otherwise(
            (F.col("p_size") / 4).cast("string")).alias("PERIOD (days)"),
        F.concat(F.col("p_name"), F.lit(', "quoted"')).alias("Comments"))


@query("s01_catalog_csv_scan", """
    SELECT CAST(p_partkey AS VARCHAR) || '.01' AS toi,
           CASE WHEN p_partkey % 10 <> 0 THEN p_partkey END AS tic_id,
           p_brand AS tfopwg_disposition,
           CASE WHEN p_size <> 9 THEN p_size / 4e0 END AS period_days,
           CAST(NULL AS DOUBLE) AS depth_ppm, p_name || ', "quoted"' AS comment
    FROM part""")
def _(spark, sf_dir):
    path = scratch_path(spark, "toi-csv")
    _toi_csv(Tables(spark, sf_dir)).write.option("header", True).option("escape", '"').csv(path)
    rows = catalog_csv.read_catalog(spark, path, specs.TOI_LIST)
    return rows.select("toi", "tic_id", "tfopwg_disposition",
                       F.col("period_days").cast("double").alias("period_days"),
                       F.col("depth_ppm").cast("double").alias("depth_ppm"),
                       F.col("extra")["Comments"].alias("comment"))


def _layout_oracle() -> str:
    values = ", ".join(f"('{t.name}', '{c}', '{k}')" for t in specs.CATALOG_TABLES
                       for c, _, k in t.columns)
    return f"""
    WITH layout AS (SELECT * FROM (VALUES {values}) AS v(table_name, typed_column, kind))
    SELECT table_name, typed_column,
           count(*) FILTER (WHERE kind = 'text' OR p_size <> 9) AS filled
    FROM layout CROSS JOIN part GROUP BY 1, 2"""


@query("s02_column_maps", _layout_oracle())
def _(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    number = F.when(F.col("p_size") == 9, "no number").otherwise(
        F.col("p_partkey").cast("string"))
    frames = []
    for table in specs.CATALOG_TABLES:
        cells = {"text": F.col("p_name"), "tic": F.concat(F.lit("TIC "), number)}
        raw = part.select(*[cells.get(kind, number).alias(header.upper())
                            for _, header, kind in table.columns])
        typed = catalog_csv.typed_projection(raw, table)
        counts = typed.agg(*[F.count(c).alias(c) for c, _, _ in table.columns])
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("typed_column"), F.col(c).alias("filled"))
            for c, _, _ in table.columns])).alias("_p")
        frames.append(counts.select(F.lit(table.name).alias("table_name"), pairs)
                      .select("table_name", "_p.*"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query("s03_cell_coercion", with_views("cells") + rf"""
    , c AS (SELECT p_partkey, nullif(trim(cell), '') AS v FROM cells)
    SELECT p_partkey, v AS as_text,
           CASE WHEN regexp_matches(v, '{_NUMBER}')
                THEN CAST(trunc(TRY_CAST(v AS DOUBLE)) AS BIGINT) END AS as_int,
           CASE WHEN regexp_matches(v, '{_NUMBER}') THEN TRY_CAST(v AS DOUBLE) END AS as_num,
           TRY_CAST(nullif(regexp_extract(upper(v), '^(?:TIC)?\s*([0-9]+)$', 1), '') AS BIGINT)
           AS as_tic
    FROM c""")
def _(spark, sf_dir):
    cell = F.col("cell")
    return Tables(spark, sf_dir).cells.select(
        "p_partkey", coerce_cell("text", cell).alias("as_text"),
        coerce_cell("int", cell).alias("as_int"),
        coerce_cell("num", cell).cast("double").alias("as_num"),
        coerce_cell("tic", cell).alias("as_tic"))


@query("s04_error_payload_guard", """
    SELECT r_regionkey AS payload, r_regionkey % 3 <> 2 AS refused FROM region""")
def _(spark, sf_dir):
    region = Tables(spark, sf_dir).region
    path = scratch_path(spark, "payloads")
    first = (F.when(F.col("r_regionkey") % 3 == 0, F.concat(F.lit(" ERROR\nORA-00904: "), "r_name"))
             .when(F.col("r_regionkey") % 3 == 1, '<?xml version="1.0"?><VOTABLE version="1.3">')
             .otherwise(F.concat(F.lit("toi,tid\n1.01,"), "r_name")))
    (region.select(F.col("r_regionkey").alias("payload"), first.alias("value"))
     .write.partitionBy("payload").text(path))
    # One pass judges every file of the folder.
    return catalog_csv.file_heads(spark, path).select(
        F.regexp_extract("file", r"payload=(\d+)", 1).cast("int").alias("payload"), "refused")


@query("s05_snapshot_landing", """
    SELECT CAST(run AS BIGINT) AS ingest_run_id, count(*) AS n, count(*) AS n_reported,
           count(*) AS n_raw_ids
    FROM part CROSS JOIN (VALUES (1), (2)) AS v(run) GROUP BY 1""")
def _(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    path = scratch_path(spark, "landed")
    reported = {run: landing.land(part, path, run) for run in (1, 2)}
    back = spark.read.parquet(path).groupBy(F.col("ingest_run_id").cast("bigint").alias(
        "ingest_run_id")).agg(F.count(F.lit(1)).alias("n"),
                              F.count_distinct("raw_id").alias("n_raw_ids"))
    told = spark.createDataFrame(list(reported.items()), "ingest_run_id bigint, n_reported bigint")
    return back.join(told, "ingest_run_id")


@query("s06_load_driver", """
    SELECT 'exofop' AS source, 'toi_csv' AS endpoint, 'ok' AS status, count(*) AS rows_ingested
    FROM part
    UNION ALL SELECT 'nea', 'tap_toi', 'error', 0
    UNION ALL SELECT 'exofop', 'toi_csv', 'skipped_fresh', 0""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    good, bad = scratch_path(spark, "good-csv"), scratch_path(spark, "bad-csv")
    _toi_csv(t).write.option("header", True).option("escape", '"').csv(good)
    t.region.select(F.concat(F.lit("ERROR "), "r_name").alias("value")).coalesce(1).write.text(bad)
    raw_root, book = scratch_path(spark, "raw"), scratch_path(spark, "ledger")
    files = {specs.TOI_LIST.name: good, specs.ARCHIVE_TOI.name: bad}
    landing.load_all(spark, files, raw_root, book)
    landing.load_all(spark, {specs.TOI_LIST.name: good}, raw_root, book)
    state = ledger.current_state(ledger.read_events(spark, book))
    return state.select("source", "endpoint", "status", "rows_ingested")


@query("s07_narrow_columns", with_views("raw_ps") + """
    SELECT count(*) AS n, count(DISTINCT pl_name) AS n_planets, count(gaia_id) AS n_gaia,
           count(period_days) AS n_period
    FROM raw_ps""")
def _(spark, sf_dir):
    rows = catalog_csv.narrow(Tables(spark, sf_dir).raw_ps, specs.PLANETARY_SYSTEMS)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pl_name").alias("n_planets"),
                    F.count("gaia_id").alias("n_gaia"), F.count("period_days").alias("n_period"))


@query("s08_ledger_open_close", """
    WITH ev AS (
        SELECT event_id // 2 AS run, event_id % 2 AS event_no, event_type, ts, value FROM events),
    one AS (SELECT run, min(ts) AS started, max(event_no) AS last_no FROM ev GROUP BY run)
    SELECT o.run AS ingest_run_id, event_type AS source,
           CASE WHEN event_no = 1 THEN 'ok' END AS status,
           epoch_us(started) AS started_us, CASE WHEN event_no = 1 THEN epoch_us(ts) END AS finished_us,
           CASE WHEN event_no = 1 THEN CAST(round(value * 100) AS BIGINT) END AS rows_ingested
    FROM one o JOIN ev ON ev.run = o.run AND ev.event_no = o.last_no""")
def _(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    closing = F.col("event_id") % 2 == 1
    events = ev.select(
        F.floor(F.col("event_id") / 2).cast("bigint").alias("ingest_run_id"),
        F.col("event_type").alias("source"), F.lit("all").alias("endpoint"),
        F.col("ts").alias("started_at"), F.when(closing, F.col("ts")).alias("finished_at"),
        F.when(closing, F.round(F.col("value") * 100).cast("bigint")).alias("rows_ingested"),
        F.lit(None).cast("bigint").alias("bytes_downloaded"), F.when(closing, "ok").alias("status"),
        F.lit(None).cast("string").alias("notes"),
        (F.col("event_id") % 2).cast("int").alias("event_no"))
    return ledger.current_state(events).select(
        "ingest_run_id", "source", "status", F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("finished_at").alias("finished_us"), "rows_ingested")


GATE_AT = "2024-01-20 12:00:00"      # in the middle of the ledger, so that some endpoints are fresh and some are not


@query("s09_freshness_gate", with_views("ledger") + f"""
    , known AS (SELECT * FROM ledger WHERE started_at <= TIMESTAMP '{GATE_AT}')
    SELECT DISTINCT source, endpoint, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.source = l.source
        AND k.endpoint = l.endpoint AND k.status = 'ok' AND k.finished_at >= TIMESTAMP '{GATE_AT}' - INTERVAL 2 HOUR)
        THEN 'skipped_fresh' ELSE 'load' END AS verdict FROM ledger l""")
def _(spark, sf_dir):
    book, now, span = Tables(spark, sf_dir).ledger, F.lit(GATE_AT).cast("timestamp"), timedelta(hours=2)
    asked = book.select("source", "endpoint").distinct()
    known = book.filter(F.col("started_at") <= now)
    fresh = ledger.fresh_endpoints(known, now, span).join(asked, ["source", "endpoint"])
    return (ledger.stale_requests(asked, known, now, span).withColumn("verdict", F.lit("load"))
            .unionByName(fresh.withColumn("verdict", F.lit("skipped_fresh"))))


@query("s10_resume_gate", with_views("points") + """
    , have AS (SELECT DISTINCT tic_id, sector, author, cadence_s FROM points WHERE event_id % 3 = 0)
    SELECT DISTINCT p.tic_id, p.sector, p.author FROM points p
    WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.tic_id = p.tic_id AND h.sector = p.sector
          AND h.author = p.author AND h.cadence_s IS NOT DISTINCT FROM p.cadence_s)""")
def _(spark, sf_dir):
    points = Tables(spark, sf_dir).points
    listed = points.select(*lightcurves.PRODUCT).distinct()
    have = points.filter(F.col("event_id") % 3 == 0).select(*lightcurves.PRODUCT).distinct()
    return lightcurves.not_yet_indexed(listed, have).select("tic_id", "sector", "author")


_SECTOR = r"""coalesce(TRY_CAST(sequence_number AS INTEGER),
    TRY_CAST(nullif(regexp_replace(string_split(mission, 'Sector')[-1], '[^0-9]', '', 'g'), '')
    AS INTEGER))"""


@query("s11_best_product_per_sector", with_views("products") + f"""
    , r AS (SELECT tic_id, {_SECTOR} AS sector, idx, author, exptime,
            CASE author WHEN 'SPOC' THEN 0 WHEN 'TESS-SPOC' THEN 1 ELSE 2 END AS a,
            CASE CAST(coalesce(exptime, 9999) AS INTEGER) WHEN 120 THEN 0 WHEN 200 THEN 1
                 WHEN 600 THEN 2 WHEN 1800 THEN 3 WHEN 20 THEN 4 ELSE 5 END AS c
            FROM products WHERE author IN ('SPOC', 'TESS-SPOC', 'QLP'))
    SELECT DISTINCT ON (tic_id, sector) tic_id, CAST(sector AS BIGINT) AS sector, idx, author, exptime
    FROM r WHERE sector IS NOT NULL ORDER BY tic_id, sector, a, c, idx, author, exptime""")
def _(spark, sf_dir):
    return lightcurves.best_products(Tables(spark, sf_dir).products).select(
        "tic_id", F.col("sector").cast("bigint").alias("sector"), "idx", "author", "exptime")


@query("s12_sector_of_product", with_views("products") + f"""
    SELECT {_SECTOR} AS sector, count(*) AS n FROM products GROUP BY 1""")
def _(spark, sf_dir):
    sector = sector_number(F.col("sequence_number"), F.col("mission")).alias("sector")
    return Tables(spark, sf_dir).products.groupBy(sector).agg(F.count(F.lit(1)).alias("n"))


@query("s13_flux_column_choice", with_views("photometry") + """
    , has AS (SELECT tic_id, sector, author, cadence_s, bool_or(pdcsap_flux IS NOT NULL) AS p,
              bool_or(sap_flux IS NOT NULL) AS s, bool_or(kspsap_flux IS NOT NULL) AS k,
              bool_or(pdcsap_flux_err IS NOT NULL) AS pe
              FROM photometry GROUP BY ALL),
    chosen AS (SELECT ph.*, pe, CASE WHEN ph.author <> 'QLP' AND p THEN 'pdcsap'
               WHEN ph.author = 'QLP' AND k THEN 'kspsap' WHEN s THEN 'sap' ELSE 'flux' END AS kind
               FROM photometry ph JOIN has h ON ph.tic_id = h.tic_id AND ph.sector = h.sector
               AND ph.author = h.author AND ph.cadence_s IS NOT DISTINCT FROM h.cadence_s),
    picked AS (SELECT tic_id, kind AS flux_kind, CASE kind WHEN 'pdcsap' THEN pdcsap_flux
               WHEN 'kspsap' THEN kspsap_flux WHEN 'sap' THEN sap_flux ELSE flux END AS f,
               CASE WHEN kind = 'pdcsap' AND pe THEN pdcsap_flux_err ELSE flux_err END AS e,
               coalesce(quality, 0) AS quality FROM chosen)
    SELECT tic_id, flux_kind, count(*) AS n, round(sum(f), 6) AS flux_sum, round(sum(e), 6) AS err_sum,
           CAST(sum(quality) AS BIGINT) AS flagged
    FROM picked WHERE f IS NOT NULL AND NOT isnan(f) GROUP BY 1, 2""")
def _(spark, sf_dir):
    chosen = lightcurves.choose_flux(Tables(spark, sf_dir).photometry)
    return chosen.groupBy("tic_id", "flux_kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("flux"), 6).alias("flux_sum"),
        F.round(F.sum("flux_err"), 6).alias("err_sum"),
        F.sum("quality").cast("bigint").alias("flagged"))


@query("s14_lightcurve_manifest", with_views("points") + """
    SELECT tic_id, sector, author, cadence_s, count(*) AS n_points,
           round(min(time), 6) AS t_start, round(max(time), 6) AS t_end
    FROM points GROUP BY ALL""")
def _(spark, sf_dir):
    points = Tables(spark, sf_dir).points.withColumn("flux_kind", F.lit("flux"))
    return lightcurves.manifest_of(points).select(
        *lightcurves.PRODUCT, "n_points", F.round("t_start", 6).alias("t_start"),
        F.round("t_end", 6).alias("t_end"))


@query("s15_lightcurve_store_scan", with_views("points") + """
    SELECT tic_id, count(*) AS n, round(min(time), 6) AS t_start, round(max(time), 6) AS t_end
    FROM points GROUP BY 1""")
def _(spark, sf_dir):
    path = scratch_path(spark, "cadences")
    lightcurves.write_points(Tables(spark, sf_dir).points, path, tic_buckets=8)
    return spark.read.parquet(path).groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("time"), 6).alias("t_start"),
        F.round(F.max("time"), 6).alias("t_end"))


@query("s16_vocabulary_source", with_views("claims", "vocab") + """
    SELECT v.source, v.source_value, v.canonical, count(c.value) AS n_claims
    FROM vocab v LEFT JOIN claims c ON c.attribute = 'disposition' AND c.source = v.source
         AND c.value = v.source_value GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    words = latest_seed(specs.vocabulary(spark))
    said = Tables(spark, sf_dir).claims.filter("attribute = 'disposition'").groupBy(
        "source", F.col("value").alias("source_value")).agg(F.count(F.lit(1)).alias("n_claims"))
    return words.join(said, ["source", "source_value"], "left").select(
        "source", "source_value", "canonical", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


@query("s16_precedence_source", with_views("claims", "ranks") + """
    SELECT r.attribute, r.source, r.rank, count(c.value) AS n_claims
    FROM ranks r LEFT JOIN claims c ON c.attribute = r.attribute AND c.source = r.source
    GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    said = Tables(spark, sf_dir).claims.groupBy("attribute", "source").agg(
        F.count(F.lit(1)).alias("n_claims"))
    return specs.precedence(spark).join(said, ["attribute", "source"], "left").select(
        "attribute", "source", "rank", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


@query("s17_target_work_list", with_views("targets") + """
    SELECT cohort, tic_id, toi, target_id FROM targets""")
def _(spark, sf_dir):
    return selection.work_list(Tables(spark, sf_dir).targets).select(
        "cohort", "tic_id", "toi", "target_id")


@query("s18_vocabulary_upsert", """
    SELECT p_type AS source, p_brand AS source_value, arg_max(p_name || p_partkey,
           [p_partkey % 3, p_partkey]) AS canonical
    FROM part GROUP BY 1, 2""")
def _(spark, sf_dir):
    seeds = Tables(spark, sf_dir).part.select(
        F.col("p_type").alias("source"), F.col("p_brand").alias("source_value"),
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("canonical"),
        F.struct(F.col("p_partkey") % 3, "p_partkey").alias("seed_order"))
    return latest_seed(seeds)


@query("s19_result_sinks", with_views("runs", "detections") + """
    SELECT 'run' AS kind, CAST(CAST(date_trunc('month', started_at) AS DATE) AS VARCHAR) AS part,
        count(*) AS n
    FROM runs GROUP BY 1, 2
    UNION ALL SELECT 'detection', method, count(*) FROM detections GROUP BY 1, 2""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    run_path, found_path = scratch_path(spark, "runs"), scratch_path(spark, "detections")
    # By month: the driver's orders span seven years.
    sinks.append_runs(t.runs.withColumn("started_at", F.date_trunc("month", "started_at")), run_path)
    sinks.append_detections(t.detections, found_path)
    runs = spark.read.parquet(run_path).groupBy(
        F.lit("run").alias("kind"), F.col("run_date").cast("string").alias("part"))
    found = spark.read.parquet(found_path).groupBy(
        F.lit("detection").alias("kind"), F.col("method").alias("part"))
    return runs.agg(F.count(F.lit(1)).alias("n")).unionByName(
        found.agg(F.count(F.lit(1)).alias("n")))


@query("s20_download_list", with_views("pool") + "SELECT DISTINCT tic_id FROM pool")
def _(spark, sf_dir):
    return selection.download_list(Tables(spark, sf_dir).pool)
