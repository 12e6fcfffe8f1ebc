from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from starledger import specs
from starledger.sources import catalog_csv, landing, ledger, lightcurves, sinks
from starledger.streaming.landing import land_new_files

TOI = """TIC ID,TOI,TFOPWG Disposition,Period (days),Planet Radius (R_Earth),Stellar Eff Temp (K)
231663901,101.01,KP,1.4303699,13.187,5600
12345,900.01,PC,,2.1,
"""
PS = """pl_name,hostname,tic_id,gaia_dr3_id,pl_orbper,pl_rade,pl_trandep
Kepler-227 b,Kepler-227,TIC 158722002,Gaia DR3 123,9.488,2.26,0.05
"""


def write(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body)
    return str(path)


def test_header_driven_projection(spark, tmp_path):
    rows = catalog_csv.read_catalog(spark, write(tmp_path, "toi.csv", TOI), specs.TOI_LIST)
    first, second = sorted(rows.collect(), key=lambda r: -r.tic_id)
    assert (first.toi, first.tic_id, first.tfopwg_disposition) == ("101.01", 231663901, "KP")
    assert float(first.period_days) == 1.4303699 and first.extra["TOI"] == "101.01"
    assert second.period_days is None and second.teff_k is None and second.depth_ppm is None
    assert second.extra["Period (days)"] == ""
    ps = catalog_csv.read_catalog(spark, write(tmp_path, "ps.csv", PS),
                                  specs.PLANETARY_SYSTEMS).first()
    assert ps.tic_id == 158722002 and float(ps.depth_pct) == 0.05 and ps.gaia_id == "Gaia DR3 123"


def test_error_payload_raises(spark, tmp_path):
    with pytest.raises(catalog_csv.SourceError):
        catalog_csv.read_catalog(spark, write(tmp_path, "e.csv", "ERROR\nORA-00904: x"),
                                 specs.ARCHIVE_TOI)


@pytest.mark.parametrize("body", ["ERROR / ORA-00904: x", "\n\n  error: gone\n",
                                  '<?xml version="1.0"?>\n<VOTABLE version="1.3">'])
def test_one_error_file_in_a_folder_raises(spark, tmp_path, body):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        write(folder, f"part{k}.csv", TOI)
    assert catalog_csv.read_catalog(spark, str(folder), specs.TOI_LIST).count() == 6
    write(folder, "zz.csv", body)
    with pytest.raises(catalog_csv.SourceError, match="zz.csv"):
        catalog_csv.read_catalog(spark, str(folder), specs.TOI_LIST)


def test_loaders_at_the_same_time_get_their_own_runs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    book = str(tmp_path / "ledger")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda k: ledger.start_run(spark, book, "s", f"e{k}"), range(8)))
    assert len(set(ids)) == 8
    note = "x" * 5000
    ledger.finish_run(spark, book, ids[0], "s", "e0", "error", 0, 0, note)
    assert ledger.current_state(ledger.read_events(spark, book)).filter("status = 'error'").first().notes == note


def test_one_bad_source_does_not_stop_the_rest(spark, tmp_path):
    files = {"raw_nea_toi": write(tmp_path, "bad.csv", "ERROR x"),
             "raw_exofop_toi": write(tmp_path, "toi.csv", TOI)}
    book, raw = str(tmp_path / "ledger"), str(tmp_path / "raw")
    outcome = landing.load_all(spark, files, raw, book)
    assert outcome["raw_exofop_toi"] == 2 and str(outcome["raw_nea_toi"]).startswith("error")
    state = {r.endpoint: r for r in ledger.current_state(
        ledger.read_events(spark, book)).collect()}
    assert state["toi_csv"].status == "ok" and state["toi_csv"].rows_ingested == 2
    assert state["toi_csv"].bytes_downloaded == len(TOI)
    assert state["tap_toi"].status == "error" and "ERROR" in state["tap_toi"].notes
    again = landing.load_all(spark, {"raw_exofop_toi": files["raw_exofop_toi"]}, raw, book)
    assert again == {"raw_exofop_toi": 0}
    landed = spark.read.parquet(f"{raw}/raw_exofop_toi")
    assert landed.count() == 2 and landed.select("raw_id").distinct().count() == 2


def test_freshness_looks_at_ok_runs_only(spark):
    book = spark.sql("""
        SELECT * FROM VALUES ('a', 'x', 'ok', TIMESTAMP '2026-01-01 00:00:00'),
        ('a', 'y', 'error', TIMESTAMP '2026-01-01 11:00:00'),
        ('b', 'x', 'ok', TIMESTAMP '2026-01-01 11:00:00') AS t(source, endpoint, status, finished_at)""")
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    asked = book.select("source", "endpoint")
    stale = ledger.stale_requests(asked, book, now, timedelta(hours=2))
    assert sorted(tuple(r) for r in stale.collect()) == [("a", "x"), ("a", "y")]


def test_streamed_landing_repeats_no_file(spark, tmp_path):
    inbox, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    inbox.mkdir()
    small = specs.CatalogTable("t", "s", "e", (("toi", "TOI", "text"), ("period_days", "Period", "num")))
    book = str(tmp_path / "ledger")
    (inbox / "a.csv").write_text("TOI,Period,More\n1.01,2.5,kept\n")
    land_new_files(spark, small, str(inbox), out, marks, book)
    (inbox / "b.csv").write_text("TOI,Period\n2.01,bad\n")
    land_new_files(spark, small, str(inbox), out, marks, book)
    land_new_files(spark, small, str(inbox), out, marks, book)
    landed = spark.read.parquet(out).collect()
    rows = sorted((r.toi, r.period_days is None, r.ingest_run_id, r.extra.get("More")) for r in landed)
    assert rows == [("1.01", False, 1, "kept"), ("2.01", True, 2, None)]
    assert len({r.raw_id for r in landed}) == 2
    state = ledger.current_state(ledger.read_events(spark, book)).orderBy("ingest_run_id").collect()
    assert [(r.status, r.rows_ingested) for r in state] == [("ok", 1), ("ok", 1)]
    (inbox / "c.csv").write_text("ERROR gone\n")
    with pytest.raises(Exception, match="error payload"):
        land_new_files(spark, small, str(inbox), out, marks, book)
    last = ledger.current_state(ledger.read_events(spark, book)).orderBy("ingest_run_id").collect()[-1]
    assert last.status == "error" and "ERROR gone" in last.notes
    assert spark.read.parquet(out).count() == 2


def test_target_scan_prunes_to_one_bucket(spark, tmp_path):
    points = spark.range(3000).select(
        (F.col("id") % 10).alias("tic_id"), F.lit(1).alias("sector"),
        (F.col("id") * 0.1).alias("time"), F.lit(1.0).alias("flux"))
    path = str(tmp_path / "lc")
    lightcurves.write_points(points, path, 4)
    one = lightcurves.read_target(spark, path, 7, 4)
    times = [r.time for r in one.collect()]
    assert len(times) == 300 and times == sorted(times)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tic_bucket" in plan and "PushedFilters" in plan


def test_publish_switches_versions(spark, tmp_path):
    root = str(tmp_path / "pub")
    sinks.publish({"star": spark.range(3)}, root, "v1")
    sinks.publish({"star": spark.range(5)}, root, "v2")
    assert sinks.read_published(spark, root, "star").count() == 5


def test_later_seed_wins(spark):
    from starledger.operators.resolution import latest_seed

    words = specs.vocabulary(spark, (("a", "X", "CANDIDATE"), ("a", "Y", "CONFIRMED")),
                             (("a", "X", "CONFIRMED"),))
    got = {(r.source_value): r.canonical for r in latest_seed(words).collect()}
    assert got == {"X": "CONFIRMED", "Y": "CONFIRMED"}
    assert latest_seed(specs.vocabulary(spark)).count() == 29


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    from starledger.operators.picks import latest_snapshot

    path = str(tmp_path / "raw")
    for run in (1, 2, 3):
        landing.land(spark.range(run), path, run)
    book = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "error")],
                                 "ingest_run_id bigint, status string")
    newest = latest_snapshot(spark.read.parquet(path), book)
    assert newest.count() == 2  # an error run newer than the ok run does not count
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_run_id" in plan and "Subquery" in plan
    assert latest_snapshot(spark.read.parquet(path), book.filter("false")).isEmpty()


def test_current_rows_equal_the_full_scan_after_late_deliveries(spark, tmp_path):
    from starledger.operators.picks import latest_elements
    from starledger.sources.current import CurrentRows

    import random
    rng = random.Random(5)
    kind = "norad_id bigint, epoch int, source string, perigee_km double"
    history = [(rng.randrange(200) if i % 3 else 7, rng.randrange(500), rng.choice(["a", "b"]), rng.random())
               for i in range(1500)]       # a third of the rows belong to one satellite
    table = CurrentRows(spark, str(tmp_path / "elements"), ["norad_id"], latest_elements, buckets=8)
    with pytest.raises(ValueError):
        table.read()
    assert table.fold(spark.createDataFrame([], kind)) == 0 and table.read().count() == 0
    for at in (0, 500, 1000):
        table.fold(spark.createDataFrame(history[at:at + 500], kind))
        want = {tuple(r) for r in latest_elements(spark.createDataFrame(history[:at + 500], kind)).collect()}
        assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    before = {tuple(r) for r in table.read().collect()}
    late = [(7, -1, "late", 0.0), (3, 10 ** 6, "new", 1.0)]
    assert 1 <= table.fold(spark.createDataFrame(late, kind)) <= 2       # only the buckets of these two
    after = {tuple(r) for r in table.read().collect()}
    assert after - before == {(3, 10 ** 6, "new", 1.0)} and len(after) == len(before)
    assert table.fold(spark.createDataFrame(history, kind)) == 8 and {tuple(r) for r in table.read().collect()} == after
