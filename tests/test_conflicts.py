import pytest
from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import conflicts as cf
from starledger.operators import dossier as ds
from starledger.plans.reports import conflict_report
from tests.test_identity import claims

STAR = "star_id bigint, tic_id bigint, canonical_name string"
CAND = "candidate_id bigint, star_id bigint, canonical_name string, disposition string"


def planted(spark):
    said = claims(spark, [
        (None, 1, "planet_radius_re", "2.0", "koi"), (None, 1, "planet_radius_re", "4.0", "ps"),
        (None, 1, "disposition", "FP", "exofop_toi"), (None, 1, "disposition", "CONFIRMED", "pscomppars"),
        (5, None, "teff_k", "5780", "exofop_toi"), (5, None, "teff_k", "3000", "ps")])
    stars = spark.createDataFrame([(5, 999002, "PLANTED-ZZZ")], STAR)
    cands = spark.createDataFrame([(1, 5, "PLANTED-ZZZ b", "CONFIRMED")], CAND)
    links = spark.createDataFrame([(5, None, "tic", "999002", "nea", 1.0)],
                                  "star_id bigint, candidate_id bigint, id_type string, "
                                  "id_value string, source string, confidence double")
    audit = spark.createDataFrame([("star", "tic_exact")], "entity_type string, rule_fired string")
    return {"star": stars, "candidate": cands, "entity_identifier": links,
            "source_assertion": said, "merge_log": audit}


def test_planted_conflicts_reach_the_report(spark):
    tables = planted(spark)
    book = spark.sql("SELECT 't' source, 't' endpoint, 'ok' status, 1L ingest_run_id, "
                     "TIMESTAMP '2026-01-01' started_at, TIMESTAMP '2026-01-01' finished_at")
    first = conflict_report(tables, specs.vocabulary(spark), book)
    assert first["planet_radius_re_count"].first().n == 1
    example = first["planet_radius_re_examples"].first()
    assert (example.target, example.host, example.detail) == (
        "PLANTED-ZZZ b", "PLANTED-ZZZ", "koi: 2; ps: 4")
    fight = first["dramatic_examples"].first()
    assert "exofop_toi=FALSE_POSITIVE" in fight.detail and "pscomppars=CONFIRMED" in fight.detail
    assert first["teff_k_count"].first().n == 1 and first["rstar_rsun_count"].first().n == 0
    second = conflict_report(tables, specs.vocabulary(spark), book)
    assert all(sorted(map(str, first[k].collect())) == sorted(map(str, second[k].collect()))
               for k in ("totals", "dramatic_examples", "teff_k_examples", "audit_by_rule"))


def test_exactly_ten_percent_apart(spark):
    said = claims(spark, [(None, 1, "planet_radius_re", "1.10", "koi"),
                          (None, 1, "planet_radius_re", "0.99", "ps"),
                          (None, 2, "planet_radius_re", "2", "ps"),
                          (None, 2, "planet_radius_re", "4", "ps")])
    assert cf.numeric_conflicts(said, "candidate_id", "planet_radius_re", "0.10").isEmpty()
    assert [r.eid for r in cf.report_conflicts(
        said, "candidate_id", "planet_radius_re", 0.10).collect()] == [1]


def test_number_patterns_differ_on_a_trailing_point(spark):
    said = claims(spark, [(None, 1, "depth_ppm", "5.", "koi"), (None, 1, "depth_ppm", "1e3", "ps")])
    api = cf.numeric_by_source(said, "candidate_id", "depth_ppm")
    strict = cf.numeric_by_source(said, "candidate_id", "depth_ppm", specs.REPORT_NUMBER_PATTERN)
    assert api.count() == 2 and strict.count() == 1


def test_one_source_may_fight_itself(spark):
    said = claims(spark, [(None, 1, "disposition", "CP", "exofop_toi"),
                          (None, 1, "disposition", "FP", "exofop_toi")])
    row = cf.disposition_conflicts(cf.mapped_dispositions(said, specs.vocabulary(spark))).first()
    assert row.dispositions == ["CONFIRMED", "FALSE_POSITIVE"] and row.dramatic


def test_short_numbers(spark):
    rows = [(2.0, "2"), (13.187, "13.19"), (5780.0, "5780"), (0.00012344, "0.0001234"),
            (123456.0, "1.235e+05"), (0.0, "0"), (9.99999, "10"), (1e-7, "1e-07")]
    got = spark.createDataFrame(rows, "v double, want string").select(
        "want", cf.short_number(F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_pages_are_disjoint_and_ordered(spark):
    rows = [(None, i, "planet_radius_re", v, s) for i in range(12)
            for v, s in (("1", "koi"), (str(2 + i), "ps"))]
    said = claims(spark, rows)
    stars = spark.createDataFrame([(1, 1, "H")], STAR)
    cands = spark.createDataFrame([(i, 1, f"c{i:02d}", None) for i in range(12)], CAND)
    words = specs.vocabulary(spark)
    pages = [cf.conflict_page(said, cands, stars, words, "radius", 5, o).collect() for o in (0, 5)]
    assert not {r.eid for r in pages[0]} & {r.eid for r in pages[1]}
    spreads = [r.spread for p in pages for r in p]
    assert spreads == sorted(spreads, reverse=True)
    assert cf.conflict_total(said, words, "radius").first().n == 12


def test_dossier_of_the_planted_target(spark):
    tables = planted(spark)
    sections = ds.dossier(tables["candidate"].select("candidate_id"), tables["candidate"],
                          tables["star"], tables["entity_identifier"], tables["source_assertion"],
                          specs.vocabulary(spark), specs.attribute_axes(spark))
    flags = [(r.attribute, r.conflict) for r in ds.display_order(sections["attributes"]).collect()]
    assert flags == [("disposition", True), ("planet_radius_re", True), ("teff_k", True)]
    assert sections["identifiers"].first().owner == "star" and sections["siblings"].isEmpty()
    only = ds.conflicts_only(sections)
    assert only["summary"].first().n_conflicts == 3 and only["claims"].count() == 6


def test_numbers_of_any_size_take_part(spark):
    said = spark.createDataFrame([
        (1, "depth_ppm", "a", "1e20"), (1, "depth_ppm", "b", "100000000000000000000"),   # equal
        (2, "depth_ppm", "a", "1e20"), (2, "depth_ppm", "b", "1.2e20"),                  # 1/6 apart
        (3, "depth_ppm", "a", "0.00000000001"), (3, "depth_ppm", "b", "0.00000000002"),  # half
        (4, "depth_ppm", "a", "12345678901234567890"), (4, "depth_ppm", "b", "12345678901234567891"),
        (5, "depth_ppm", "a", "1e-30"), (5, "depth_ppm", "b", "3e-30"),
        (6, "depth_ppm", "a", "1.1"), (6, "depth_ppm", "b", "1.0")],                     # exactly 1/11
        "candidate_id bigint, attribute string, source string, value string")
    got = {r.eid: r for r in cf.numeric_conflicts(said, "candidate_id", "depth_ppm", "0.10").collect()}
    assert set(got) == {2, 3, 5} and abs(got[2].spread - 1 / 6) < 1e-12 and got[3].spread == 0.5
    assert cf.numeric_by_source(said, "candidate_id", "depth_ppm").count() == 12
    edge = spark.createDataFrame([(1, "period_days", "a", "0.99"), (1, "period_days", "b", "1.00")],
                                 "candidate_id bigint, attribute string, source string, value string")
    assert cf.numeric_conflicts(edge, "candidate_id", "period_days", "0.01").isEmpty()  # not beyond it


def test_pages_of_a_stored_list_are_disjoint_complete_and_read_two_ranges(spark, tmp_path):
    from starledger.sources import paged

    path = str(tmp_path / "list")
    rows = spark.range(25_000).select("id", ((F.col("id") * 7919) % 25_000 % 500).alias("spread"))
    paged.store_list(rows, [F.col("spread").desc(), F.col("id")], path, places=1000)
    want = sorted(((r.spread, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert paged.list_length(spark, path).first().n == 25_000
    for offset, limit in ((0, 5), (5, 5), (990, 30), (24_990, 50), (12_345, 1000), (30_000, 10)):
        page = paged.read_page(spark, path, limit, offset, places=1000)
        got = page.collect()
        assert [(r.spread, r.id) for r in got] == want[offset:offset + limit]
        assert [r.place for r in got] == list(range(offset, min(offset + limit, 25_000)))
        assert "PartitionFilters: [isnotnull(_range" in page._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        paged.read_page(spark, path, 0)
    for k in range(25):             # a page needs the files of its own ranges only
        if k not in (11, 12):
            for file in (tmp_path / "list" / f"_range={k}").glob("*.parquet"):
                file.write_bytes(b"broken")
    again = spark.read.schema("id bigint, spread bigint, place bigint, _range bigint").parquet(path)
    assert again.filter("_range BETWEEN 11 AND 12").count() == 2000
    assert [r.id for r in again.filter("_range BETWEEN 11 AND 12 AND place BETWEEN 11990 AND 12009").orderBy("place").collect()] == [
        i for _, i in want[11_990:12_010]]


def test_a_table_of_strings_finds_what_single_searches_find(spark):
    from starledger.operators.search import search, search_many

    candidates = spark.createDataFrame(
        [(1, 1, "Kepler-7 b", "PC"), (2, 1, "Kepler-7 c", None), (3, 2, "TOI 100.01", "FP"), (4, 3, "x", None)],
        "candidate_id bigint, star_id bigint, canonical_name string, disposition string")
    stars = spark.createDataFrame([(1, "Kepler-7", 10), (2, "HD 7", None), (3, "a\\b", 30)],
                                  "star_id bigint, canonical_name string, tic_id bigint")
    crosswalk = spark.createDataFrame(
        [(1, None, "K00097.01"), (None, 2, "TIC 700"), (None, 1, "kepler-7"), (3, None, "100.01"), (4, None, None)],
        "candidate_id bigint, star_id bigint, id_value string")
    strings = ["kepler-7", " Kepler", "7", "%", "_", "k%7", "TOI 100.01", "a\\b", "zzz", "", "  ", "00_", "X", "tic 700"]
    got = search_many(spark.createDataFrame([(s,) for s in strings] + [(None,)], "query string"),
                      candidates, stars, crosswalk, 2).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.place):
        by.setdefault(r.query, []).append((r.candidate_id, r.rank))
    for s in strings:
        if "\\" not in s:
            alone = [(r.candidate_id, r.rank) for r in search(candidates, stars, crosswalk, s, 2).collect()]
            assert by.get(s.strip(), []) == alone, s
    assert by["a\\b"] == [(4, 2)] and "" not in by


def test_long_strings_meet_short_posting_lists(spark):
    """A string gives grams of the greatest indexed length, whose lists stay short as the texts grow."""
    from starledger.operators.search import needed_grams, postings

    strings = ["ab", "abc", "abcd", "abcdef", "ABCDEFGH", "ab%cdefg_x", "0001234"]
    asked = spark.createDataFrame([(s,) for s in strings], "query string")
    grams = {r.query: set(r.g) for r in needed_grams(asked).groupBy("query").agg(F.collect_set("gram").alias("g")).collect()}
    assert grams == {"ab": {"ab"}, "abc": {"abc"}, "abcd": {"abc", "bcd"}, "abcdef": {"abcde", "bcdef"},
                     "ABCDEFGH": {"abcdefg", "bcdefgh"}, "ab%cdefg_x": {"ab", "cdefg", "x"}, "0001234": {"0001234"}}
    index = postings(spark.createDataFrame([(f"{k:07d}",) for k in range(4000)], "text string"))
    lists = {r.gram: r["count"] for r in index.filter(F.col("gram").isin("0001234", "01234", "123")).groupBy("gram").count().collect()}
    assert lists["0001234"] == 1 and lists["01234"] == 1 and lists["123"] > 10
