import math

from pyspark.sql import functions as F

from starledger.functions import frames, numeric, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_norm_name(spark):
    got = values(spark, [("Kepler-227 b",), ("KEPLER 227 B",), (None,), ("  TOI-1836  ",),
                         ("Straße é",)], "s string", text.norm_name(F.col("s")))
    assert [g[0] for g in got] == ["kepler 227 b", "kepler 227 b", "", "toi 1836", "strasse é"]


def test_relative_difference(spark):
    pairs = [(5.0, 5.0), (5.0, None), (5.0, 0.0), (5.0, 5.05), (2.0, 4.0), (4.0, 2.0)]
    got = values(spark, pairs, "a double, b double", numeric.rel_diff(F.col("a"), F.col("b")))
    want = [0.0, None, None, 0.05 / 5.05, 0.5, 0.5]
    assert all((g[0] is None and w is None) or math.isclose(g[0], w, abs_tol=1e-12)
               for g, w in zip(got, want))


def test_periods_match_is_strict_and_null_safe(spark):
    pairs = [(5.0, 5.03), (5.0, 5.06), (5.0, None), (10.0, 5.0)]
    got = values(spark, pairs, "a double, b double",
                 numeric.periods_match(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, False, False, False]


def test_canonical_name_priority(spark):
    rows = [("Kepler-227 b", "1836.01", None, None), (None, "1836.01", "K1", "2"),
            (None, None, "K00752.01", "2"), (None, None, None, "17361.01"),
            ("", "", "", None)]
    got = values(spark, rows, "p string, t string, k string, c string", text.canonical_name(
        F.col("p"), F.col("t"), F.col("k"), F.col("c"), F.lit("star 5")))
    assert [g[0] for g in got] == ["Kepler-227 b", "TOI 1836.01", "KOI K00752.01",
                                   "CTOI 17361.01", "star 5"]


def test_tic_cells(spark):
    rows = [("TIC 158722002",), ("158722002",), ("",), ("not a tic",), (None,)]
    got = values(spark, rows, "s string", text.coerce_cell("tic", F.col("s")))
    assert [g[0] for g in got] == [158722002, 158722002, None, None, None]


def test_number_cells_refuse_java_suffixes(spark):
    rows = [("12345.0",), ("12d",), ("1e3",), ("-.5",), ("nan",), ("x",), (" 7 ",)]
    got = values(spark, rows, "s string", text.coerce_cell("int", F.col("s")),
                 text.to_number(F.col("s")))
    assert [g[0] for g in got] == [12345, None, 1000, 0, None, None, 7]
    assert got[1][1] is None and math.isnan(got[4][1]) and got[3][1] == -0.5


def test_clean_reference(spark):
    rows = [("<a href='x'>Smith et al. 2020 </a>",), ("<br>",), ("",), (None,)]
    got = values(spark, rows, "s string", text.clean_reference(F.col("s")))
    assert [g[0] for g in got] == ["Smith et al. 2020", None, "", None]


def test_decimal_text(spark):
    got = spark.sql("SELECT CAST(1.43036990 AS DECIMAL(28,10)) a, CAST(500 AS DECIMAL(28,10)) b, "
                    "CAST(0 AS DECIMAL(28,10)) c").select(
        *[text.decimal_text(F.col(c)) for c in "abc"]).first()
    assert list(got) == ["1.4303699", "500", "0"]


def test_harmonics(spark):
    rows = [(2.0, 2.0), (4.02, 2.0), (1.0, 2.0), (2.5, 2.0), (0.0, 2.0), (2.0, None), (2.01, 2.0)]
    got = values(spark, rows, "a double, b double", numeric.harmonic_of(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [1.0, 2.0, 0.5, None, None, None, 1.0]


def test_transit_mask(spark):
    df = spark.range(1000).select((F.col("id") * 10.0 / 999).alias("t"))
    kept = df.filter(numeric.outside_transit(F.col("t"), F.lit(2.0), F.lit(1.0), F.lit(2.4)))
    times = [r.t for r in kept.collect()]
    assert len(times) < 1000 and min(abs(t - 3.0) for t in times) > 0.05


def test_period_grid_grows_with_baseline(spark):
    df = spark.createDataFrame([(27.0,), (1876.0,)], "b double")
    size = numeric.grid_size(F.col("b"), F.lit(0.6), F.lit(50.0))
    n_short, n_long = [r[0] for r in df.select(size).collect()]
    assert n_long > 300_000 > n_short and math.log(50 / 0.6) / n_long < 1.4e-5


def test_time_columns(spark):
    row = spark.sql("SELECT TIMESTAMP '2000-01-01 12:00:00' AS t, '2026-07-16T05:00:00Z' AS z, "
                    "'2026-07-16T05:00:00' AS naive, 'soon' AS bad").select(
        frames.julian_date(F.col("t")), frames.parse_iso(F.col("z")) == frames.parse_iso(
            F.col("naive")), frames.parse_iso(F.col("bad")), frames.iso_utc(F.col("t"))).first()
    assert row[0] == 2451545.0 and row[1] and row[2] is None and row[3] == "2000-01-01T12:00:00Z"
