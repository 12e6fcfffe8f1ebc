import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starledger.operators import blocks, dips, vetting
from starledger.operators import lightcurve as lc
from starledger.operators import periodsearch as ps
from starledger.operators.quantiles import grouped_median, robust_sigma
from starledger.plans.processing import process

LIMITS = "tic_id bigint, period_min double, period_max double"


def frame(spark, t, f, tic=1):
    return spark.createDataFrame(pd.DataFrame({"tic_id": tic, "time": t, "flux": f}),
                                 "tic_id bigint, time double, flux double")


def inject(sectors, span, period, cadence_min=10.0, seed=1, depth=0.004, width=0.09):
    """Sectors of 27 days spread over the span, a box transit, white noise."""
    rng = np.random.default_rng(seed)
    starts = [0.0] if sectors == 1 else np.linspace(0.0, span - 27.0, sectors)
    t = np.concatenate([np.arange(s, s + 27.0, cadence_min / 1440.0) for s in starts])
    f = 1.0 + rng.normal(0.0, 3e-4, t.size)
    f[np.abs((t + 0.5 * period) % period - 0.5 * period) < width / 2] -= depth
    return t, f


def search(spark, t, f, low, high, **options):
    limits = spark.createDataFrame([(1, low, high)], LIMITS)
    return ps.search_periods(frame(spark, t, f), limits, **options).first()


@pytest.mark.parametrize("direct", [100_000, 1_000, 0])
def test_median_is_exact_for_hot_tied_and_tiny_groups(spark, monkeypatch, direct):
    monkeypatch.setattr("starledger.operators.quantiles.DIRECT", direct)
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"k": np.repeat([1, 2, 3, 4], [60000, 2, 1, 5000]),
                         "v": np.concatenate([rng.normal(size=60000), [1.0, 2.0], [7.0],
                                              np.repeat([0.0, 1.0], 2500)])})
    got = grouped_median(spark.createDataFrame(data), ["k"], "v").toPandas().set_index("k")["median"]
    want = data.groupby("k")["v"].median()
    assert (got.sort_index() == want).all()
    upper = grouped_median(spark.createDataFrame(data), ["k"], "v", upper=True).toPandas()
    assert upper.set_index("k")["median"][2] == 2.0
    whole = grouped_median(spark.createDataFrame(data), [], "v").first()[0]
    assert whole == data["v"].median()


def test_sigma_falls_back(spark):
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 1.0, 2.0])
    row = robust_sigma(df, ["tic_id"], "flux").first()
    assert row.centre == 1.0 and row.sigma == pytest.approx(0.4)
    flat = robust_sigma(frame(spark, [0.0, 1.0], [1.0, 1.0]), ["tic_id"], "flux").first()
    assert flat.sigma == 1e-9


def test_blocked_order_equals_whole_series_order(spark):
    rng = np.random.default_rng(2)
    t = np.sort(np.concatenate([rng.uniform(0, 30, 400), rng.uniform(45, 60, 300),
                                rng.uniform(80, 81, 50)]))
    df = frame(spark, t, np.ones_like(t))
    steps = blocks.with_previous_time(df, ["tic_id"], "time", 1.0, "prev").toPandas()
    steps = steps.sort_values("time")
    assert np.isnan(steps["prev"].iloc[0]) and (steps["prev"].iloc[1:].to_numpy() == t[:-1]).all()
    placed = blocks.with_places(df, ["tic_id"], "time", F.col("time") > 45, 2.0, "i", "g").toPandas()
    placed = placed.sort_values("time")
    assert (placed["i"].to_numpy() == np.arange(t.size)).all()
    assert (placed["g"].to_numpy() == np.cumsum(t > 45)).all()
    seg = blocks.gap_segments(df, ["tic_id"], "time", 10.0).toPandas()
    assert seg.groupby("segment")["_rows"].sum().tolist() == [400, 300, 50]
    best = blocks.longest_segment(df, ["tic_id"], "time", 10.0)
    assert best.count() == 400 and best.agg(F.max("time")).first()[0] < 30


def flatten_brute_force(t, f, window):
    def smooth(x):
        half, out = window // 2, np.empty_like(x)
        for i in range(x.size):
            lo = min(max(i - half, 0), x.size - window)
            fit = np.polyfit(np.arange(window), x[lo:lo + window], 2)
            out[i] = np.polyval(fit, i - lo)
        return out

    keep = np.abs(f - np.median(f)) <= 3 * np.std(f)
    for _ in range(3):
        tk, fk = t[keep], f[keep]
        step = np.diff(tk)
        cuts = np.where(step > 5 * np.median(step))[0] + 1
        trend = np.concatenate([smooth(p) if p.size >= window else np.full(p.size, np.median(p))
                                for p in np.split(fk, cuts)])
        calm = np.abs(fk - trend) < 3 * np.std(fk - trend) + 1e-14
        tk, trend = tk[calm], trend[calm]
        keep[np.flatnonzero(keep)[~calm]] = False
    return f / np.interp(t, tk, trend)


def test_detrend_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    t = np.concatenate([np.arange(0, 6, 0.01), np.arange(7, 9, 0.01), np.arange(20, 20.05, 0.01)])
    f = 1 + 0.01 * np.sin(t) + rng.normal(0, 1e-4, t.size)
    f[[50, 300, 301, 700]] += [0.05, -0.03, -0.03, 0.002]
    windows = spark.createDataFrame([(1, 31)], "tic_id bigint, window int")
    got = lc.detrend(frame(spark, t, f), windows).toPandas().sort_values("time")
    assert np.allclose(got["flux"].to_numpy(), flatten_brute_force(t, f, 31), atol=1e-9)


def test_binning_keeps_occupied_bins_only(spark):
    t = np.array([0.0, 0.001, 0.008, 100.0])
    rows = lc.bin_series(frame(spark, t, [1.0, 3.0, 5.0, 7.0])).toPandas().sort_values("time")
    assert rows["flux"].tolist() == [2.0, 5.0, 7.0] and rows["bin"].tolist() == [0, 1, 14400]


@pytest.mark.parametrize("period", [2.30, 6.78])
def test_box_search_recovers_one_sector(spark, period):
    t, f = inject(1, 27.0, period)
    found = search(spark, t, f, 0.6, 13.0)
    assert abs(found.period_days / period - 1) < 0.01 and found.snr > 7
    assert found.depth_ppm > 1000 and found.sde > 5


def test_box_search_recovers_a_short_period_over_five_years(spark):
    t, f = inject(3, 1876.0, 1.48, cadence_min=30.0)
    found = search(spark, t, f, 0.6, 50.0, durations=[0.06, 0.09, 0.14], chunk_periods=2000)
    assert abs(found.period_days / 1.48 - 1) < 0.01 and found.snr > 7
    assert found.n_periods > 120_000 and found.dp_over_p < 5e-5


def test_noise_stays_below_the_gate(spark):
    t = np.arange(0.0, 27.0, 10 / 1440.0)
    f = 1.0 + np.random.default_rng(7).normal(0, 3e-4, t.size)
    assert search(spark, t, f, 0.6, 13.0).snr < 7


def test_template_search_recovers(spark):
    t, f = inject(1, 27.0, 3.45)
    found, outcome = ps.template_check(frame(spark, t, f))
    row = found.first()
    assert row.method == "tls" and abs(row.period_days / 3.45 - 1) < 0.01 and row.snr > 7
    assert outcome.first().status == "ok"
    _, short = ps.template_check(frame(spark, t[:100], f[:100]))
    assert short.first().status == "skipped" and "100 pts" in short.first().reason


def test_single_event_localises_one_dip(spark):
    rng = np.random.default_rng(3)
    t = np.arange(0.0, 27.0, 10 / 1440.0)
    f = 1.0 + rng.normal(0, 3e-4, t.size)
    f[np.abs(t - 12.5) < 0.1] -= 0.01
    event = dips.single_events(frame(spark, t, f)).first()
    assert event.status == "ok" and abs(event.epoch - 12.5) < 0.3 and event.snr > 7
    flat = 1.0 + np.random.default_rng(5).normal(0, 1e-4, t.size)
    assert dips.single_events(frame(spark, t, flat)).first().snr < 7


def test_vetting_flags_unequal_eclipses(spark):
    t = np.arange(0.0, 27.0, 10 / 1440.0)
    f = 1.0 + np.random.default_rng(9).normal(0, 3e-4, t.size)
    cycle = np.round(t / 2.0)
    inside = np.abs((t + 1.0) % 2.0 - 1.0) < 0.05
    f[inside] -= np.where(cycle[inside] % 2 == 1, 0.02, 0.01)
    signal = spark.createDataFrame([(1, 2.0, 0.0, 2.4, 15000.0)],
                                   "tic_id bigint, period_days double, epoch_bjd double, "
                                   "duration_hr double, depth_ppm double")
    row = vetting.vet(frame(spark, t, f), signal).first()
    assert row.odd_even_sigma > 3 and row.fp_score >= 0.5 and "odd/even" in row.flags[0]
    assert vetting.scenario_rows(vetting.vet(frame(spark, t, f), signal)).count() == 3


def test_processing_is_honest_about_every_target(spark):
    t, f = inject(1, 27.0, 2.3, cadence_min=5.0)
    parts = [pd.DataFrame({"tic_id": 1, "sector": s, "cadence_s": 300, "time": t + start,
                           "flux": f * 1000 * s, "quality": 0})
             for s, start in ((1, 1000.0), (2, 1030.0))]
    parts.append(pd.DataFrame({"tic_id": 2, "sector": 1, "cadence_s": 300, "time": t[:60],
                               "flux": f[:60], "quality": 1}))
    points = spark.createDataFrame(pd.concat(parts), "tic_id bigint, sector bigint, cadence_s int, "
                                   "time double, flux double, quality bigint")
    targets = spark.createDataFrame([(10, 1, "gold_planet"), (20, 2, "gold_fp"),
                                     (30, 3, "discovery")],
                                    "target_id bigint, tic_id bigint, cohort string")
    done = process(points, targets, job=7)
    runs = {r.target_id: r for r in done.runs.collect()}
    assert runs[10].status == "ok" and runs[10].n_sectors == 2
    assert runs[10].n_points < 2 * t.size and runs[10].detrend.window_length_cadences >= 101
    assert (runs[20].status, runs[20].notes) == ("no_data", "all sectors empty after quality mask")
    assert (runs[30].status, runs[30].notes) == ("no_data", "no light-curve files")
    best = done.detections.filter("method = 'bls' AND rank = 1").first()
    assert abs(best.period_days / 2.3 - 1) < 0.01 and best.snr > 7
    assert best.pipeline_run_id == runs[10].pipeline_run_id
    kinds = {(r.method, r.rank) for r in done.detections.collect()}
    assert kinds == {("bls", 1), ("bls", 2), ("tls", 1)}
    assert runs[10].runtime_s > 0 and runs[10].started_at <= runs[10].finished_at
    assert len({r.pipeline_run_id >> 31 for r in runs.values()}) == 1


def test_a_failed_search_closes_its_target_only():
    def kernel(t, f, sigma, periods, durations):
        if t[0] < 0:
            raise ValueError("bad star")
        return np.ones(len(periods)), (1.0, 0.0, 0.1, 0.05, 9.0, 9.0)
    rows = pd.DataFrame({"tic_id": [1, 2], "first": [0, 0], "stop": [3, 3], "period_min": [0.6, 0.6],
                         "period_max": [5.0, 5.0], "n_periods": [3, 3], "sigma": [0.1, 0.1],
                         "t": [[-1.0, 2.0], [1.0, 2.0]], "f": [[1.0, 1.0], [1.0, 1.0]]})
    got = pd.concat(ps._search_chunks(kernel, [0.1])(iter([rows])))
    assert got["error"].tolist() == ["ValueError: bad star", None] and got["seconds"].min() >= 0


def test_every_segment_is_searched(spark):
    t, f = inject(1, 27.0, 3.1)
    longer = np.arange(100.0, 154.0, 10 / 1440.0)
    quiet = 1.0 + np.random.default_rng(2).normal(0, 3e-4, longer.size)
    both = frame(spark, np.concatenate([t, longer]), np.concatenate([f, quiet]))
    found, outcome = ps.template_check(both, grid_duration=0.1)
    row, told = found.first(), outcome.first()
    assert abs(row.period_days / 3.1 - 1) < 0.01 and row.segment_points == t.size    # the shorter segment
    assert (told.segments, told.short_segments, told.status) == (2, 0, "ok")


def test_job_store_grade_vet_and_report(spark, tmp_path):
    """The job's output goes through sinks, grading, vetting and the report unchanged."""
    from starledger.operators import grading
    from starledger.plans import reports
    from starledger.plans.processing import vet_targets

    t, f = inject(1, 27.0, 2.3)
    parts = [pd.DataFrame({"tic_id": k, "sector": 1, "cadence_s": 600, "time": t + 1000.0, "flux": f, "quality": q})
             for k, q in ((1, 0), (2, 0), (3, 1))]
    points = spark.createDataFrame(pd.concat(parts), "tic_id bigint, sector bigint, cadence_s int, "
                                   "time double, flux double, quality bigint")
    targets = spark.createDataFrame(
        [(10, 1, "gold_planet", "1.01", "KP", 2.3, 2458000.0, 900.0, "deep_short"),
         (20, 2, "gold_fp", "2.01", "FP", 4.6, 2458000.0, 900.0, "deep_short"),
         (30, 3, "discovery", "3.01", "PC", None, None, None, "single_transit")],
        "target_id bigint, tic_id bigint, cohort string, toi string, tfopwg_disp string, known_period_days double, "
        "known_epoch_bjd double, known_depth_ppm double, stratum string")
    runs_path, found_path = str(tmp_path / "runs"), str(tmp_path / "detections")
    for job in (1, 2):      # the second job's runs are the newest
        done = process(points, targets, job=job, data_vintage=f"v{job}", min_periods=300, grid_duration=0.2)
        done.store(runs_path, found_path)
    runs, detections = spark.read.parquet(runs_path), spark.read.parquet(found_path)
    assert runs.count() == 6 and {r.pipeline_run_id >> 31 for r in runs.collect()} == {1, 2}
    current = grading.current_detections(runs, detections)
    assert {r.pipeline_run_id >> 31 for r in current.collect()} == {2}
    planet = grading.planet_table(targets, current).first()
    assert planet.match == "exact" and planet.miss_reason is None
    assert [r.why for r in grading.failure_table(targets, runs).collect()] == ["all sectors empty after quality mask"]
    rows, outcome = vet_targets(done.series, targets, runs, detections)
    assert {(r.target_id, r.status) for r in outcome.collect()} == {(10, "ok"), (20, "ok"), (30, "no_detection")}
    flag = rows.filter("scenario = 'FP_FLAG' AND target_id = 10").first()
    assert '"bls_period_days":2.3' in flag.metrics.replace(" ", "") or "bls_period_days" in flag.metrics
    again, _ = vet_targets(done.series, targets.filter("target_id = 10"), runs, detections, rows)
    assert again.count() == rows.count() == 6
    report = reports.recovery_report(targets, runs, detections)
    counts = report["counts"].first()
    assert (counts.targets, counts.processed_ok, counts.recovered, counts.fp_signal) == (3, 2, 1, 1)
    times = report["runtimes"].first()
    assert times.median_s > 0 and times.vintage == "v2"


class Asked(Exception):
    """Raised by a stub instead of searching."""


@pytest.mark.parametrize("name", ["l05_box_search_chunked", "l06_second_pass_after_mask", "l07_template_search",
                                  "l09_target_processing_detections"])
def test_registered_searches_run_on_the_operators_own_grid(spark, monkeypatch, name):
    """The query's search has the default grid and durations, on bins of the default width."""
    from starledger import specs
    from starledger.registry import load, series
    asked, widths = [], []

    def search(*args, **named):
        asked.append(named)
        raise Asked

    def binned(points, minutes=specs.BIN_MINUTES):
        widths.append(minutes)
        return points
    monkeypatch.setattr(series.ps, "search_periods", search)
    monkeypatch.setattr(series.ps, "template_check", search)
    monkeypatch.setattr(series.processing, "process", search)
    monkeypatch.setattr(series.lc, "bin_series", binned)
    monkeypatch.setattr(series, "cut_lineage", lambda df, *_: df)
    monkeypatch.setattr(series, "_limits", lambda df: df)
    monkeypatch.setattr(series, "Tables", _AnyTables)
    with pytest.raises(Asked):
        load()[0][name](None, "")
    assert set(widths) <= {specs.BIN_MINUTES}
    assert not {"durations", "grid_duration", "min_periods"} & set(asked[0])


class _AnyTables:
    """Frames whose every method gives the frame."""

    def __init__(self, *_):
        pass

    def __getattr__(self, _):
        return self

    def __call__(self, *_):
        return self


def _plain_search(t, flux, sigma, periods, durations, template):
    """Every length at every bin of every fold, one by one: power of each period."""
    dip, n = np.median(flux) - flux, t.size
    width = durations.min() / (4.0 if template else ps.BOX_OVERSAMPLE)
    power = []
    for period in periods:
        n_bins = int(np.ceil(period / width))
        place = np.minimum((np.mod(t - t.min(), period) / width).astype(int), n_bins - 1)
        best = 0.0
        for length in np.rint(durations / width).astype(int):
            for start in range(n_bins if length <= n_bins else 0):
                at = (place - start) % n_bins
                if template:
                    shape = np.append(ps.transit_shape(length), 0.0)[np.minimum(at, length)]
                    best = max(best, (shape * dip).sum() / sigma / np.sqrt((shape ** 2).sum()) if shape.any() else 0.0)
                elif 0 < (at < length).sum() < n:
                    inside = at < length
                    best = max(best, (dip[inside].mean() - dip[~inside].mean())
                               / (sigma * np.sqrt(1 / inside.sum() + 1 / (~inside).sum())))
        power.append(best)
    return np.array(power)


@pytest.mark.parametrize("sparse", [0.01, 8, 1e9])
def test_searches_fit_every_place_of_a_fold(monkeypatch, sparse):
    """Folds evaluated at their points only, or at every bin, have the powers of the plain search."""
    monkeypatch.setattr(ps, "SPARSE", sparse)
    rng = np.random.default_rng(5)
    durations = np.array([0.04, 0.1, 0.5])
    for n in (3, 40):
        t, flux = np.sort(rng.uniform(0, 9, n)), 1 + rng.gamma(1.0, 0.01, n)
        periods = 0.3 * np.exp(np.linspace(0, np.log(15), 25))       # the longest box does not fit the first ones
        for kernel, template in ((ps.box_search, False), (ps.template_search, True)):
            power, best = kernel(t, flux, 0.01, periods, durations)
            assert np.allclose(power, _plain_search(t, flux, 0.01, periods, durations, template), atol=1e-9)
            assert best[5] == pytest.approx(power.max()) and best[0] in periods
