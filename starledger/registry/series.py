"""Light curves: preparation, period search, dips, vetting, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import dips, grading
from starledger.operators import lightcurve as lc
from starledger.operators import periodsearch as ps
from starledger.operators import vetting
from starledger.operators.blocks import in_segments
from starledger.plans import processing
from starledger.registry import query
from starledger.registry.aggregates import GRADE_VIEWS, GRADED
from starledger.registry.ranking import BOX_DAYS
from starledger.registry.scalars import MISS, SIGMA, _PMOD
from starledger.registry.snapshots import GOOD, MIN_GOOD
from starledger.registry.views import Tables, with_views
from starledger.session import cut_lineage

# The driver's series have a few dozen rows in a month, so the windows and bins of the SQL-checked
# queries are as coarse; the searches without an oracle run on the operators' own bins and grid.
BIN_MINUTES = 360
# Trial periods as fine as the shortest of these durations asks for, on every series' own baseline.
GRID_DAYS = [0.5, 1.0]
GRID = {"grid_duration": min(GRID_DAYS), "min_periods": 100}


@query("l01_normalise_per_sector", with_views("points") + f", {GOOD}" + """
    , med AS (SELECT tic_id, sector, median(flux) AS m FROM good GROUP BY 1, 2)
    SELECT tic_id, sector, event_id, round(flux / m, 9) AS flux FROM good JOIN med USING (tic_id, sector)""")
def _(spark, sf_dir):
    rows = lc.normalise(lc.good_cadences(Tables(spark, sf_dir).points, MIN_GOOD))
    return rows.select("tic_id", "sector", "event_id", F.round("flux", 9).alias("flux"))


@query("l02_stitched_series_meta", with_views("points") + f", {GOOD}" + """
    SELECT tic_id, count(DISTINCT sector) AS n_sectors, count(*) AS n_points,
           round(max(time) - min(time), 6) AS baseline_days FROM good GROUP BY 1""")
def _(spark, sf_dir):
    rows = lc.series_meta(lc.good_cadences(Tables(spark, sf_dir).points, MIN_GOOD))
    return rows.select("tic_id", "n_sectors", "n_points",
                       F.round("baseline_days", 6).alias("baseline_days"))


@query("l02_detrend_window", with_views("points") + """
    , sectors AS (SELECT tic_id, sector, coalesce(min(cadence_s), 120) AS c FROM points
                  GROUP BY 1, 2)
    SELECT tic_id, greatest(101, CAST(round_even(64800 / median(c), 0) AS INTEGER) | 1) AS window_len
    FROM sectors GROUP BY 1""")
def _(spark, sf_dir):
    sectors = Tables(spark, sf_dir).points.groupBy("tic_id", "sector").agg(
        F.min("cadence_s").alias("cadence_s"))
    return lc.detrend_window(sectors).withColumnRenamed("window", "window_len")


def _detrend_sql(window: int, rounds: int = 3) -> str:
    """Three rounds of sliding quadratic fits with clipping, as running frames over rows."""
    m = window // 2
    s2 = m * (m + 1) * (2 * m + 1) / 3
    s4 = s2 * (3 * m * m + 3 * m - 1) / 5

    def fit(f0, f1, f2, u):
        bend = f"(({window} * ({f2}) - {s2}e0 * ({f0})) / {window * s4 - s2 * s2!r})"
        return f"((({f0}) - {bend} * {s2}e0) / {window}e0 + ({f1}) / {s2}e0 * ({u}) + {bend} * ({u}) * ({u}))"

    around = fit("m0", "m1 - idx * m0", "m2 - 2 * idx * m1 + idx * idx * m0", "0e0")
    head, tail = fit("h0", "h1", "h2", f"idx - {m}"), fit("t0", "t1", "t2", f"idx - (n - 1 - {m})")
    steps = ["""good AS (SELECT * FROM monitor WHERE quality = 0
            QUALIFY count(*) OVER (PARTITION BY tic_id, sector) >= 50),
        level AS (SELECT tic_id, sector, median(flux) AS m FROM good GROUP BY 1, 2),
        pts AS (SELECT tic_id, time, flux / m AS flux FROM good JOIN level USING (tic_id, sector)),
        first_clip AS (SELECT tic_id, median(flux) AS c, stddev_pop(flux) AS s FROM pts GROUP BY 1),
        kept0 AS (SELECT p.* FROM pts p JOIN first_clip USING (tic_id) WHERE abs(flux - c) <= 3 * s)"""]
    for r in range(rounds):
        steps.append(f"""step{r} AS (SELECT *, time - lag(time) OVER (PARTITION BY tic_id ORDER BY time) AS step FROM kept{r}),
        usual{r} AS (SELECT tic_id, median(step) AS usual FROM step{r} GROUP BY 1),
        seg{r} AS (SELECT s.*, sum(CASE WHEN step > 5 * usual THEN 1 ELSE 0 END)
            OVER (PARTITION BY tic_id ORDER BY time) AS segment FROM step{r} s JOIN usual{r} USING (tic_id)),
        idx{r} AS (SELECT tic_id, segment, time, flux, count(*) OVER (PARTITION BY tic_id, segment) AS n,
            CAST(row_number() OVER (PARTITION BY tic_id, segment ORDER BY time) - 1 AS DOUBLE) AS idx FROM seg{r}),
        sums{r} AS (SELECT *, sum(flux) OVER w AS m0, sum(idx * flux) OVER w AS m1, sum(idx * idx * flux) OVER w AS m2
            FROM idx{r} WINDOW w AS (PARTITION BY tic_id, segment ORDER BY idx ROWS BETWEEN {m} PRECEDING AND {m} FOLLOWING)),
        ends{r} AS (SELECT tic_id, segment, median(flux) AS middle, sum(flux) FILTER (idx < {window}) AS h0,
            sum(flux * (idx - {m})) FILTER (idx < {window}) AS h1, sum(flux * (idx - {m}) * (idx - {m})) FILTER (idx < {window}) AS h2,
            sum(flux) FILTER (idx >= n - {window}) AS t0, sum(flux * (idx - (n - 1 - {m}))) FILTER (idx >= n - {window}) AS t1,
            sum(flux * (idx - (n - 1 - {m})) * (idx - (n - 1 - {m}))) FILTER (idx >= n - {window}) AS t2
            FROM idx{r} GROUP BY 1, 2),
        trend{r} AS (SELECT tic_id, time, flux, CASE WHEN n < {window} THEN middle WHEN idx < {m} THEN {head}
            WHEN idx >= n - {m} THEN {tail} ELSE {around} END AS trend FROM sums{r} JOIN ends{r} USING (tic_id, segment)),
        noise{r} AS (SELECT tic_id, stddev_pop(flux - trend) AS s FROM trend{r} GROUP BY 1),
        kept{r + 1} AS (SELECT t.* FROM trend{r} t JOIN noise{r} USING (tic_id) WHERE abs(flux - trend) < 3 * s + 1e-14)""")
    return ", ".join(steps) + f""", marked AS (SELECT p.tic_id, p.time, p.flux, k.trend,
            CASE WHEN k.trend IS NOT NULL THEN p.time END AS known FROM pts p
            LEFT JOIN kept{rounds} k ON k.tic_id = p.tic_id AND k.time = p.time),
        sided AS (SELECT *, last_value(known IGNORE NULLS) OVER b AS lt, last_value(trend IGNORE NULLS) OVER b AS lf,
            first_value(known IGNORE NULLS) OVER a AS rt, first_value(trend IGNORE NULLS) OVER a AS rf FROM marked
            WINDOW b AS (PARTITION BY tic_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   a AS (PARTITION BY tic_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT tic_id, round(time, 6) AS time, round(flux / coalesce(trend, lf + (time - lt) / (rt - lt) * (rf - lf), lf, rf), 6)
            AS flux FROM sided"""


@query("l03_transit_safe_detrend", with_views("monitor") + ", " + _detrend_sql(101))
def _(spark, sf_dir):
    """The operator's own window over dense series: 0.75 days, 101 cadences at least."""
    good = cut_lineage(lc.normalise(lc.good_cadences(Tables(spark, sf_dir).monitor)))
    sectors = good.groupBy("tic_id", "sector").agg(F.min("cadence_s").alias("cadence_s"))
    flat = lc.detrend(good.select("tic_id", "time", "flux"), lc.detrend_window(sectors))
    return flat.select("tic_id", F.round("time", 6).alias("time"), F.round("flux", 6).alias("flux"))


@query("l04_time_binning", with_views("series") + f"""
    , s AS (SELECT tic_id, min(time) AS t0 FROM series GROUP BY 1),
    b AS (SELECT tic_id, CAST(floor((time - t0) / ({BIN_MINUTES} / 1440e0)) AS BIGINT) AS bin, time, flux
          FROM series JOIN s USING (tic_id))
    SELECT tic_id, bin, round(avg(time), 6) AS time, round(avg(flux), 9) AS flux FROM b GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = lc.bin_series(Tables(spark, sf_dir).series, BIN_MINUTES)
    return rows.select("tic_id", "bin", F.round("time", 6).alias("time"),
                       F.round("flux", 9).alias("flux"))


@query("l04_time_binning_own_width", with_views("series") + f"""
    , two AS (SELECT tic_id % 2 AS tic_id, time, flux FROM series),
    s AS (SELECT tic_id, min(time) AS t0 FROM two GROUP BY 1),
    b AS (SELECT tic_id, CAST(floor((time - t0) / ({specs.BIN_MINUTES} / 1440e0)) AS BIGINT) AS bin, time, flux
          FROM two JOIN s USING (tic_id))
    SELECT tic_id, bin, round(avg(time), 6) AS time, round(avg(flux), 9) AS flux FROM b GROUP BY 1, 2""")
def _(spark, sf_dir):
    """Bins of the operator's own ten minutes over two series that hold all rows."""
    two = Tables(spark, sf_dir).series.select((F.col("tic_id") % 2).alias("tic_id"), "time", "flux")
    return lc.bin_series(two).select("tic_id", "bin", F.round("time", 6).alias("time"), F.round("flux", 9).alias("flux"))


FOLD_PERIODS = [1.5, 2.25, 3.0, 4.5]
FOLD_DAYS = [0.25, 0.5]
FOLD_BIN = 0.125
_LENGTHS = [int(round(d / FOLD_BIN)) for d in FOLD_DAYS]


@query("l05_box_search_folded", with_views("series") + f", {SIGMA}" + f"""
    , folded AS (SELECT tic_id, period, CAST(floor((time % period) / {FOLD_BIN}) AS BIGINT) AS bin, flux
        FROM series CROSS JOIN (SELECT unnest({FOLD_PERIODS}::DOUBLE[]) AS period)),
    sums AS (SELECT tic_id, period, bin, count(*) AS n, sum(flux) AS s FROM folded GROUP BY 1, 2, 3),
    totals AS (SELECT tic_id, period, sum(n) AS n_all, sum(s) AS s_all,
        CAST(ceil(period / {FOLD_BIN}) AS BIGINT) AS n_bins FROM sums GROUP BY 1, 2),
    starts AS (SELECT *, unnest(range(0, n_bins)) AS start FROM totals),
    lens AS (SELECT unnest({_LENGTHS}) AS len),
    boxes AS (SELECT t.tic_id, t.period, start, len, n_all, s_all, sum(n) AS n_in, sum(s) AS s_in
        FROM starts t CROSS JOIN lens JOIN sums b ON b.tic_id = t.tic_id AND b.period = t.period
        AND (b.bin - start + n_bins) % n_bins < len GROUP BY 1, 2, 3, 4, 5, 6),
    scored AS (SELECT *, (s_all - s_in) / (n_all - n_in) - s_in / n_in AS depth FROM boxes
        WHERE n_in < n_all),
    snrs AS (SELECT *, depth / (sigma * sqrt(1e0 / n_in + 1e0 / (n_all - n_in))) AS snr FROM scored
        JOIN noise USING (tic_id) WHERE depth > 0)
    SELECT DISTINCT ON (tic_id, period) tic_id, period, round(snr, 6) AS snr,
        len * {FOLD_BIN}e0 AS duration, start AS phase_bin, CAST(n_in AS BIGINT) AS n_in FROM snrs
    ORDER BY tic_id, period, round(snr, 9) DESC, len, start""")
def _(spark, sf_dir):
    rows = ps.folded_boxes(Tables(spark, sf_dir).series, FOLD_PERIODS, FOLD_DAYS, FOLD_BIN)
    return rows.select("tic_id", "period", F.round("snr", 6).alias("snr"), "duration",
                       "phase_bin", "n_in")


def _binned(t: Tables, minutes: float = specs.BIN_MINUTES):
    return cut_lineage(lc.bin_series(t.series, minutes).select("tic_id", "time", "flux"))


def _limits(series):
    return series.groupBy("tic_id").agg(
        F.lit(specs.PERIOD_MIN_DAYS).alias("period_min"),
        F.greatest((F.max("time") - F.min("time")) / 2.0, F.lit(1.0)).alias("period_max"))


def _found_columns(df):
    return df.select("tic_id", "method", F.round("period_days", 6).alias("period_days"),
                     F.round("snr", 6).alias("snr"), F.round("sde", 6).alias("sde"), "n_periods")


TEMPLATE_DAYS = [1.0, 2.0]
TEMPLATE_GRID = {"grid_duration": min(TEMPLATE_DAYS), "min_periods": 100}


def _folded_grid(width: float, days: float, minutes: float = BIN_MINUTES, least: int = 100) -> str:
    """Binned series folded on their log grids: trials and phase-bin sums of (median - flux)."""
    return f""", s0 AS (SELECT tic_id, min(time) AS t0 FROM series GROUP BY 1),
    binned AS (SELECT tic_id, avg(time) AS time, avg(flux) AS flux FROM series JOIN s0 USING (tic_id)
        GROUP BY tic_id, CAST(floor((time - t0) / ({minutes} / 1440e0)) AS BIGINT)),
    base AS (SELECT tic_id, min(time) AS t0, max(time) - min(time) AS span, median(flux) AS med,
        stddev_pop(flux) AS std, count(*) AS n_all, sum(flux) AS s_all FROM binned GROUP BY 1),
    noise AS (SELECT b.tic_id, CASE WHEN median(abs(flux - med)) > 0 THEN
        median(abs(flux - med)) * 1.4826e0 ELSE any_value(std) END AS sigma
        FROM binned b JOIN base USING (tic_id) GROUP BY 1),
    sized AS (SELECT *, greatest(span / 2, 1e0) AS top, greatest({least}, CAST(ceil(ln(greatest(span / 2, 1e0)
        / 0.6e0) / ({days}e0 / greatest(span, 1e0) / 2e0)) AS INTEGER)) AS np FROM base),
    trial AS (SELECT *, 0.6e0 * exp(i * ln(top / 0.6e0) / (np - 1)) AS p
        FROM (SELECT *, unnest(range(0, np)) AS i FROM sized)),
    folded AS (SELECT t.tic_id, i, least(CAST(floor(((b.time - t0) % p) / {width}e0) AS BIGINT),
        CAST(ceil(p / {width}e0) AS BIGINT) - 1) AS place, med - flux AS dip
        FROM trial t JOIN binned b USING (tic_id)),
    sums AS (SELECT tic_id, i, place, count(*) AS n, sum(dip) AS w FROM folded GROUP BY 1, 2, 3),"""


def _box_power(width: float, lengths: list[int]) -> str:
    """Best box of every trial, evaluated where its content changes: as a point enters or has left."""
    longest = max(lengths)
    boxes = {f"a{n}": f"RANGE BETWEEN 1 FOLLOWING AND {n} FOLLOWING" for n in lengths} | {
        f"b{n}": f"RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW" for n in lengths}
    picked = ", ".join(f"""CASE WHEN n_{w} > 0 AND n_{w} < n_all THEN (w_{w} / n_{w} - (total - w_{w}) / (n_all - n_{w}))
        / (sigma * sqrt(1e0 / n_{w} + 1e0 / (n_all - n_{w}))) ELSE 0 END""" for w in boxes)
    summed = ", ".join(f"sum(n) OVER {w} AS n_{w}, sum(w) OVER {w} AS w_{w}" for w in boxes)
    frames = ", ".join(f"{w} AS (PARTITION BY tic_id, i ORDER BY place {frame})" for w, frame in boxes.items())
    return f"""
    sized_sums AS (SELECT s.*, CAST(ceil(p / {width}e0) AS BIGINT) AS nb FROM sums s
        JOIN trial USING (tic_id, i)),
    wrapped AS (SELECT *, true AS own FROM sized_sums
        UNION ALL SELECT tic_id, i, place + nb, n, w, nb, false FROM sized_sums WHERE place < {longest}
        UNION ALL SELECT tic_id, i, place - nb, n, w, nb, false FROM sized_sums WHERE place >= nb - {longest}),
    boxes AS (SELECT tic_id, i, own, {summed} FROM wrapped WINDOW {frames}),
    power AS (SELECT tic_id, i, greatest(0, max(greatest({picked}))) AS p
        FROM (SELECT b.*, n_all, n_all * med - s_all AS total, sigma FROM boxes b JOIN base USING (tic_id)
            JOIN noise USING (tic_id) WHERE own) GROUP BY 1, 2)"""


_SEARCH_WIDTH = min(specs.TRIAL_DURATIONS_DAYS) / ps.BOX_OVERSAMPLE


@query("l05_box_search_chunked", with_views("series") + f"""
    {_folded_grid(_SEARCH_WIDTH, 0.05, specs.BIN_MINUTES, 3000)}
    {_box_power(_SEARCH_WIDTH, [round(d / _SEARCH_WIDTH) for d in specs.TRIAL_DURATIONS_DAYS])},
    best AS (SELECT DISTINCT ON (tic_id) tic_id, i, p FROM power ORDER BY tic_id, round(p, 9) DESC, i),
    spread AS (SELECT tic_id, median(p) AS m, stddev_pop(p) AS s, CAST(count(*) AS INTEGER) AS n_periods
        FROM power GROUP BY 1)
    SELECT tic_id, 'bls' AS method, round(t.p, 6) AS period_days, round(b.p, 6) AS snr,
        round((b.p - m) / s, 6) AS sde, n_periods
    FROM best b JOIN spread USING (tic_id) JOIN trial t USING (tic_id, i)""")
def _(spark, sf_dir):
    series = _binned(Tables(spark, sf_dir))
    return _found_columns(ps.search_periods(series, _limits(series), "bls"))


@query("l05_box_search_grid", with_views("series") + f"""
    {_folded_grid(0.05, 0.5)}
    dense AS (SELECT tic_id, i, nb, n_all, n_all * med - s_all AS total, unnest(range(0, nb + 19)) AS b
        FROM (SELECT *, CAST(ceil(p / 0.05e0) AS BIGINT) AS nb FROM trial)),
    filled AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM dense d
        LEFT JOIN sums s ON s.tic_id = d.tic_id AND s.i = d.i AND s.place = d.b % nb),
    boxes AS (SELECT *, sum(n) OVER s10 AS n10, sum(w) OVER s10 AS w10, sum(n) OVER s20 AS n20,
        sum(w) OVER s20 AS w20 FROM filled
        WINDOW s10 AS (PARTITION BY tic_id, i ORDER BY b ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING),
               s20 AS (PARTITION BY tic_id, i ORDER BY b ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    tried AS (SELECT tic_id, i, n_all, total, n10 AS n_in, w10 AS w_in FROM boxes WHERE b < nb
        UNION ALL SELECT tic_id, i, n_all, total, n20, w20 FROM boxes WHERE b < nb AND nb >= 20),
    power AS (SELECT tic_id, i, greatest(0, max((w_in / n_in - (total - w_in) / (n_all - n_in))
        / (sigma * sqrt(1e0 / n_in + 1e0 / (n_all - n_in))))) AS p FROM tried JOIN noise USING (tic_id)
        WHERE n_in > 0 AND n_in < n_all GROUP BY 1, 2)
    SELECT tic_id, round(max(p), 5) AS snr, round((max(p) - median(p)) / stddev_pop(p), 4) AS sde,
        CAST(count(*) AS INTEGER) AS n_periods FROM power GROUP BY 1""")
def _(spark, sf_dir):
    series = _binned(Tables(spark, sf_dir), BIN_MINUTES)
    found = ps.search_periods(series, _limits(series), "bls", durations=GRID_DAYS, chunk_periods=100,
                              **GRID)
    return found.select("tic_id", F.round("snr", 5).alias("snr"), F.round("sde", 4).alias("sde"),
                        "n_periods")


@query("l06_second_pass_after_mask")
def _(spark, sf_dir):
    series = _binned(Tables(spark, sf_dir))
    limits = _limits(series)
    first = ps.search_periods(series, limits, "bls")
    left = cut_lineage(ps.without_signal(series, first, 10))
    return _found_columns(ps.search_periods(left, limits, "bls"))


@query("l06_mask_of_signal", with_views("series", "points") + f"""
    , signal AS (SELECT tic_id, 1e0 + tic_id % 7 AS p, 0.5e0 AS e, 12e0 AS d FROM points GROUP BY 1),
    kept AS (SELECT s.* FROM series s JOIN signal USING (tic_id)
        WHERE abs({_PMOD.format(a='time - e + 0.5e0 * p', b='p')} - 0.5e0 * p) > d / 24 / 2 * 1.1e0)
    SELECT tic_id, count(*) AS n, round(sum(time), 5) AS total FROM kept GROUP BY 1 HAVING count(*) > 10""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept = ps.without_signal(t.series, _signals(t), 10)
    return kept.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum("time"), 5).alias("total"))


@query("l07_template_search")
def _(spark, sf_dir):
    found, _ = ps.template_check(_binned(Tables(spark, sf_dir)), 20, 2.0)
    return _found_columns(found)


@query("l07_template_search_grid", with_views("series") + f"""
    {_folded_grid(0.25, 1.0)}
    raw_shape AS (SELECT len, k, sqrt(1 - pow((k + 0.5e0) / len * 2 - 1, 2)) AS mu
        FROM (SELECT len, unnest(range(0, len)) AS k FROM (SELECT unnest([4, 8]) AS len))),
    unscaled AS (SELECT len, k, 1 - 0.4804e0 * (1 - mu) - 0.1867e0 * pow(1 - mu, 2) AS s FROM raw_shape),
    shape AS (SELECT len, k, s / max(s) OVER (PARTITION BY len) AS s FROM unscaled),
    fits AS (SELECT tic_id, i, len, (place - k + nb) % nb AS start, sum(w * s) AS cross_sum,
        sum(n * s * s) AS norm FROM sums JOIN (SELECT tic_id, i, CAST(ceil(p / 0.25e0) AS BIGINT) AS nb
            FROM trial) USING (tic_id, i) JOIN shape ON len <= nb GROUP BY 1, 2, 3, 4),
    power AS (SELECT t.tic_id, t.i, greatest(0, coalesce(max(cross_sum / sqrt(norm) / sigma), 0)) AS p
        FROM trial t JOIN noise USING (tic_id) LEFT JOIN fits f ON f.tic_id = t.tic_id AND f.i = t.i
        GROUP BY 1, 2)
    SELECT tic_id, round(max(p), 5) AS snr, round((max(p) - median(p)) / stddev_pop(p), 4) AS sde
    FROM power GROUP BY 1""")
def _(spark, sf_dir):
    series = _binned(Tables(spark, sf_dir), BIN_MINUTES)
    found = ps.search_periods(series, _limits(series), "tls", durations=TEMPLATE_DAYS, chunk_periods=100,
                              **TEMPLATE_GRID)
    return found.select("tic_id", F.round("snr", 5).alias("snr"), F.round("sde", 4).alias("sde"))


@query("l07_template_outcome", with_views("series") + """
    , stepped AS (SELECT *, time - lag(time) OVER (PARTITION BY tic_id ORDER BY time) AS step FROM series),
    seg AS (SELECT *, sum(CASE WHEN step > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY tic_id ORDER BY time)
            AS g FROM stepped),
    spans AS (SELECT tic_id, g, count(*) AS n, max(time) - min(time) AS b FROM seg GROUP BY 1, 2),
    fit AS (SELECT tic_id, count(*) FILTER (n >= 55 AND b >= 2) AS segments,
            count(*) FILTER (NOT (n >= 55 AND b >= 2)) AS short_segments FROM spans GROUP BY 1),
    best AS (SELECT DISTINCT ON (tic_id) * FROM spans ORDER BY tic_id, b DESC, g)
    SELECT tic_id, CASE WHEN segments > 0 THEN 'ok' ELSE 'skipped' END AS status, segments, short_segments,
           n AS segment_points, CASE WHEN segments = 0 THEN 'best segment too short (' || n
           || ' pts, ' || format('{:.1f}', b) || ' d)' END AS reason FROM best JOIN fit USING (tic_id)""")
def _(spark, sf_dir):
    pieces = in_segments(Tables(spark, sf_dir).series, ["tic_id"], "time", specs.SEGMENT_GAP_DAYS)
    spans = pieces.groupBy("tic_id", "segment").agg(
        (F.max("time") - F.min("time")).alias("baseline_days"), F.count(F.lit(1)).alias("segment_points"))
    return ps.template_outcome(spans, 55).select("tic_id", "status", "segments", "short_segments",
                                                 "segment_points", "reason")


def _event_sql(view: str, days: list[float], least: int) -> str:
    """The best dip over all cadences and widths of a series."""
    sigma = SIGMA.replace("FROM series", f"FROM {view}")
    return with_views(view) + f", {sigma}, boxed AS (" + " UNION ALL ".join(
        f"""SELECT tic_id, time, {i} AS i, {d}e0 AS duration, avg(flux) OVER w AS mean, count(*) OVER w AS n
        FROM {view} WINDOW w AS (PARTITION BY tic_id ORDER BY time RANGE BETWEEN {d / 2}e0 PRECEDING
        AND {d / 2}e0 FOLLOWING)""" for i, d in enumerate(days)) + f"""),
    dip AS (SELECT *, (centre - mean) / (sigma / sqrt(n)) AS snr FROM boxed JOIN noise USING (tic_id)
        WHERE n >= {least} AND mean < centre),
    top AS (SELECT DISTINCT ON (tic_id) * FROM dip ORDER BY tic_id, snr DESC, i, time)
    SELECT n.tic_id, CASE WHEN t.snr IS NULL THEN 'no_event' ELSE 'ok' END AS status,
        round(t.time, 6) AS epoch, round(t.duration * 24, 6) AS duration_hr,
        round(coalesce(t.snr, 0), 6) AS snr, t.n AS n_in_transit
    FROM noise n LEFT JOIN top t USING (tic_id)"""


@query("l08_single_event_scan", _event_sql("monitor", specs.TRIAL_DURATIONS_DAYS, dips.MIN_IN_BOX))
def _(spark, sf_dir):
    """The operator's own widths and least number of points, over dense series."""
    return _events_of(dips.single_events(Tables(spark, sf_dir).monitor))


@query("l08_single_event_scan_sparse", _event_sql("series", BOX_DAYS, 3))
def _(spark, sf_dir):
    return _events_of(dips.single_events(Tables(spark, sf_dir).series, BOX_DAYS, min_in_box=3))


def _events_of(rows):
    return rows.select("tic_id", "status", F.round("epoch", 6).alias("epoch"),
                       F.round("duration_hr", 6).alias("duration_hr"), F.round("snr", 6).alias("snr"),
                       "n_in_transit")


def _job(t: Tables):
    """Every second series has a target; one target in seven has no light curve at all."""
    targets = t.points.select("tic_id").distinct().select(
        F.col("tic_id").alias("target_id"),
        F.when(F.col("tic_id") % 7 == 0, F.col("tic_id") + 100000000).otherwise(F.col("tic_id"))
        .alias("tic_id"),
        F.when(F.col("tic_id") % 3 == 0, "discovery").otherwise("gold_planet").alias("cohort"))
    return processing.process(t.points, targets, min_good=MIN_GOOD, second_points=10, segment_points=20)


@query("l09_target_processing_runs", with_views("points") + f", {GOOD}" + """
    , t AS (SELECT DISTINCT tic_id AS target_id, CASE WHEN tic_id % 7 = 0 THEN tic_id + 100000000
            ELSE tic_id END AS tic_id FROM points),
    g AS (SELECT tic_id, count(DISTINCT sector) AS n_sectors FROM good GROUP BY 1)
    SELECT target_id, t.tic_id, CASE WHEN g.tic_id IS NULL THEN 'no_data' ELSE 'ok' END AS status,
        n_sectors, CASE WHEN g.tic_id IS NOT NULL THEN NULL WHEN t.tic_id >= 100000000
        THEN 'no light-curve files' ELSE 'all sectors empty after quality mask' END AS why
    FROM t LEFT JOIN g ON g.tic_id = t.tic_id""")
def _(spark, sf_dir):
    runs = _job(Tables(spark, sf_dir)).runs
    return runs.select("target_id", "tic_id", "status", "n_sectors",
                       F.when(F.col("status") != "ok", F.col("notes")).alias("why"))


@query("l09_target_processing_detections")
def _(spark, sf_dir):
    return _job(Tables(spark, sf_dir)).detections.select(
        "tic_id", "method", "rank", F.round("period_days", 6).alias("period_days"),
        F.round("snr", 6).alias("snr"))


def _signals(t: Tables):
    return t.points.select("tic_id").distinct().select(
        "tic_id", (F.col("tic_id") % 7 + F.lit(1.0)).alias("period_days"),
        F.lit(0.5).alias("epoch_bjd"), F.lit(12.0).alias("duration_hr"),
        (F.col("tic_id") % 5 * F.lit(30000.0)).alias("depth_ppm"))


VETTED = f"""signal AS (SELECT tic_id, 1e0 + tic_id % 7 AS p, tic_id % 5 * 30000e0 AS depth FROM points
        GROUP BY 1),
    fold AS (SELECT tic_id, flux, p, depth, abs({_PMOD.format(a='time - 0.5e0 + 0.5e0 * p', b='p')}
        - 0.5e0 * p) < 0.25e0 AS tr, (round_even((time - 0.5e0) / p, 0) % 2 + 2) % 2 AS cyc,
        abs({_PMOD.format(a='time - 0.5e0', b='p')} / p - 0.5e0) < 0.25e0 / p AS sec
        FROM series JOIN signal USING (tic_id)),
    outm AS (SELECT tic_id, median(flux) AS om FROM fold WHERE NOT tr GROUP BY 1),
    outs AS (SELECT tic_id, median(abs(flux - om)) * 1.4826e0 AS os FROM fold JOIN outm USING (tic_id)
        WHERE NOT tr GROUP BY 1),
    st AS (SELECT tic_id, any_value(depth) AS depth, median(flux) AS med, stddev_pop(flux) AS std,
        count(*) FILTER (WHERE tr) AS n_tr, count(*) FILTER (WHERE tr AND cyc = 1) AS n_odd,
        count(*) FILTER (WHERE tr AND cyc = 0) AS n_even, count(*) FILTER (WHERE sec) AS n_sec,
        avg(flux) FILTER (WHERE tr AND cyc = 1) AS m_odd, avg(flux) FILTER (WHERE tr AND cyc = 0)
        AS m_even, avg(flux) FILTER (WHERE sec) AS m_sec FROM fold GROUP BY 1),
    sg AS (SELECT *, CASE WHEN os > 0 THEN os WHEN std > 0 THEN std ELSE 1e-9 END AS s
        FROM st LEFT JOIN outs USING (tic_id)),
    vetted AS (SELECT tic_id, n_tr AS n_in_transit, depth,
        CASE WHEN n_odd >= 3 AND n_even >= 3 THEN abs((med - m_odd) - (med - m_even))
            / sqrt(pow(s / sqrt(n_odd), 2) + pow(s / sqrt(n_even), 2)) END AS oe,
        CASE WHEN n_sec >= 3 THEN (med - m_sec) / (s / sqrt(n_sec)) END AS sec_snr FROM sg)"""


@query("l10_false_positive_vetting", with_views("points", "series") + f", {VETTED}" + """
    SELECT tic_id, n_in_transit, round(oe, 6) AS odd_even_sigma, round(sec_snr, 6) AS secondary_snr,
        round(greatest(0e0, coalesce(CASE WHEN oe > 3 THEN least(0.5 + 0.1 * (oe - 3), 0.95) END, 0),
            coalesce(CASE WHEN sec_snr > 5 THEN least(0.5 + 0.05 * (sec_snr - 5), 0.95) END, 0),
            CASE WHEN depth > 100000 THEN 0.6 ELSE 0 END), 3) AS fp_score,
        CASE WHEN oe > 3 THEN 1 ELSE 0 END + CASE WHEN sec_snr > 5 THEN 1 ELSE 0 END
        + CASE WHEN depth > 100000 THEN 1 ELSE 0 END AS n_flags FROM vetted""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = vetting.vet(t.series, _signals(t))
    clean = F.array_contains("flags", "no strong FP tell")
    return rows.select("tic_id", "n_in_transit", F.round("odd_even_sigma", 6).alias("odd_even_sigma"),
                       F.round("secondary_snr", 6).alias("secondary_snr"), "fp_score",
                       F.when(clean, 0).otherwise(F.size("flags")).alias("n_flags"))


@query("l10_vetting_scenarios", with_views("points", "series") + f", {VETTED}" + """
    , scored AS (SELECT *, greatest(0e0,
            coalesce(CASE WHEN oe > 3 THEN least(0.5 + 0.1 * (oe - 3), 0.95) END, 0),
            coalesce(CASE WHEN sec_snr > 5 THEN least(0.5 + 0.05 * (sec_snr - 5), 0.95) END, 0),
            CASE WHEN depth > 100000 THEN 0.6 ELSE 0 END) AS score FROM vetted)
    SELECT tic_id, scenario, 'heuristic_vetting' AS tool, round(CASE scenario WHEN 'odd_even' THEN oe
        WHEN 'secondary' THEN sec_snr ELSE round(score, 3) END, 6) AS probability,
        CASE WHEN scenario = 'FP_FLAG' THEN n_in_transit END AS n_in_transit
    FROM scored CROSS JOIN (VALUES ('odd_even'), ('secondary'), ('FP_FLAG')) AS v(scenario)""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = vetting.scenario_rows(vetting.vet(t.series, _signals(t)))
    return rows.select("tic_id", "scenario", "tool", F.round("probability", 6).alias("probability"),
                       F.get_json_object("metrics", "$.n_in_transit").cast("bigint").alias("n_in_transit"))


def _current(t: Tables):
    return grading.current_detections(t.runs, t.detections)


_HARMONIC_TEXT = """CASE WHEN abs(harmonic - 1) < 1e-6 THEN 'exact' ELSE 'harmonic x' || CASE
    round(harmonic, 4) WHEN 2 THEN '2' WHEN 0.5 THEN '0.5' WHEN 3 THEN '3' WHEN 0.3333 THEN '0.333333'
    WHEN 1.5 THEN '1.5' ELSE '0.666667' END END"""


@query("l11_recovery_grading", with_views(*GRADE_VIEWS) + f", {GRADED}" + f"""
    , off AS (SELECT target_id, {_PMOD.format(a='epoch_bjd - (known_epoch_bjd - 2457000)',
        b='known_period_days')} / known_period_days AS d FROM recovered)
    SELECT t.target_id, t.toi, t.known_period_days, round(r.period_days, 6) AS period_days, r.method,
        CASE WHEN r.harmonic IS NOT NULL THEN {_HARMONIC_TEXT} END AS match, round(r.snr, 6) AS snr,
        round(least(d, 1 - d), 5) AS phase_offset,
        CASE WHEN r.harmonic IS NULL THEN {MISS.replace('known_period_days', 't.known_period_days')}
        END AS miss_reason
    FROM targets t LEFT JOIN recovered r USING (target_id) LEFT JOIN off USING (target_id)
    LEFT JOIN strongest s USING (target_id) WHERE t.cohort = 'gold_planet'""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = grading.planet_table(t.targets, _current(t))
    return rows.select("target_id", "toi", "known_period_days",
                       F.round("period_days", 6).alias("period_days"), "method", "match",
                       F.round("snr", 6).alias("snr"),
                       F.round("phase_offset", 5).alias("phase_offset"), "miss_reason")


@query("l11_method_credit", with_views(*GRADE_VIEWS) + f", {GRADED}" + """
    SELECT method, count(DISTINCT target_id) AS recovered FROM graded WHERE cohort = 'gold_planet'
    AND harmonic IS NOT NULL AND snr >= 7 GROUP BY 1""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grading.method_credit(t.targets, _current(t))


@query("l12_false_positive_cohort", with_views(*GRADE_VIEWS) + f", {GRADED}" + """
    , tested AS (SELECT t.target_id, toi, best_period, best_snr, len(list_filter([1e0, 2e0, 0.5e0, 3e0,
        1e0 / 3e0, 1.5e0, 2e0 / 3e0], lambda h: best_period > 0 AND known_period_days > 0
        AND abs(best_period - known_period_days * h) / (known_period_days * h) <= 0.01e0)) > 0 AS hit
        FROM targets t LEFT JOIN strongest USING (target_id) WHERE cohort = 'gold_fp')
    SELECT target_id, toi, round(best_period, 6) AS best_period, best_snr, CASE WHEN hit
        THEN 'signal@catalog-P' WHEN best_snr >= 7 THEN 'signal' ELSE 'no signal' END AS verdict
    FROM tested""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grading.false_positive_table(t.targets, _current(t)).select(
        "target_id", "toi", F.round("best_period", 6).alias("best_period"), "best_snr", "verdict")


@query("l13_discovery_cohort", with_views(*GRADE_VIEWS) + f", {GRADED}" + """
    SELECT t.target_id, toi, stratum, round(best_period, 6) AS best_period, best_snr, event_snr,
        coalesce(event_snr, 0) >= 7 OR coalesce(best_snr, 0) >= 7 AS credible
    FROM targets t LEFT JOIN strongest USING (target_id) LEFT JOIN event USING (target_id)
    WHERE cohort = 'discovery'""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grading.discovery_table(t.targets, _current(t)).select(
        "target_id", "toi", "stratum", F.round("best_period", 6).alias("best_period"), "best_snr",
        "event_snr", "credible")


@query("l14_failed_runs", with_views("runs", "targets") + """
    , newest_run AS (SELECT DISTINCT ON (target_id) target_id, status, notes FROM runs
        ORDER BY target_id, pipeline_run_id DESC)
    SELECT t.target_id, toi, t.tic_id, status, notes AS why FROM targets t
    JOIN newest_run USING (target_id) WHERE status <> 'ok'""")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grading.failure_table(t.targets, t.runs)
