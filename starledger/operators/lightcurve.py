"""Light curves in long format: mask, normalise, stitch, detrend, bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger import specs
from starledger.operators.blocks import sliding_sums, with_places, with_previous_time
from starledger.operators.quantiles import grouped_median
from starledger.session import cut_lineage

DETREND_ITERATIONS = 3
CLIP_SIGMA = 3.0
BREAK_TOLERANCE = 5.0
# Block width (days) for order-dependent steps on unbinned cadences.
_BLOCK_DAYS = 1.0


def is_finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def good_cadences(points: DataFrame, min_good: int = specs.MIN_GOOD_CADENCES) -> DataFrame:
    """Unflagged cadences with finite flux, from sectors that keep at least ``min_good`` of them.

    The count is an aggregate joined back; a window would sort each sector in one task.
    """
    good = points.filter((F.coalesce("quality", F.lit(0)) == 0) & is_finite(F.col("flux")))
    sectors = good.groupBy("tic_id", "sector").agg(F.count(F.lit(1)).alias("_n"))
    return good.join(sectors.filter(F.col("_n") >= min_good), ["tic_id", "sector"], "left_semi")


def poor_sectors(points: DataFrame, min_good: int = specs.MIN_GOOD_CADENCES) -> DataFrame:
    """(tic_id, poor_sectors): how many sectors :func:`good_cadences` leaves out, where any."""
    usable = (F.coalesce("quality", F.lit(0)) == 0) & is_finite(F.col("flux"))
    sectors = points.groupBy("tic_id", "sector").agg(F.count(F.when(usable, 1)).alias("_n"))
    return (sectors.filter(F.col("_n") < min_good).groupBy("tic_id")
            .agg(F.count(F.lit(1)).alias("poor_sectors")))


def normalise(points: DataFrame) -> DataFrame:
    """Flux over the median of its sector."""
    medians = grouped_median(points, ["tic_id", "sector"], "flux", "_median")
    return (points.join(medians, ["tic_id", "sector"])
            .withColumn("flux", F.col("flux") / F.col("_median")).drop("_median"))


def series_meta(points: DataFrame) -> DataFrame:
    """(tic_id, n_sectors, n_points, baseline_days) of stitched series."""
    sectors = points.groupBy("tic_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    return sectors.groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n_sectors"), F.sum("n").alias("n_points"),
        (F.max("last") - F.min("first")).alias("baseline_days"))


def detrend_window(sectors: DataFrame, window_days: float = specs.DETREND_WINDOW_DAYS) -> DataFrame:
    """(tic_id, window): odd filter length in cadences, at least 101.

    ``sectors`` has one row per (tic_id, sector) with its cadence, so the median is over as many
    rows as the target has sectors.
    """
    cadence = F.coalesce(F.col("cadence_s"), F.lit(120)).cast("double")
    length = F.rint(F.lit(window_days * 86400.0) / F.median(cadence)).cast("int")
    return sectors.groupBy("tic_id").agg(
        F.greatest(F.lit(101), length.bitwiseOR(F.lit(1))).alias("window"))


def _quadratic(window: Column, f0: Column, f1: Column, f2: Column, u: Column) -> Column:
    """Value at ``u`` of the quadratic that fits an odd window best (Savitzky & Golay 1964).

    ``f0``, ``f1`` and ``f2`` are the window's sums of flux, u flux and u^2 flux, u counted from its middle.
    """
    m = (window - 1) / 2
    s2 = m * (m + 1) * (2 * m + 1) / 3
    s4 = s2 * (3 * m * m + 3 * m - 1) / 5
    bend = (window * f2 - s2 * f0) / (window * s4 - s2 * s2)
    return (f0 - bend * s2) / window + f1 / s2 * u + bend * u * u


def _trend_of_segments(segmented: DataFrame) -> DataFrame:
    """(tic_id, time, flux, trend) for rows with segment, idx, n, window.

    The sliding quadratic fit needs three sums over the window, of flux, x flux and x^2 flux, which
    are differences of running sums.  Long segments are worked on in chunks of eight windows plus a
    halo of half a window, x counted from the chunk, so no task holds more than nine windows of a
    series.  The first and last half window lie on the fit of the first and last whole one.
    Segments shorter than a window get their median.
    """
    is_long = (F.col("n") >= F.col("window")) & (F.col("n") >= BREAK_TOLERANCE)
    half = F.floor(F.col("window") / 2)
    rows = segmented.withColumns({"chunk_rows": F.col("window") * 8, "half": half})
    long = rows.filter(is_long)
    last = F.floor((F.col("n") - 1) / F.col("chunk_rows"))
    reach = F.sequence(F.greatest(F.floor((F.col("idx") - F.col("half")) / F.col("chunk_rows")), F.lit(0)),
                       F.least(F.floor((F.col("idx") + F.col("half")) / F.col("chunk_rows")), last))
    x = F.col("idx") - F.col("chunk") * F.col("chunk_rows")
    chunked = long.select("tic_id", "segment", "time", "flux", "idx", "n", "window", "chunk_rows", "half",
                          F.explode(reach).alias("chunk")).withColumns(
        {"x": x.cast("double"), "place": x / (F.col("half") + 0.5)})       # half a step of room: whole steps compare safely
    # The middle of the chunk's flux is taken off and put back: running sums of small numbers lose no digits.
    level = F.avg("flux").over(Window.partitionBy("tic_id", "segment", "chunk"))
    levelled = chunked.withColumn("level", level).withColumn("off", F.col("flux") - F.col("level"))
    summed = sliding_sums(levelled, ["tic_id", "segment", "chunk"], "place", {
        "m0": F.col("off"), "m1": F.col("off") * F.col("x"), "m2": F.col("off") * F.col("x") * F.col("x")}, [1.0])
    own = summed.filter(F.floor(F.col("idx") / F.col("chunk_rows")) == F.col("chunk"))
    x = F.col("x")
    around = _quadratic(F.col("window"), F.col("m0_0"), F.col("m1_0") - x * F.col("m0_0"),
                        F.col("m2_0") - 2 * x * F.col("m1_0") + x * x * F.col("m0_0"), F.lit(0.0)) + F.col("level")
    ends = []
    for name, inside, middle in (("head", F.col("idx") < F.col("window"), F.col("half")),
                                 ("tail", F.col("idx") >= F.col("n") - F.col("window"), F.col("n") - 1 - F.col("half"))):
        u = (F.col("idx") - middle).cast("double")
        ends += [F.sum(F.when(inside, F.col("flux") * power)).alias(f"{name}{k}")
                 for k, power in enumerate((F.lit(1.0), u, u * u))]
    edges = long.groupBy("tic_id", "segment").agg(*ends)
    fitted = {name: _quadratic(F.col("window"), *[F.col(f"{name}{k}") for k in range(3)],
                               (F.col("idx") - middle).cast("double"))
              for name, middle in (("head", F.col("half")), ("tail", F.col("n") - 1 - F.col("half")))}
    trend = (F.when(F.col("idx") < F.col("half"), fitted["head"])
             .when(F.col("idx") >= F.col("n") - F.col("half"), fitted["tail"]).otherwise(around))
    smoothed = own.join(edges, ["tic_id", "segment"]).select("tic_id", "time", "flux", trend.alias("trend"))
    short = rows.filter(~is_long)
    medians = grouped_median(short, ["tic_id", "segment"], "flux", "trend")
    flat = short.join(medians, ["tic_id", "segment"]).select("tic_id", "time", "flux", "trend")
    return smoothed.unionByName(flat)


def _segment(kept: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with their gap-free segment, position and length; a gap is 5 median steps.

    Every step reads its input twice (block totals, then rows), so each is materialised.
    """
    stepped = with_previous_time(kept, ["tic_id"], "time", _BLOCK_DAYS, "_previous")
    stepped = cut_lineage(stepped.withColumn("_step", F.col("time") - F.col("_previous"))
                          .drop("_previous"), "steps")
    usual = grouped_median(stepped, ["tic_id"], "_step", "_usual")
    breaks = F.col("_step") > F.lit(BREAK_TOLERANCE) * F.col("_usual")
    numbered = cut_lineage(with_places(stepped.join(usual, "tic_id", "left"), ["tic_id"], "time",
                                       breaks, _BLOCK_DAYS, "_place", "segment")
                           .drop("_step", "_usual"), "places")
    spans = numbered.groupBy("tic_id", "segment").agg(
        F.min("_place").alias("_start"), F.count(F.lit(1)).alias("n"))
    return numbered.join(spans.join(windows, "tic_id"), ["tic_id", "segment"]).select(
        "tic_id", "time", "flux", "segment", (F.col("_place") - F.col("_start")).alias("idx"), "n",
        "window")


def _interpolated(points: DataFrame, trend: DataFrame) -> DataFrame:
    """Trend at every time: own value where there is one, else linear between its neighbours.

    Beyond the first and last kept row the nearest kept trend holds.
    """
    block = F.floor(F.col("time") / _BLOCK_DAYS).cast("bigint").alias("_block")
    known = F.struct("time", "trend")
    edges = trend.groupBy("tic_id", block).agg(F.min(known).alias("_first"),
                                               F.max(known).alias("_last"))
    per_tic = "PARTITION BY tic_id ORDER BY _block"
    # The nearest kept row on each side, carried across blocks by the block table.
    blocks = (points.select("tic_id", block).distinct()
              .join(edges, ["tic_id", "_block"], "left").selectExpr(
        "tic_id", "_block",
        f"last(_last, true) OVER ({per_tic} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) _in",
        f"first(_first, true) OVER ({per_tic} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) "
        "_out"))
    marked = points.select("tic_id", "time", "flux", block).join(
        trend.select("tic_id", "time", "trend"), ["tic_id", "time"], "left").withColumn(
        "_own", F.when(F.col("trend").isNotNull(), known))
    inside = "PARTITION BY tic_id, _block ORDER BY time"
    sided = marked.join(blocks, ["tic_id", "_block"]).selectExpr(
        "tic_id", "time", "flux", "trend",
        f"coalesce(last(_own, true) OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "CURRENT ROW), _in) AS _left",
        f"coalesce(first(_own, true) OVER ({inside} ROWS BETWEEN CURRENT ROW AND "
        "UNBOUNDED FOLLOWING), _out) AS _right")
    share = (F.col("time") - F.col("_left.time")) / (F.col("_right.time") - F.col("_left.time"))
    between = F.col("_left.trend") + share * (F.col("_right.trend") - F.col("_left.trend"))
    value = F.coalesce("trend", between, F.col("_left.trend"), F.col("_right.trend"))
    return sided.select("tic_id", "time", "flux", value.alias("trend"))


def detrend(points: DataFrame, windows: DataFrame) -> DataFrame:
    """(tic_id, time, flux) with the slow trend divided out.

    Quadratic smoothing over ``windows`` (tic_id, window) cadences, broken at gaps, with three
    rounds of 3-sigma clipping; each round is one pass over the kept rows and is materialised
    before the next.  Masked cadences get the trend of their neighbours.
    """
    points = points.filter(is_finite(F.col("flux")))
    centre = grouped_median(points, ["tic_id"], "flux", "_centre")
    spread = points.groupBy("tic_id").agg(F.stddev_pop("flux").alias("_spread"))
    near = F.abs(F.col("flux") - F.col("_centre")) <= F.col("_spread") * CLIP_SIGMA
    kept = cut_lineage(points.join(centre, "tic_id").join(spread, "tic_id").filter(near)
                       .select("tic_id", "time", "flux"), "kept")
    for _ in range(DETREND_ITERATIONS):
        trend = cut_lineage(_trend_of_segments(_segment(kept, windows)), "trend")
        residual = F.col("flux") - F.col("trend")
        spread = trend.groupBy("tic_id").agg(F.stddev_pop(residual).alias("_spread"))
        calm = F.abs(residual) < F.col("_spread") * CLIP_SIGMA + F.lit(1e-14)
        trend = trend.join(spread, "tic_id").filter(calm).select(trend.columns)
        kept = trend.select("tic_id", "time", "flux")
    full = _interpolated(points, trend)
    return full.select("tic_id", "time", (F.col("flux") / F.col("trend")).alias("flux"))


def bin_series(points: DataFrame, bin_minutes: float = specs.BIN_MINUTES) -> DataFrame:
    """Mean time and flux of each occupied bin, bins counted from the series' first time."""
    starts = points.groupBy("tic_id").agg(F.min("time").alias("_start"))
    width = F.lit(bin_minutes / 1440.0)
    index = F.floor((F.col("time") - F.col("_start")) / width).cast("bigint")
    return (points.join(starts, "tic_id").groupBy("tic_id", index.alias("bin"))
            .agg(F.avg("time").alias("time"), F.avg("flux").alias("flux"))
            .filter(is_finite(F.col("time")) & is_finite(F.col("flux"))))
