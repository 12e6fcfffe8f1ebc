"""Time series in blocks: order-dependent work without one task per series.

A series may hold a third of all rows, so no window here partitions by series alone unless its
input was first reduced to one row per time block.  Rows are worked on per (series, block);
what crosses a block edge travels through the small block table or through halo copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def _running(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def gap_segments(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """(keys, _block, segment): which gap-free segment each block of width ``gap`` belongs to.

    Two rows of one block are closer than ``gap``, so a segment can only break between blocks:
    the first and last time per block decide every break.
    """
    blocks = df.groupBy(*keys, block_of(F.col(t), gap).alias("_block")).agg(
        F.min(t).alias("_first"), F.max(t).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    order = _running(keys, "_block")
    breaks = (F.col("_first") - F.lag("_last").over(order) > F.lit(gap)).cast("int")
    flagged = blocks.withColumn("_break", F.coalesce(breaks, F.lit(0)))
    return flagged.withColumn(
        "segment", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_break")


def in_segments(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """Every row with the number of its gap-free segment, counted from 0 in each series."""
    parts = gap_segments(df, keys, t, gap).select(*keys, "_block", "segment")
    return (df.withColumn("_block", block_of(F.col(t), gap))
            .join(parts, [*keys, "_block"]).drop("_block"))


def longest_segment(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """Rows of each series' segment with the longest baseline; the earliest one on a tie."""
    parts = gap_segments(df, keys, t, gap)
    spans = parts.groupBy(*keys, "segment").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    best = spans.groupBy(*keys).agg(
        F.max_by("segment", F.struct(F.col("_last") - F.col("_first"), -F.col("segment")))
        .alias("segment"))
    kept = parts.join(best, [*keys, "segment"], "left_semi").select(*keys, "_block", "segment")
    return (df.withColumn("_block", block_of(F.col(t), gap))
            .join(kept, [*keys, "_block"]).drop("_block"))


def with_previous_time(df: DataFrame, keys: list[str], t: str, width: float,
                       out: str = "previous") -> DataFrame:
    """Each row with the time of the row before it in its series (NULL for the first)."""
    blocked = df.withColumn("_block", block_of(F.col(t), width))
    ends = blocked.groupBy(*keys, "_block").agg(F.max(t).alias("_last"))
    ends = ends.select(*keys, "_block",
                       F.lag("_last").over(_running(keys, "_block")).alias("_entry"))
    inside = F.lag(t).over(Window.partitionBy(*keys, "_block").orderBy(t))
    return (blocked.join(ends, [*keys, "_block"])
            .withColumn(out, F.coalesce(inside, F.col("_entry")))
            .drop("_block", "_entry"))


def with_places(df: DataFrame, keys: list[str], t: str, flag: Column, width: float,
                place: str, group: str) -> DataFrame:
    """Each row with its 0-based position in its series and the number of flags up to it.

    One pass: block totals of rows and flags carry both counts from block to block.
    """
    blocked = df.withColumns({"_block": block_of(F.col(t), width),
                              "_flag": F.coalesce(flag, F.lit(False)).cast("bigint")})
    sums = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"),
                                                F.sum("_flag").alias("_flags"))
    before = _running(keys, "_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_flags").over(before), F.lit(0)).alias("_flags_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(t)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (blocked.join(sums, [*keys, "_block"])
            .withColumns({place: F.row_number().over(inside) - 1 + F.col("_rows_before"),
                          group: F.sum("_flag").over(upto) + F.col("_flags_before")})
            .drop("_block", "_flag", "_rows_before", "_flags_before"))


def with_row_index(df: DataFrame, keys: list[str], t: str, order: list[str], width: float,
                   out: str = "row_index", total: str = "row_count") -> DataFrame:
    """Each row with its 0-based position in its series and the length of the series."""
    blocked = df.withColumn("_block", block_of(F.col(t), width))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    per_series = Window.partitionBy(*keys)
    before = F.sum("_size").over(
        per_series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"),
                         F.sum("_size").over(per_series).alias(total))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return (blocked.join(sizes, [*keys, "_block"])
            .withColumn(out, (place - 1 + F.col("_before")).cast("bigint"))
            .drop("_block", "_before"))


def with_halo(df: DataFrame, t: str, width: float, halo: float) -> DataFrame:
    """Copies of each row for every block that can see it, as ``_block``; own block as ``_home``."""
    reach = F.sequence(block_of(F.col(t) - F.lit(halo), width),
                       block_of(F.col(t) + F.lit(halo), width))
    return (df.withColumn("_home", block_of(F.col(t), width))
            .withColumn("_block", F.explode(reach)))


def sliding_sums(df: DataFrame, within: list[str], at: str, values: dict[str, Column],
                 reaches: list[float]) -> DataFrame:
    """Sums over the rows at most ``reach`` away, both ends included, as ``<name>_<i>`` per value and reach.

    A box's sum is what lies up to its far end, plus what lies from its near end on, less everything.
    Both are running sums, which grow row by row whatever the reach, one along ``at`` and one against
    it: two sorts and O(n) for all values and reaches, where a sliding frame costs rows times box.
    ``within`` must name groups of bounded size (blocks with their halos).
    """
    by = ", ".join(f"`{k}`" for k in within)
    held = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_against", -F.col(at))
    bounds = [repr(float(reach)) + "D" for reach in reaches]

    def running(order: str, side: str) -> list[Column]:
        return [F.expr(f"sum(`_v_{n}`) OVER (PARTITION BY {by} ORDER BY `{order}` RANGE BETWEEN UNBOUNDED PRECEDING "
                       f"AND {bound} FOLLOWING)").alias(f"_{side}_{n}_{i}")
                for i, bound in enumerate(bounds) for n in values]

    there = held.select("*", *running(at, "upto"),
                        *[F.expr(f"sum(`_v_{n}`) OVER (PARTITION BY {by})").alias(f"_all_{n}") for n in values])
    both = there.select("*", *running("_against", "from"))
    boxes = [(F.col(f"_upto_{n}_{i}") + F.col(f"_from_{n}_{i}") - F.col(f"_all_{n}")).alias(f"{n}_{i}")
             for i in range(len(reaches)) for n in values]
    return both.select(*df.columns, *boxes)


def sliding_boxes(df: DataFrame, keys: list[str], t: str, value: str,
                  durations: list[float], block_width: float | None = None) -> DataFrame:
    """Mean and count of ``value`` in a time box around each row, one pair per duration.

    Boxes include both ends.  Columns are ``mean_i`` and ``count_i``.  Sums are taken of the distance from
    the block's first value, so that differences of running sums lose no digits.
    """
    halo = max(durations) / 2.0
    width = block_width or 8.0 * max(durations)
    halos = with_halo(df, t, width, halo)
    by = [*keys, "_block"]
    level = F.first(value, ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = halos.withColumn("_level", level)
    known = F.col(value).isNotNull()
    boxes = sliding_sums(rows, by, t, {"_sum": F.when(known, F.col(value) - F.col("_level")).otherwise(0.0),
                                       "count": known.cast("bigint")}, [d / 2.0 for d in durations])
    means = [F.when(F.col(f"count_{i}") > 0, F.col("_level") + F.col(f"_sum_{i}") / F.col(f"count_{i}"))
             .alias(f"mean_{i}") for i in range(len(durations))]
    own = boxes.filter(F.col("_home") == F.col("_block"))
    return own.select(*df.columns, *[c for i, m in enumerate(means) for c in (m, F.col(f"count_{i}"))])
