"""Dense ordered row ids without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger.session import cut_lineage


def with_dense_id(df: DataFrame, id_col: str, order_by: list[str], start: int = 1,
                  offset: DataFrame | None = None) -> DataFrame:
    """Number the rows start, start+1, ... in the order of ``order_by`` (which must be total).

    Rows are range-partitioned on the order, so every task numbers its own range; a table of one
    row per partition carries the offsets.  The sorted rows are materialised first, because a
    recomputed range sort could place rows differently than the counts assumed.  ``offset`` is an
    optional one-row frame whose ``offset`` column is added to every id.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window is as small as the partition count.
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    base = F.lit(0) if offset is None else offset.select("offset").scalar()
    offsets = counts.select("_part", (before + base).alias("_before"))
    place_in_part = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (place_in_part + F.col("_before") + F.lit(start)).cast("bigint"))
            .drop("_place", "_part", "_before"))
