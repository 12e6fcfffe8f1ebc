"""An ordered list stored for paging: any page is read from the one or two ranges that hold it.

A list is numbered once in its total order and written in ranges of ``RANGE`` places, a folder each.  The
place says which ranges a page lies in, so a reader prunes all others, however deep the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.operators.ids import with_dense_id

RANGE = 10_000


def store_list(rows: DataFrame, order: list[Column | str], path: str, places: int = RANGE) -> None:
    """Write ``rows`` with ``place``, counted from 0 in ``order``, which must be total."""
    numbered = with_dense_id(rows, "place", order, start=0)
    (numbered.withColumn("_range", F.floor(F.col("place") / places).cast("bigint"))
     .repartition("_range").sortWithinPartitions("place").write.partitionBy("_range").parquet(path))


def read_page(spark: SparkSession, path: str, limit: int, offset: int = 0, places: int = RANGE) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a stored list, in order, with their place."""
    if limit < 1 or offset < 0:
        raise ValueError("a page has a positive length and begins at 0 or later")
    first, last = offset // places, (offset + limit - 1) // places
    held = spark.read.parquet(path).filter(F.col("_range").between(first, last))
    return held.filter(F.col("place").between(offset, offset + limit - 1)).drop("_range").orderBy("place")


def list_length(spark: SparkSession, path: str) -> DataFrame:
    """One row (n)."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
