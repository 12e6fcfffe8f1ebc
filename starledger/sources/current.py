"""A maintained table of current rows: new files are folded in, readers never scan the history.

The table holds one row per key, in versions.  A fold reduces the new rows to one per key, merges them with
the current version and writes the next one; only then does a marker name it.  The rows of a
version lie in ``BUCKETS`` folders by the key's hash, and a fold rewrites just those that the new rows touch: the
others are named by the version's index where they are.  Late rows lose to newer ones, and folding the
same rows again changes nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.operators.links import union_all

BUCKETS = 64


class CurrentRows:
    """The newest row per key under ``root``; ``newest`` reduces any rows to one per key."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str],
                 newest: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.newest, self.buckets = spark, root, keys, newest, buckets

    def _index(self) -> DataFrame | None:
        """(version, bucket, path, ddl) of the newest version: at most a row per bucket."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "index"))
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        every = self.spark.read.schema("version int, bucket int, path string, ddl string").parquet(
            os.path.join(self.root, "index"))
        return every.filter(F.col("version") == every.agg(F.max("version")).scalar())

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The current rows; an error before the first fold."""
        index = self._index()
        if index is None:
            raise ValueError(f"nothing has been folded into {self.root}")
        return self._rows(index.collect())

    def _rows(self, entries: list) -> DataFrame:
        # An explicit schema: a fold without rows leaves a version without files.
        reader = self.spark.read.schema(entries[0].ddl)
        paths = sorted({r.path for r in entries if r.path})
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], entries[0].ddl)

    def fold(self, new: DataFrame) -> int:
        """Merge ``new`` into the table; returns the number of buckets that were rewritten."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        index = self._index()
        entries = index.collect() if index is not None else []           # at most a row per bucket
        version = entries[0].version + 1 if entries else 1
        where = {r.bucket: r.path for r in entries if r.path}
        folder = os.path.join(self.root, "rows", f"{version}-{uuid.uuid4().hex}")
        fresh = os.path.join(folder, "new")
        (self.newest(new).withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket")
         .write.partitionBy("_bucket").parquet(fresh))
        delta = self.spark.read.schema(f"{ddl}, `_bucket` int").parquet(fresh)
        touched = sorted(r[0] for r in delta.select("_bucket").distinct().collect())
        if touched:
            held = [where[b] for b in touched if b in where]
            both = [delta.drop("_bucket")] + ([self.spark.read.schema(ddl).parquet(*held)] if held else [])
            merged = self.newest(union_all(both)) if held else both[0]
            (merged.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket")
             .write.partitionBy("_bucket").parquet(os.path.join(folder, "rows")))
        where.update({b: os.path.join(folder, "rows", f"_bucket={b}") for b in touched})
        lines = [(version, b, p, ddl) for b, p in sorted(where.items())] or [(version, -1, None, ddl)]
        (self.spark.createDataFrame(lines, "version int, bucket int, path string, ddl string").coalesce(1)
         .write.mode("append").parquet(os.path.join(self.root, "index")))
        return len(touched)
