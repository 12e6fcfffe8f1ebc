"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same six.
SPACE = b" \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: no clash with internal names, whatever the names were."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The positional name of ``column``; the exact name wins over another capitalisation."""
    names = df.columns
    if column in names:
        return f"c{names.index(column)}"
    lowered = [n.lower() for n in names]
    if column.lower() in lowered:
        return f"c{lowered.index(column.lower())}"
    raise ValueError(f"no column {column!r} in {names}")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names: ``pick(docs, id="doc_id", text="text")``."""
    places = {new: place(df, old) for new, old in columns.items()}
    return positional(df).select(*[F.col(p).alias(new) for new, p in places.items()])


def part_of(column, modulus: int):
    """crc32 of the id as text, modulo: the fold a row belongs to."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def text_bytes(array: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [b or b"" for b in array.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in runs of rows whose text together stays under ``most`` bytes (one row at least)."""
    array = batch.column(column)
    if not len(array):
        return
    ends = np.frombuffer(array.buffers()[1], dtype=np.int64 if pa.types.is_large_string(array.type) else np.int32)
    ends = ends[array.offset:array.offset + len(array) + 1].astype(np.int64)
    start = 0
    while start < len(array):
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(array))
        yield batch.slice(start, stop - start)
        start = stop


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose hashed key is smallest: the same bounded sample on every run."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)
