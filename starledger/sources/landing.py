"""Snapshot landing: append typed rows under their run id, keep the ledger honest."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starledger import specs
from starledger.sources import ledger as ledger_io
from starledger.sources.catalog_csv import read_catalog

# Row ids: the run in the high bits, the row's place in the scan below it.
_RUN_SHIFT = 42
FRESH_FOR = timedelta(hours=24)


def land(rows: DataFrame, path: str, run_id: int) -> int:
    """Append one snapshot, partitioned by run; returns the number of rows written.

    The count is observed while writing, not in a second pass.
    """
    seen = Observation("landed")
    place = F.monotonically_increasing_id()  # fixed for good by the write
    stamped = rows.withColumns({
        "raw_id": F.lit(run_id).cast("bigint") * F.lit(1 << _RUN_SHIFT) + place,
        "ingest_run_id": F.lit(run_id).cast("bigint"),
        "loaded_at": F.current_timestamp()})
    (stamped.observe(seen, F.count(F.lit(1)).alias("n"))
     .write.partitionBy("ingest_run_id").mode("append").parquet(path))
    return seen.get["n"]


def _file_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n


def load_catalog(spark: SparkSession, table: specs.CatalogTable, file: str, raw_root: str,
                 ledger_path: str, fresh_for: timedelta | None = FRESH_FOR) -> int:
    """Land one catalog file with its ledger rows; 0 where a fresh load makes it unnecessary."""
    if fresh_for is not None:
        state = ledger_io.current_state(ledger_io.read_events(spark, ledger_path))
        fresh = ledger_io.fresh_endpoints(state, F.current_timestamp(), fresh_for)
        if not fresh.filter((F.col("source") == table.source)
                            & (F.col("endpoint") == table.endpoint)).isEmpty():
            run_id = ledger_io.start_run(spark, ledger_path, table.source, table.endpoint)
            ledger_io.finish_run(spark, ledger_path, run_id, table.source, table.endpoint,
                                 "skipped_fresh", 0, 0)
            return 0
    run_id = ledger_io.start_run(spark, ledger_path, table.source, table.endpoint)
    try:
        size = _file_bytes(spark, file)
        n = land(read_catalog(spark, file, table), os.path.join(raw_root, table.name), run_id)
    except Exception as error:
        ledger_io.finish_run(spark, ledger_path, run_id, table.source, table.endpoint, "error",
                             0, 0, str(error))
        raise
    ledger_io.finish_run(spark, ledger_path, run_id, table.source, table.endpoint, "ok", n, size)
    return n


def load_all(spark: SparkSession, files: dict[str, str], raw_root: str, ledger_path: str,
             fresh_for: timedelta | None = FRESH_FOR) -> dict[str, int | str]:
    """Land every catalog in ``files`` (table name to path); one bad source never stops the rest.

    Returns rows landed, or the error text, per table.
    """
    outcome: dict[str, int | str] = {}
    for table in specs.CATALOG_TABLES:
        if table.name not in files:
            continue
        try:
            outcome[table.name] = load_catalog(spark, table, files[table.name], raw_root,
                                               ledger_path, fresh_for)
        except Exception as error:  # the ledger holds the details
            outcome[table.name] = f"error: {error}"
    return outcome
