"""Load ledger: append-only events, current state per run, freshness gate."""

from __future__ import annotations

import os
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LEDGER_SCHEMA = ("ingest_run_id bigint, source string, endpoint string, started_at timestamp, "
                 "finished_at timestamp, rows_ingested bigint, bytes_downloaded bigint, "
                 "status string, notes string, event_no int")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All ledger events; an empty ledger where nothing was written yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER_SCHEMA)


def current_state(events: DataFrame) -> DataFrame:
    """One row per run: its latest event, with the start time of its first."""
    picked = events.groupBy("ingest_run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max_by(F.struct("source", "endpoint", "finished_at", "rows_ingested",
                          "bytes_downloaded", "status", "notes"), "event_no").alias("e"))
    return picked.select("ingest_run_id", "e.source", "e.endpoint", "started_at",
                         "e.finished_at", "e.rows_ingested", "e.bytes_downloaded", "e.status",
                         "e.notes")


def _append(spark: SparkSession, path: str, run_id: int, source: str, endpoint: str,
            event_no: int, status: str | None, rows: int | None, size: int | None,
            notes: str | None) -> None:
    event = spark.createDataFrame(
        [(run_id, source, endpoint, rows, size, status, notes, event_no)],
        "ingest_run_id bigint, source string, endpoint string, rows_ingested bigint, "
        "bytes_downloaded bigint, status string, notes string, event_no int")
    now = F.current_timestamp()
    event.select(
        "ingest_run_id", "source", "endpoint", now.alias("started_at"),
        F.when(F.col("event_no") > 0, now).alias("finished_at"), "rows_ingested",
        "bytes_downloaded", "status", "notes", "event_no").coalesce(1).write.parquet(
        f"{path}/{run_id}-{event_no}")  # a folder of its own: writers never share a temporary folder


def _claim(spark: SparkSession, path: str, run_id: int) -> bool:
    """Whether this caller is the one that gets the id: its marker file can be created once only."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_runs/{run_id}")
    store = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(marker.getParent())
    if store.getScheme() == "file":     # Hadoop's local file system checks first and creates later
        try:
            os.close(os.open(marker.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        store.create(marker, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def start_run(spark: SparkSession, path: str, source: str, endpoint: str) -> int:
    """Open a run and return its id; loaders that start at the same time get different ids."""
    last = read_events(spark, path).agg(F.max("ingest_run_id").alias("m")).first().m
    run_id = (last or 0) + 1
    while not _claim(spark, path, run_id):
        run_id += 1
    _append(spark, path, run_id, source, endpoint, 0, None, None, None, None)
    return run_id


def finish_run(spark: SparkSession, path: str, run_id: int, source: str, endpoint: str,
               status: str, rows: int, size: int, notes: str | None = None) -> None:
    """Close a run with its outcome."""
    _append(spark, path, run_id, source, endpoint, 1, status, rows, size, notes)


def fresh_endpoints(ledger: DataFrame, now, interval: timedelta) -> DataFrame:
    """(source, endpoint) with an ``ok`` run finished within ``interval`` before ``now``."""
    since = now - F.expr(f"INTERVAL {int(interval.total_seconds())} SECONDS")
    return (ledger.filter((F.col("status") == "ok") & (F.col("finished_at") >= since))
            .select("source", "endpoint").distinct())


def stale_requests(requests: DataFrame, ledger: DataFrame, now,
                   interval: timedelta) -> DataFrame:
    """Requested (source, endpoint) rows that need a new load."""
    return requests.join(fresh_endpoints(ledger, now, interval), ["source", "endpoint"],
                         "left_anti")
