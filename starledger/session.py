"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.  Skewed joins are split by AQE even where
# the split costs one more shuffle: a key may hold a third of all rows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Rows that carry whole texts or series are large; a batch is bounded by bytes, not by rows, and
    # is held twice by the JVM and twice by its Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "starledger", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests, benches and jobs that are not handed one."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.driver.memory", "12g")
                       .config("spark.ui.enabled", "false")
                       .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def many_tasks(spark: SparkSession) -> int:
    """Tasks for few and small rows that are much work each: their number must not follow from their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 4)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: what the session names, else a local one in tests.

    On a cluster an unset folder is an error: a machine-local folder would not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="starledger-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, for tables a job writes and reads back."""
    path = os.path.join(checkpoint_root(spark), "tables", f"{label}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written so far; returns how many there were.

    For the end of a job, once its results are stored: frames that still read such a table fail
    afterwards.
    """
    removed = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: later stages neither recompute nor lose it.

    Parquet rather than ``checkpoint()``: the readers that follow take few of the columns, and
    the files give the planner the sizes it needs to choose joins.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
