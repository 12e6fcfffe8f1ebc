"""Files dropped into a folder are landed once each, in batches, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.sources import ledger as ledger_io
from starledger.sources.catalog_csv import read_files
from starledger.sources.landing import land
from starledger.specs import CatalogTable


def land_new_files(spark: SparkSession, table: CatalogTable, inbox: str, out: str,
                   checkpoint: str, ledger_path: str, files_per_batch: int = 1000) -> None:
    """Land every file that has not been landed yet, ``files_per_batch`` at a time, then stop.

    The stream carries the names of new files only (its checkpoint is the resume set, so a restart
    repeats no finished batch).  Each batch of files goes the way of a batch load: error guard,
    headers of its own files, ``extra``, ``raw_id`` and ledger rows.
    """
    def land_batch(batch: DataFrame, _: int) -> None:
        names = [row.file for row in batch.select("file").distinct().collect()]  # files_per_batch at most
        if not names:
            return
        run_id = ledger_io.start_run(spark, ledger_path, table.source, table.endpoint)
        try:
            size = batch.agg(F.sum("size")).first()[0]
            n = land(read_files(spark, names, table), out, run_id)
        except Exception as error:
            ledger_io.finish_run(spark, ledger_path, run_id, table.source, table.endpoint, "error",
                                 0, 0, str(error))
            raise
        ledger_io.finish_run(spark, ledger_path, run_id, table.source, table.endpoint, "ok", n, size)

    # Length and name of each file; the contents are not read here.
    listed = (spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(inbox)
              .select(F.col("path").alias("file"), F.col("length").alias("size")))
    (listed.writeStream.foreachBatch(land_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
