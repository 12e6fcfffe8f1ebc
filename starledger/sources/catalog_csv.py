"""Catalog CSV scan: header-driven typed projection plus the row as it came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.functions.text import CELL_DECIMAL, coerce_cell
from starledger.specs import CatalogTable

_KIND_TYPE = {"text": "string", "num": CELL_DECIMAL, "int": "bigint", "tic": "bigint"}


class SourceError(ValueError):
    """The source answered with an error message instead of a table."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def file_heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, head, refused): the first line with text of every file, and whether it is an error report.

    One pass over all files at once; each task keeps one line per file it reads.  A table starts
    with its header, so a file that starts with ``ERROR`` or with markup is no table.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"),
                                         F.trim("value").alias("line")).filter("line <> ''")
    heads = lines.groupBy("file").agg(F.min_by("line", "place").alias("head"))
    start = F.upper("head")
    return heads.withColumn("refused", start.startswith("ERROR") | start.startswith("<?XML")
                            | start.contains("<VOTABLE"))


def refuse_error_payload(spark: SparkSession, path: str | list[str]) -> None:
    """Raise if any file starts like an error report; it must not count as (part of) a catalog."""
    bad = file_heads(spark, path).filter("refused").orderBy("file").first()
    if bad is not None:
        raise SourceError(f"source returned a non-CSV error payload: {bad.head!r} in {bad.file}")


def typed_projection(raw: DataFrame, table: CatalogTable) -> DataFrame:
    """All-text rows to the table's typed columns plus ``extra``, the whole row verbatim.

    Headers match whatever their case and surrounding blanks; a column whose header is missing
    is NULL.
    """
    headers = {name.strip().lower(): name for name in raw.columns}
    typed = []
    for column, header, kind in table.columns:
        found = headers.get(header.lower())
        cell = (coerce_cell(kind, F.col(quoted(found))) if found is not None
                else F.lit(None))
        typed.append(cell.cast(_KIND_TYPE[kind]).alias(column))
    extra = F.map_from_arrays(
        F.array(*[F.lit(name) for name in raw.columns]),
        F.array(*[F.coalesce(F.col(quoted(name)), F.lit("")) for name in raw.columns]))
    return raw.select(*typed, extra.alias("extra"))


def read_catalog(spark: SparkSession, path: str, table: CatalogTable,
                 multiline: bool = False) -> DataFrame:
    """One catalog file (or folder of files with one header) as typed rows plus ``extra``.

    Types come from the layout, never from inference.  ``multiline`` is for files with line
    breaks inside quoted cells; such files cannot be split between tasks.
    """
    refuse_error_payload(spark, path)
    return typed_projection(_csv(spark, path, multiline), table)


def _csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).csv(path))


def read_files(spark: SparkSession, files: list[str], table: CatalogTable) -> DataFrame:
    """Several catalog files, each with headers of its own, as typed rows plus ``extra``."""
    refuse_error_payload(spark, files)
    # A row per distinct header; of the files only their names, which the reader lists on the driver anyway.
    headed = file_heads(spark, files).groupBy("head").agg(F.array_sort(F.collect_list("file")).alias("same"))
    frames = [typed_projection(_csv(spark, row.same), table)
              for row in headed.orderBy(F.col("same")[0]).collect()]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows


def narrow(df: DataFrame, table: CatalogTable) -> DataFrame:
    """Only the table's own columns: the scan below reads nothing else."""
    return df.select(*[c for c, _, _ in table.columns if c in df.columns])
