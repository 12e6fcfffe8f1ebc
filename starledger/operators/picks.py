"""Pick one row per group, or the first k, without sorting whole groups.

``min_by``/``max_by`` over a struct combine map-side, so a key that holds a third of all rows
costs one partial row per task instead of one task that sorts the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _picked(df: DataFrame, keys: list[str], order: list[Column], largest: bool) -> DataFrame:
    """One row per key as the largest or smallest struct of ``order`` and all other columns.

    A single struct is carried: what decides and what is kept.  A column that has no order is kept beside it.
    """
    rest = _rest(df, keys)
    sortable = [c for c in rest if not _is_map(df, c)]
    decides = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                       *[F.col(c).alias(f"_c{rest.index(c)}") for c in sortable])
    if len(sortable) == len(rest):
        row = (F.max if largest else F.min)(decides).alias("_row")
        return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(rest)])
    row = (F.max_by if largest else F.min_by)(F.struct(*rest), decides).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the smallest by ``order``, ties settled by all remaining columns.

    Order expressions compare NULL first; wrap them (``c.isNull()``, ``desc_key``) for other rules.
    """
    return _picked(df, keys, order, largest=False)


def last_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the largest by ``order``, ties settled by all remaining columns."""
    return _picked(df, keys, order, largest=True)


def _is_map(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank: str | None = None) -> DataFrame:
    """The first k rows per key.

    The filter on ``row_number`` lets the planner keep k rows per key in every map task before
    the shuffle, so a hot key ships k rows per task, not its whole group.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest_snapshot(raw: DataFrame, ledger: DataFrame, run: str = "ingest_run_id") -> DataFrame:
    """Rows of the newest landing whose load closed ``ok`` (an empty frame when none did).

    The newest run id is a scalar subquery; compared with the partition column it prunes every
    other snapshot from the scan.
    """
    ok = ledger.filter(F.col("status") == "ok").select(F.col(run).alias("_run"))
    runs = raw.groupBy(F.col(run).alias("_run")).agg(F.lit(1).alias("_one"))
    newest = runs.join(ok, "_run", "left_semi").agg(F.max("_run"))
    return raw.filter(F.col(run) == newest.scalar())


def last_per_endpoint(ledger: DataFrame, by: str = "started_at",
                      sources: list[str] | None = None) -> DataFrame:
    """Newest ledger row per (source, endpoint), NULL times last; optionally some sources only."""
    rows = ledger if sources is None else ledger.filter(F.col("source").isin(sources))
    return last_row(rows, ["source", "endpoint"], [F.col(by).isNotNull(), F.col(by)])


def star_per_tic(rows: DataFrame) -> DataFrame:
    """One row per tic, preferring rows that carry a host name, then ra, then dec."""
    return first_row(rows, ["tic"], [F.col("hostname").isNull(), F.col("ra").isNull(),
                                     F.col("dec").isNull()])


def row_per_hostname(rows: DataFrame) -> DataFrame:
    return first_row(rows, ["hostname"], [F.col("ra").isNull(), F.col("dec").isNull()])


def row_per_kepid(rows: DataFrame) -> DataFrame:
    return first_row(rows, ["kepid"], [F.col("kepler_name").isNull()])


def row_per_planet(rows: DataFrame) -> DataFrame:
    """One publication per planet: the default one (largest flag, NULL last), then a known period."""
    return first_row(rows, ["pl_name"],
                     [F.col("default_flag").isNull(), -F.col("default_flag"),
                      F.col("period_days").isNull()])


def latest_elements(elements: DataFrame, source: str | None = None) -> DataFrame:
    """Newest element set per satellite number, over the whole history or within one source."""
    rows = elements if source is None else elements.filter(F.col("source") == source)
    return last_row(rows, ["norad_id"], [F.col("epoch")])


def latest_run_per_target(runs: DataFrame) -> DataFrame:
    return last_row(runs, ["target_id"], [F.col("pipeline_run_id")])


def leading_box_detection(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """Best-ranked box-search detection of each target's newest run that has one."""
    found = detections.filter(F.col("method") == "bls").join(
        runs.select("pipeline_run_id", "target_id"), "pipeline_run_id")
    return first_row(found, ["target_id"], [-F.col("pipeline_run_id"), F.col("rank")])
