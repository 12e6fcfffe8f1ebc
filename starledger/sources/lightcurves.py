"""Light-curve products: choice per sector, flux columns, dataset and manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import sector_number
from starledger.operators.lightcurve import is_finite
from starledger.operators.picks import first_row

PRODUCT = ["tic_id", "sector", "author", "cadence_s"]


def _ranked(column: Column, ranks: dict, other: int) -> Column:
    case = reduce(lambda c, kv: c.when(column == F.lit(kv[0]), kv[1]), ranks.items(),
                  F.when(F.lit(False), other))
    return case.otherwise(other)


def best_products(search: DataFrame) -> DataFrame:
    """One product per (tic_id, sector): best author, then best cadence, then first listed.

    ``search`` (tic_id, idx, author, exptime, sequence_number, mission).  Unknown authors and
    products without a sector drop out.
    """
    cadence = F.rint(F.coalesce(F.col("exptime"), F.lit(specs.MISSING_EXPOSURE_S))).cast("int")
    listed = (search.filter(F.col("author").isin(list(specs.AUTHOR_RANK)))
              .withColumn("sector", sector_number(F.col("sequence_number"), F.col("mission")))
              .filter(F.col("sector").isNotNull()))
    order = [_ranked(F.col("author"), specs.AUTHOR_RANK, len(specs.AUTHOR_RANK)),
             _ranked(cadence, specs.CADENCE_SCORE, specs.OTHER_CADENCE_SCORE), F.col("idx")]
    return first_row(listed, ["tic_id", "sector"], order)


def not_yet_indexed(products: DataFrame, manifest: DataFrame) -> DataFrame:
    """Products without a manifest row; a missing cadence equals a missing cadence."""
    have = manifest.select(*[F.col(c).alias(f"_{c}") for c in PRODUCT])
    same = reduce(lambda a, b: a & b,
                  [F.col(c) == F.col(f"_{c}") for c in PRODUCT[:3]])
    return products.join(have, same & F.col("cadence_s").eqNullSafe(F.col("_cadence_s")),
                         "left_anti")


def choose_flux(photometry: DataFrame) -> DataFrame:
    """(product, time, flux, flux_err, quality, flux_kind) with finite time and flux.

    The flux column is the author's first preferred one *present in the product* (a column a
    product lacks is NULL on all of its rows), else plain ``flux``; the error column follows the
    flux column, else ``flux_err``.  A missing quality counts as 0.
    """
    def has(column: str) -> bool:
        return column in photometry.columns

    named = sorted({c for cols in specs.FLUX_COLUMNS.values() for c in cols if has(c)})
    errors = [f"{c}_err" for c in [*named, "flux"] if has(f"{c}_err")]
    present = photometry.groupBy(*PRODUCT).agg(
        *[F.bool_or(F.col(c).isNotNull()).alias(f"_has_{c}") for c in [*named, *errors]])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PRODUCT])
    present = present.select(*[F.col(c).alias(f"_{c}") for c in PRODUCT],
                             *[f"_has_{c}" for c in [*named, *errors]])
    joined = photometry.join(present, same).drop(*[f"_{c}" for c in PRODUCT])

    def choice(columns: list[str]) -> Column:
        return F.coalesce(*[F.when(F.col(f"_has_{c}"), F.lit(c)) for c in columns if has(c)],
                          F.lit("flux"))

    kind = reduce(lambda c, kv: c.when(F.col("author") == kv[0], choice(kv[1])),
                  specs.FLUX_COLUMNS.items(), F.when(F.lit(False), "flux")
                  ).otherwise(choice(specs.OTHER_FLUX_COLUMNS))
    joined = joined.withColumn("_kind", kind)

    def pick(columns: list[str], suffix: str = "") -> Column:
        null = F.lit(None).cast("double")
        return reduce(lambda c, name: c.when(F.col("_kind") == name, F.col(f"{name}{suffix}")),
                      [c for c in columns if has(f"{c}{suffix}")], F.when(F.lit(False), null))

    own_error = reduce(
        lambda c, e: c.when((F.col("_kind") == e.removesuffix("_err")) & F.col(f"_has_{e}"),
                            F.col(e)), errors, F.when(F.lit(False), F.lit(None).cast("double")))
    flux_err = own_error.otherwise(F.col("flux_err") if has("flux_err") else F.lit(None))
    quality = F.coalesce("quality", F.lit(0)) if has("quality") else F.lit(0)
    rows = joined.select(
        *PRODUCT, "time", pick([*named, "flux"]).alias("flux"),
        flux_err.cast("double").alias("flux_err"), quality.cast("bigint").alias("quality"),
        F.regexp_replace("_kind", "_flux$", "").alias("flux_kind"))
    return rows.filter(is_finite(F.col("time")) & is_finite(F.col("flux")))


def manifest_of(points: DataFrame) -> DataFrame:
    """One row per product: kind, number of points, first and last time."""
    return points.groupBy(*PRODUCT).agg(
        F.max("flux_kind").alias("flux_kind"), F.count(F.lit(1)).alias("n_points"),
        F.min("time").alias("t_start"), F.max("time").alias("t_end"))


def write_points(points: DataFrame, path: str, tic_buckets: int = 256) -> None:
    """Append cadences, partitioned so that one target prunes to one folder.

    A folder per target would mean millions of tiny files at survey scale; a folder per hash
    bucket, rows sorted by target inside, prunes just as well through row-group statistics.
    """
    bucketed = points.withColumn("tic_bucket", tic_bucket(F.col("tic_id"), tic_buckets))
    # Rebalancing gathers a bucket into few files and splits one that is too large for a task.
    (bucketed.hint("rebalance", "tic_bucket")
     .sortWithinPartitions("tic_bucket", "tic_id", "time")
     .write.partitionBy("tic_bucket").mode("append").parquet(path))


def tic_bucket(tic: Column, tic_buckets: int = 256) -> Column:
    return F.pmod(tic, F.lit(tic_buckets)).cast("int")


def read_target(spark: SparkSession, path: str, tic_id: int, tic_buckets: int = 256) -> DataFrame:
    """One target's cadences in time order; the folder and the row groups are pruned."""
    return (spark.read.parquet(path)
            .filter((F.col("tic_bucket") == tic_id % tic_buckets) & (F.col("tic_id") == tic_id))
            .drop("tic_bucket").orderBy("time"))


def fetch_totals(landed: DataFrame) -> DataFrame:
    """One row over download outcomes (tic_id, status, n_points, bytes)."""
    ok = F.col("status") == "ok"
    return landed.agg(
        F.count_distinct("tic_id").alias("n_tics"),
        F.count(F.when(ok, 1)).alias("new_sectors"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
