"""Target selection: stratified gold cohorts, discovery picks, stable target ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.numeric import stratum
from starledger.operators.ids import with_dense_id
from starledger.operators.links import union_all
from starledger.operators.picks import first_row, latest_snapshot, top_k

BRIGHTEST = ["tmag", "tic_id", "toi"]


def target_pool(candidates: DataFrame, stars: DataFrame, crosswalk: DataFrame, raw_toi: DataFrame,
                ledger: DataFrame | None = None, snapshot: str = "first") -> DataFrame:
    """One row per candidate with a TIC and a TOI, with that TOI's catalog ephemeris.

    ``first`` keeps the oldest landed row over all snapshots, ``latest`` only looks at the newest
    closed snapshot.
    """
    if snapshot == "latest":
        raw_toi = latest_snapshot(raw_toi, ledger)
    names = crosswalk.filter((F.col("id_type") == "toi") & F.col("candidate_id").isNotNull()
                             ).select("candidate_id", F.col("id_value").alias("toi")).distinct()
    hosts = stars.filter(F.col("tic_id").isNotNull()).select(
        "star_id", F.col("tic_id").alias("host_tic"))
    ephemeris = raw_toi.select("toi", "raw_id", F.col("tfopwg_disposition").alias("tfopwg_disp"),
                               "period_days", "epoch_bjd", "depth_ppm", "duration_hr", "tmag")
    joined = (candidates.select("candidate_id", "star_id",
                                F.col("disposition").alias("canonical_disp"))
              .join(hosts, "star_id").drop("star_id").withColumnRenamed("host_tic", "tic_id")
              .join(names, "candidate_id").join(ephemeris, "toi"))
    return first_row(joined, ["candidate_id"], [F.col("raw_id")])


def eligible_gold(pool: DataFrame, dispositions: list[str]) -> DataFrame:
    return pool.filter(F.col("tfopwg_disp").isin(dispositions) & (F.col("period_days") > 0)
                       & F.col("epoch_bjd").isNotNull() & F.col("depth_ppm").isNotNull()
                       & F.col("tmag").isNotNull())


def gold_cohort(pool: DataFrame, dispositions: list[str],
                per_stratum: int = specs.PER_STRATUM) -> DataFrame:
    """Brightest few of every depth x period stratum."""
    strata = eligible_gold(pool, dispositions).withColumn(
        "stratum", stratum(F.col("depth_ppm"), F.col("period_days")))
    return top_k(strata, ["stratum"], [F.col(c) for c in BRIGHTEST], per_stratum)


def _discovery(pool: DataFrame, dispositions: list[str]) -> DataFrame:
    return pool.filter(F.col("tfopwg_disp").isin(dispositions) & F.col("epoch_bjd").isNotNull()
                       & F.col("tmag").isNotNull())


def single_transits(pool: DataFrame, dispositions: list[str], used_tics: DataFrame,
                    k: int = specs.SINGLE_TRANSIT_PICKS) -> DataFrame:
    rows = _discovery(pool, dispositions).filter(
        F.col("period_days").isNull() | (F.col("period_days") == 0))
    return (rows.join(used_tics, "tic_id", "left_anti").orderBy(*BRIGHTEST).limit(k)
            .withColumn("stratum", F.lit("single_transit")))


def long_periods(pool: DataFrame, dispositions: list[str], used_tics: DataFrame,
                 k: int = specs.LONG_PERIOD_PICKS) -> DataFrame:
    rows = _discovery(pool, dispositions).filter(
        F.col("period_days") >= specs.DISCOVERY_PERIOD_DAYS)
    return (rows.join(used_tics, "tic_id", "left_anti").orderBy(*BRIGHTEST).limit(k)
            .withColumn("stratum", F.lit("long_period")))


def select_targets(pool: DataFrame) -> DataFrame:
    """Gold planets, gold false positives, then discovery picks on TICs not used before.

    The chosen sets are a few dozen rows, fixed by the quotas.
    """
    planets = gold_cohort(pool, ["CP", "KP"]).withColumn("cohort", F.lit("gold_planet"))
    false_positives = gold_cohort(pool, ["FP", "FA"]).withColumn("cohort", F.lit("gold_fp"))
    gold = planets.unionByName(false_positives)
    gold_tics = gold.select("tic_id").distinct()
    singles = single_transits(pool, ["PC", "APC"], gold_tics)
    used = union_all([gold_tics, singles.select("tic_id")]).distinct()
    longs = long_periods(pool, ["PC", "APC"], used)
    discovery = singles.unionByName(longs).withColumn("cohort", F.lit("discovery"))
    rule = F.concat(
        F.lit("TFOPWG "), F.col("tfopwg_disp"), F.lit("; "),
        F.when(F.col("cohort") != "discovery", F.concat(F.lit("stratum "), F.col("stratum")))
        .when(F.col("stratum") == "single_transit", "single-transit (period unknown)")
        .otherwise("P>=30d"), F.lit("; brightest-first"))
    return gold.unionByName(discovery).withColumn("select_rule", rule)


def upsert_targets(previous: DataFrame, selection: DataFrame) -> DataFrame:
    """The selection with target ids: kept where the candidate had one, new ones after the highest.

    Candidates no longer selected drop out.
    """
    known = previous.select("candidate_id", "target_id")
    kept = selection.join(known, "candidate_id")
    new = selection.join(known, "candidate_id", "left_anti")
    highest = previous.agg(F.coalesce(F.max("target_id"), F.lit(0)).alias("offset"))
    return kept.unionByName(with_dense_id(new, "target_id", ["candidate_id"], offset=highest))


def cohort_summary(selection: DataFrame) -> DataFrame:
    return selection.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tic_id").alias("n_tic"))


def vetting_subset(targets: DataFrame, light_curves: DataFrame,
                   quota: dict[str, int] | None = None) -> DataFrame:
    """Brightest few targets of each cohort that have a light curve."""
    quota = quota or specs.VETTING_QUOTA
    observed = targets.join(light_curves.select("tic_id").distinct(), "tic_id", "left_semi")
    order = [F.col("tmag").asc_nulls_last(), F.col("tic_id"), F.col("target_id")]
    ranked = top_k(observed.filter(F.col("cohort").isin(list(quota))), ["cohort"], order,
                   max(quota.values()), rank="_place")
    allowed = F.create_map(*[F.lit(v) for pair in quota.items() for v in pair])
    return ranked.filter(F.col("_place") <= allowed[F.col("cohort")]).drop("_place")


def work_list(targets: DataFrame, tic_id: int | None = None, cohort: str | None = None,
              limit: int | None = None) -> DataFrame:
    """Targets to process, ordered; each filter is optional."""
    rows = targets
    if tic_id is not None:
        rows = rows.filter(F.col("tic_id") == tic_id)
    if cohort is not None:
        rows = rows.filter(F.col("cohort") == cohort)
    rows = rows.orderBy("cohort", "tic_id", "toi")
    return rows if limit is None else rows.limit(limit)


def download_list(targets: DataFrame) -> DataFrame:
    return targets.select("tic_id").distinct().orderBy("tic_id")


def host_targets(stars: DataFrame, candidates: DataFrame) -> DataFrame:
    """One sky point per placed host: its best-known candidate and whether any is disputed.

    Best known means lowest disposition rank, then name.
    """
    ranks = F.create_map(*[F.lit(v) for i, d in enumerate(specs.DISPOSITIONS) for v in (d, i)])
    word = F.coalesce("disposition", F.lit("UNKNOWN"))
    rows = candidates.select(
        "star_id", "candidate_id", F.col("canonical_name").alias("candidate"),
        word.alias("disposition"))
    order = F.struct(F.coalesce(ranks[F.col("disposition")], F.lit(9)), "candidate",
                     "candidate_id")
    rolled = rows.groupBy("star_id").agg(
        F.min_by(F.struct("candidate_id", "candidate", "disposition"), order).alias("_rep"),
        F.bool_or(F.col("disposition") == "AMBIGUOUS").alias("has_conflict"),
        F.count(F.lit(1)).alias("n_candidates"))
    placed = stars.filter(F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()).select(
        "star_id", F.col("canonical_name").alias("host"), "tic_id",
        F.round(F.col("ra_deg").cast("double"), 6).alias("ra_deg"),
        F.round(F.col("dec_deg").cast("double"), 6).alias("dec_deg"))
    return placed.join(rolled, "star_id").select(
        "star_id", "host", "tic_id", "ra_deg", "dec_deg", "_rep.*", "has_conflict",
        "n_candidates")


def host_candidates(stars: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of every placed host with the host's total: the roll-up as rows, not arrays."""
    placed = stars.filter(F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()).select(
        "star_id", F.col("canonical_name").alias("host"), "tic_id")
    sizes = candidates.groupBy("star_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    return (placed.join(sizes, "star_id")
            .join(candidates.select("star_id", "candidate_id",
                                    F.col("canonical_name").alias("candidate"), "disposition"),
                  "star_id"))


def curated_hosts(hosts: DataFrame, famous: list[str] | None = None,
                  conflict_limit: int = specs.CONFLICT_HOST_LIMIT) -> DataFrame:
    """Named benchmark hosts plus the first few disputed hosts by name."""
    famous = specs.FAMOUS_HOSTS if famous is None else famous
    named = hosts.filter(F.col("host").isin(famous)).withColumn("category", F.lit("famous"))
    disputed = (hosts.filter(F.col("has_conflict") & ~F.col("host").isin(famous))
                .orderBy("host", "star_id").limit(conflict_limit)
                .withColumn("category", F.lit("conflict")))
    return named.unionByName(disputed)
