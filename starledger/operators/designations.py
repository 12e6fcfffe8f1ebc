"""Designations of a star become candidates: collapse, cluster by period, name, link."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import canonical_name
from starledger.operators.blocks import block_of, gap_segments
from starledger.operators.ids import with_dense_id
from starledger.operators.links import CANDIDATE_SEED, PERIOD_MATCH, links

DESIGNATION = ["star_id", "id_type", "id_value"]


def collapse(observations: DataFrame) -> DataFrame:
    """One row per (star, id_type, id_value): asserting systems, first period, first planet name.

    "First" follows (source_order, raw_id).  Each is a conditional ``min_by``, which combines
    map-side; the set of asserting systems is as small as the number of systems.
    """
    first = "(source_order, raw_id)"
    return observations.groupBy(*DESIGNATION).agg(
        F.expr(f"min_by(period, {first}) FILTER (WHERE period IS NOT NULL)").alias("period"),
        F.expr(f"min_by(planet_name, {first}) FILTER (WHERE planet_name <> '')")
        .alias("planet_name"),
        F.array_sort(F.collect_set("source")).alias("sources"))


class _Leaders:
    """Seeds of the chain being read: sorted by period, numbered in the order they were founded."""

    def __init__(self, tol: float):
        self.tol = tol
        self.by_period: list[tuple[float, int]] = []
        self.names: list[tuple[str, str]] = []

    def place(self, id_type: str, id_value: str, period: float) -> tuple:
        """(seed_type, seed_value, rule, competing) of the next designation."""
        low = bisect.bisect_left(self.by_period, (period * (1.0 - 2 * self.tol), -1))
        high = bisect.bisect_right(self.by_period, (period * (1.0 + 2 * self.tol), math.inf))
        hits = sorted(n for p, n in self.by_period[low:high]
                      if abs(p - period) / max(p, period) < self.tol)
        if len(hits) == 1:
            return (*self.names[hits[0]], PERIOD_MATCH, None)
        competing = [":".join(self.names[n]) for n in hits] or None
        bisect.insort(self.by_period, (period, len(self.names)))
        self.names.append((id_type, id_value))
        return id_type, id_value, CANDIDATE_SEED, competing


_CLUSTERED = ("star_id bigint, id_type string, id_value string, period double, "
              "planet_name string, sources array<string>, seed_type string, seed_value string, "
              "rule string, competing array<string>")


def _lead_batches(tol: float):
    """Read chains in order; only the open chain's seeds are kept between batches.

    A row whose neighbours belong to other chains founds its own cluster; only rows in company
    are walked one by one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, leaders = None, _Leaders(tol)
        for batch in batches:
            if batch.empty:
                continue
            stars, parts = batch["star_id"].to_numpy(), batch["_segment"].to_numpy()
            same = (stars[1:] == stars[:-1]) & (parts[1:] == parts[:-1])
            company = np.zeros(len(batch), dtype=bool)
            company[1:] |= same
            company[:-1] |= same
            company[[0, -1]] = True  # their chain may go on in the next batch
            seed_type, seed_value = batch["id_type"].tolist(), batch["id_value"].tolist()
            rule = [CANDIDATE_SEED] * len(batch)
            competing: list = [None] * len(batch)
            periods = batch["period"].to_numpy()
            for i in np.flatnonzero(company):
                if (stars[i], parts[i]) != chain:
                    chain, leaders = (stars[i], parts[i]), _Leaders(tol)
                seed_type[i], seed_value[i], rule[i], competing[i] = leaders.place(
                    seed_type[i], seed_value[i], float(periods[i]))
            yield batch.drop(columns="_segment").assign(
                seed_type=seed_type, seed_value=seed_value, rule=rule, competing=competing)

    return run


def cluster(designations: DataFrame, tol: float = specs.PERIOD_TOLERANCE) -> DataFrame:
    """Leader clustering of each star's designations by period.

    In (id_type, id_value) order a designation joins the one cluster whose *seed* period lies
    within ``tol``; with none it seeds a cluster, with several it seeds one and names the seeds
    it could not choose between.  Adds seed_type, seed_value, rule, competing.

    Only designations linked by a chain of nearby periods can influence each other, so a star is
    first cut where its sorted log-periods leave a gap wider than the tolerance.  Chains, not
    stars, are what one task has to read in order, and it keeps no more than a chain's seeds.
    """
    spark = designations.sparkSession
    gap = -math.log1p(-tol) * (1.0 + 1e-9)
    rows = designations.withColumn("period", F.col("period").cast("double"))
    periodic = F.coalesce(F.col("period") > 0, F.lit(False))
    alone = rows.filter(~periodic).withColumns({
        "seed_type": F.col("id_type"), "seed_value": F.col("id_value"),
        "rule": F.lit(CANDIDATE_SEED), "competing": F.lit(None).cast("array<string>")})
    placed = rows.filter(periodic).withColumn("_log", F.log("period"))
    parts = gap_segments(placed, ["star_id"], "_log", gap).select(
        "star_id", "_block", F.col("segment").alias("_segment"))
    chained = (placed.withColumn("_block", block_of(F.col("_log"), gap))
               .join(parts, ["star_id", "_block"]).drop("_block", "_log"))
    # An explicit count keeps the ordered walk parallel however few bytes the rows have.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    led = (chained.repartition(tasks, "star_id", "_segment")
           .sortWithinPartitions("star_id", "_segment", "id_type", "id_value")
           .select("star_id", "id_type", "id_value", "period", "planet_name", "sources", "_segment")
           .mapInPandas(_lead_batches(tol), _CLUSTERED))
    return alone.unionByName(led)


def ambiguous(clustered: DataFrame) -> DataFrame:
    """Designations whose period matched several clusters: flagged, not merged."""
    return clustered.filter(F.col("competing").isNotNull())


def candidates(clustered: DataFrame) -> DataFrame:
    """One row per cluster: dense candidate_id in (star, seed) order and the canonical name.

    Within a cluster the last designation in (id_type, id_value) order names the planet.
    """
    planet = "CASE WHEN planet_name <> '' THEN planet_name WHEN id_type = 'name' THEN id_value END"
    named = clustered.groupBy("star_id", "seed_type", "seed_value").agg(
        F.expr(f"max_by({planet}, (id_type, id_value)) FILTER (WHERE ({planet}) IS NOT NULL)")
        .alias("planet"),
        *[F.expr(f"max(id_value) FILTER (WHERE id_type = '{kind}')").alias(kind)
          for kind in ("toi", "koi", "ctoi")])
    fallback = F.concat(F.lit("star "), F.col("star_id").cast("string"))
    labelled = named.select(
        "star_id", "seed_type", "seed_value",
        canonical_name(F.col("planet"), F.col("toi"), F.col("koi"), F.col("ctoi"), fallback)
        .alias("canonical_name"))
    return with_dense_id(labelled, "candidate_id", ["star_id", "seed_type", "seed_value"])


def candidate_links(clustered: DataFrame, candidate_rows: DataFrame) -> DataFrame:
    """Links of every candidate: each designation per asserting system, plus planet names.

    A KOI that names its planet also links that name; where the name is a designation of its own
    the later one in (id_type, id_value) order decides the rule.
    """
    owned = clustered.join(
        candidate_rows.select("candidate_id", "star_id", "seed_type", "seed_value"),
        ["star_id", "seed_type", "seed_value"])
    direct = owned.select("candidate_id", "id_type", "id_value",
                          F.explode("sources").alias("source"), "rule",
                          F.struct("id_type", "id_value").alias("_order"))
    by_planet = owned.filter((F.col("planet_name") != "") & (F.col("id_type") != "name")).select(
        "candidate_id", F.lit("name").alias("id_type"), F.col("planet_name").alias("id_value"),
        F.lit("nea").alias("source"), "rule", F.struct("id_type", "id_value").alias("_order"))
    decided = direct.unionByName(by_planet).groupBy(
        "candidate_id", "id_type", "id_value", "source").agg(
        F.max_by("rule", "_order").alias("rule"))
    return links(decided, "candidate", F.col("rule"))
