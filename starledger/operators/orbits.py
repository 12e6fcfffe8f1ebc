"""Orbit catalog: density bins, shells, launches, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.numeric import density_level
from starledger.operators.picks import latest_elements


def mean_altitude():
    return (F.col("apogee_km") + F.col("perigee_km")) / 2.0


def low_orbit_bins(elements: DataFrame) -> DataFrame:
    """Element rows that can be binned: orbit known and mean altitude below the LEO ceiling."""
    return elements.filter(
        F.col("inclination").isNotNull() & F.col("perigee_km").isNotNull()
        & F.col("apogee_km").isNotNull() & (mean_altitude() < specs.LEO_CEILING_KM))


def density_bins(elements: DataFrame, source: str = specs.CURRENT_ELEMENT_SOURCE) -> DataFrame:
    """(alt_bin_km, inc_bin_deg, object_count) of the current element sets of one source."""
    def floored(value, width):
        return (F.floor(value / F.lit(float(width))) * F.lit(width)).cast("bigint")

    current = low_orbit_bins(latest_elements(elements, source))
    return current.groupBy(
        floored(mean_altitude(), specs.ALTITUDE_BIN_KM).alias("alt_bin_km"),
        floored(F.col("inclination"), specs.INCLINATION_BIN_DEG).alias("inc_bin_deg")).agg(
        F.count(F.lit(1)).alias("object_count"))


def shells(bins: DataFrame) -> DataFrame:
    """(alt_lo_km, alt_hi_km, objects) in 200 km shells."""
    low = (F.floor(F.col("alt_bin_km") / specs.SHELL_KM) * specs.SHELL_KM).cast("bigint")
    return bins.groupBy(low.alias("alt_lo_km")).agg(
        F.sum("object_count").cast("bigint").alias("objects")).select(
        "alt_lo_km", (F.col("alt_lo_km") + specs.SHELL_KM).alias("alt_hi_km"), "objects")


def density_peak(bins: DataFrame) -> DataFrame:
    """One row: total objects and the fullest bin, the lowest one on a tie."""
    return bins.agg(
        F.sum("object_count").cast("bigint").alias("leo_objects"),
        F.max_by(F.struct("alt_bin_km", "inc_bin_deg", "object_count"),
                 F.struct("object_count", -F.col("alt_bin_km"), -F.col("inc_bin_deg")))
        .alias("p")).select("leo_objects", F.col("p.alt_bin_km").alias("peak_alt_km"),
                            F.col("p.inc_bin_deg").alias("peak_inc_deg"),
                            F.col("p.object_count").alias("peak_count"))


def density_levels(bins: DataFrame) -> DataFrame:
    """Bins with their log-scaled level.  The window spans the bins, at most a few thousand."""
    peak = F.max("object_count").over(Window.partitionBy())
    return bins.withColumn("level", density_level(F.col("object_count"), peak))


def shell_bars(shell_rows: DataFrame) -> DataFrame:
    """Shells below the display ceiling, each in percent of the largest of all shells."""
    peak = F.greatest(F.max("objects").over(Window.partitionBy()), F.lit(1))
    return (shell_rows.withColumn("width_pct", F.lit(100.0) * F.col("objects") / peak)
            .filter(F.col("alt_lo_km") < specs.SHELL_DISPLAY_CEILING_KM))


def catalog_summary(satellites: DataFrame, elements: DataFrame, as_of: str,
                    source: str = specs.CURRENT_ELEMENT_SOURCE) -> DataFrame:
    """One row: objects, objects with current elements, payload launches in 365 and 30 days."""
    payload = F.col("object_type") == "PAYLOAD"
    day = F.lit(as_of).cast("date")

    def since(days):
        return F.count(F.when(payload & (F.col("launch_date") > F.date_sub(day, days)), 1))

    objects = satellites.agg(F.count(F.lit(1)).alias("catalog_objects"),
                             since(365).alias("payloads_launched_1y"),
                             since(30).alias("payloads_launched_30d"))
    tracked = (elements.filter(F.col("source") == source).select("norad_id").distinct()
               .agg(F.count("norad_id").alias("tracked_with_elements")))
    return objects.select("*", tracked.select("tracked_with_elements").scalar()
                          .alias("tracked_with_elements"))


def current_owners(ownership: DataFrame, operators: DataFrame) -> DataFrame:
    """(satellite_id, operator): owners whose ownership has not ended."""
    open_ended = ownership.filter((F.col("role") == "owner") & F.col("valid_to").isNull())
    names = operators.select("operator_id", F.col("canonical_name").alias("operator"))
    return open_ended.join(names, "operator_id").select("satellite_id", "operator")


def top_owners(satellites: DataFrame, owners: DataFrame, k: int = specs.TOP_OWNERS) -> DataFrame:
    """(operator, payloads): owners with the most payloads."""
    payloads = satellites.filter(F.col("object_type") == "PAYLOAD").select("satellite_id")
    return (payloads.join(owners, "satellite_id").groupBy("operator")
            .agg(F.count(F.lit(1)).alias("payloads"))
            .orderBy(F.col("payloads").desc(), "operator").limit(k))


def owner_share(top: DataFrame, peak: DataFrame, name_like: str) -> DataFrame:
    """One row: the first listed owner whose name contains ``name_like``, in % of LEO objects."""
    named = top.filter(F.col("operator").ilike(f"%{name_like}%")).orderBy(
        F.col("payloads").desc(), "operator").limit(1)
    total = peak.select("leo_objects").scalar()
    share = F.floor(F.lit(100.0) * F.col("payloads") / total + 0.5).cast("bigint")
    return named.select("operator", "payloads", share.alias("share_pct"))


def leo_payloads(satellites: DataFrame, elements: DataFrame,
                 ceiling_km: float = specs.LEO_CEILING_KM) -> DataFrame:
    """Payloads with their newest element set, mean altitude below the ceiling."""
    payloads = satellites.filter(F.col("norad_id").isNotNull()
                                 & (F.col("object_type") == "PAYLOAD"))
    names = payloads.select("satellite_id", "norad_id", "canonical_name")
    return (names.join(latest_elements(elements), "norad_id")
            .filter(mean_altitude() < ceiling_km)
            .withColumn("alt_km", F.round(mean_altitude(), 1)))
