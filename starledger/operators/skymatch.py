"""Sky cross-match: nearest star to each probe inside a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.frames import unit_vector
from starledger.functions.numeric import separation_deg
from starledger.operators.cells import near_pairs

_ARCSEC = 3600.0


def _vectors(df: DataFrame, ra: str, dec: str, prefix: str) -> DataFrame:
    x, y, z = unit_vector(F.col(ra), F.col(dec))
    return df.withColumns({f"{prefix}x": x, f"{prefix}y": y, f"{prefix}z": z})


def nearest_star(stars: DataFrame, probes: DataFrame, probe_id: str, star_id: str = "star_id",
                 ra: str = "ra_deg", dec: str = "dec_deg",
                 tol_arcsec: float = specs.SKY_TOLERANCE_ARCSEC) -> DataFrame:
    """(probe_id, star_id, sep_arcsec): nearest star of each probe that has one inside ``tol``.

    Stars at one position are reduced to the lowest id first: a pile of copies would otherwise
    pair every copy with every probe.  Equal separations go to the lowest star id.
    """
    placed = stars.filter(F.col(ra).isNotNull() & F.col(dec).isNotNull())
    sites = placed.groupBy(F.col(ra).cast("double").alias("_sra"),
                           F.col(dec).cast("double").alias("_sdec")).agg(
        F.min(star_id).alias(star_id))
    aimed = probes.filter(F.col(ra).isNotNull() & F.col(dec).isNotNull()).select(
        probe_id, F.col(ra).cast("double").alias("_pra"), F.col(dec).cast("double").alias("_pdec"))
    pairs = near_pairs(_vectors(sites, "_sra", "_sdec", "_s"),
                       _vectors(aimed, "_pra", "_pdec", "_p"),
                       ("_sx", "_sy", "_sz"), ("_px", "_py", "_pz"), tol_arcsec / _ARCSEC)
    sep = separation_deg(F.col("_pra"), F.col("_pdec"), F.col("_sra"), F.col("_sdec")) * _ARCSEC
    close = pairs.select(probe_id, star_id, sep.alias("sep_arcsec")).filter(
        F.col("sep_arcsec") < tol_arcsec)
    best = F.min(F.struct("sep_arcsec", star_id)).alias("_best")
    return close.groupBy(probe_id).agg(best).select(
        probe_id, F.col(f"_best.{star_id}").alias(star_id), "_best.sep_arcsec")


def match_score(sep: Column, tol_arcsec: float = specs.SKY_TOLERANCE_ARCSEC) -> Column:
    return F.round(F.lit(1.0) - sep / F.lit(tol_arcsec), 3)


def match_confidence(sep: Column, tol_arcsec: float = specs.SKY_TOLERANCE_ARCSEC) -> Column:
    return F.round(F.greatest(F.lit(0.80), F.lit(1.0) - sep / F.lit(tol_arcsec)), 2)


def split_probes(probes: DataFrame, matches: DataFrame, probe_id: str,
                 ) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) probes; an unmatched probe mints a new star."""
    return (probes.join(matches, probe_id), probes.join(matches, probe_id, "left_anti"))
