"""Numeric columns: relative differences, strata, harmonics, phase folding, period grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starledger import specs


def rel_diff(a: Column, b: Column) -> Column:
    """|a-b| / max(a,b); NULL where either is missing or not positive."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))


def rounded(value: Column, places: int) -> Column:
    """``F.round`` of a double, ties away from zero; decimals are worked out only where a tie may be near or digits run out.

    n / 10^places is the double closest to that decimal, as :func:`F.round` has it, for whole n up to 2^53.
    """
    scaled = F.abs(value) * F.lit(10.0 ** places)
    whole = F.floor(scaled + F.lit(0.5))
    plain = (scaled < F.lit(1e9)) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > F.lit(1e-5))
    near = F.when(value < 0, -whole).otherwise(whole) / F.lit(10.0 ** places)
    return F.when(plain, near).otherwise(F.round(value, places))


def periods_match(a: Column, b: Column, tol: float = specs.PERIOD_TOLERANCE) -> Column:
    """Strictly closer than ``tol``; a missing period never matches."""
    return F.coalesce(rel_diff(a, b) < F.lit(tol), F.lit(False))


def percent_to_ppm(percent: Column) -> Column:
    return percent * F.lit(10000)


def stratum(depth_ppm: Column, period_days: Column) -> Column:
    """Depth x period stratum of a transit."""
    deep = depth_ppm >= specs.DEEP_PPM
    short = period_days < specs.LONG_PERIOD_DAYS
    return (F.when(deep & short, "deep_short")
            .when(deep & (period_days >= specs.LONG_PERIOD_DAYS), "deep_long")
            .when(short, "shallow_short")
            .otherwise("shallow_long"))


def harmonic_of(found: Column, known: Column, tol: float = specs.PERIOD_TOLERANCE) -> Column:
    """First ratio found/known, in fixed order, that matches within ``tol`` inclusive; else NULL."""
    ratios = F.array(*[F.lit(h) for h in specs.HARMONICS])
    hits = F.filter(ratios, lambda h: F.abs(found - known * h) / (known * h) <= F.lit(tol))
    return F.when((found > 0) & (known > 0), F.get(hits, F.lit(0)))


def epoch_phase_offset(found_btjd: Column, known_bjd: Column, period: Column) -> Column:
    """Phase distance (0 to 0.5) between a found epoch and the catalog epoch."""
    delta = F.pmod(found_btjd - (known_bjd - F.lit(specs.BJD_MINUS_BTJD)), period) / period
    return F.when(period > 0, F.least(delta, F.lit(1.0) - delta))


def centred_phase(t: Column, epoch: Column, period: Column) -> Column:
    """Time from the nearest transit centre, in (-P/2, P/2]."""
    half = F.lit(0.5) * period
    return F.pmod(t - epoch + half, period) - half


def outside_transit(t: Column, period: Column, epoch: Column, duration_hr: Column) -> Column:
    """True for cadences to keep once the signal's transits (plus 10 %) are masked."""
    half = duration_hr / F.lit(24.0) / F.lit(2.0) * F.lit(1.1)
    return F.when(period > 0, F.abs(centred_phase(t, epoch, period)) > half).otherwise(True)


def grid_size(baseline_days: Column, period_min: Column, period_max: Column,
              grid_duration: float = 0.05, oversample: float = 2.0,
              min_periods: int = 3000) -> Column:
    """Number of log-spaced trial periods for a baseline: enough that a transit cannot slip between two."""
    step = F.lit(grid_duration) / F.greatest(baseline_days, F.lit(1.0)) / F.lit(oversample)
    wanted = F.ceil(F.log(period_max / period_min) / step)
    return F.greatest(wanted, F.lit(min_periods)).cast("int")


def log_period(i: Column, n: Column, period_min: Column, period_max: Column) -> Column:
    """The i-th of n log-spaced periods, ends included."""
    return period_min * F.exp(i * F.log(period_max / period_min) / (n - F.lit(1)))


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation of two sky positions by the haversine form."""
    d_dec = F.sin((F.radians(dec2) - F.radians(dec1)) / 2)
    d_ra = F.sin((F.radians(ra2) - F.radians(ra1)) / 2)
    hav = d_dec * d_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * d_ra * d_ra
    return F.degrees(F.lit(2.0) * F.asin(F.least(F.sqrt(hav), F.lit(1.0))))


def chord(angle_deg: float) -> float:
    """Length of the unit-sphere chord that spans an angle."""
    return 2.0 * math.sin(math.radians(angle_deg) / 2.0)


def density_level(count: Column, peak: Column, levels: int = specs.DENSITY_LEVELS) -> Column:
    """Log-scaled colour level 0..levels-1 of a bin count; -1 for an empty bin."""
    share = F.log(count + F.lit(1)) / F.log(peak + F.lit(1))
    level = F.ceil(share * F.lit(levels)) - F.lit(1)
    return (F.when(count <= 0, F.lit(-1))
            .otherwise(F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1))).cast("int"))
