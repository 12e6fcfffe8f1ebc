"""Time scales and Earth frames as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid (km) and the Unix epoch as a Julian date: public constants.
EARTH_RADIUS_KM = 6378.137
FLATTENING = 1.0 / 298.257223563
ECCENTRICITY_SQ = FLATTENING * (2.0 - FLATTENING)
UNIX_EPOCH_JD = 2440587.5
J2000_JD = 2451545.0


def iso_utc(ts: Column, zone: str = "Z") -> Column:
    """ISO-8601 text in UTC; microseconds only where there are any."""
    fraction = F.when(F.pmod(F.unix_micros(ts), F.lit(1000000)) != 0,
                      F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit(zone))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; no zone means UTC (the session zone), bad text NULL."""
    return F.regexp_replace(F.trim(text), "Z$", "+00:00").try_cast("timestamp")


def julian_date(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(86400000000.0) + F.lit(UNIX_EPOCH_JD)


def sidereal_angle(jd: Column) -> Column:
    """Greenwich mean sidereal time in radians (UT1 taken as UTC)."""
    d = jd - F.lit(J2000_JD)
    c = d / F.lit(36525.0)
    degrees = (F.lit(280.46061837) + F.lit(360.98564736629) * d
               + F.lit(0.000387933) * c * c - (c * c * c) / F.lit(38710000.0))
    return F.radians(F.pmod(degrees, F.lit(360.0)))


def observer_vectors(lat_deg: Column, lon_deg: Column, elev_km: Column) -> dict[str, Column]:
    """Earth-fixed position (km) and geodetic up vector of a site on the WGS84 ellipsoid."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    sin_lat, cos_lat = F.sin(lat), F.cos(lat)
    normal = F.lit(EARTH_RADIUS_KM) / F.sqrt(F.lit(1.0) - F.lit(ECCENTRICITY_SQ) * sin_lat * sin_lat)
    return {
        "obs_x": (normal + elev_km) * cos_lat * F.cos(lon),
        "obs_y": (normal + elev_km) * cos_lat * F.sin(lon),
        "obs_z": (normal * F.lit(1.0 - ECCENTRICITY_SQ) + elev_km) * sin_lat,
        "up_x": cos_lat * F.cos(lon),
        "up_y": cos_lat * F.sin(lon),
        "up_z": sin_lat,
    }


def unit_vector(ra_deg: Column, dec_deg: Column) -> tuple[Column, Column, Column]:
    ra, dec = F.radians(ra_deg), F.radians(dec_deg)
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def to_earth_fixed(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Rotate inertial x, y about the pole by the sidereal angle."""
    return (F.cos(angle) * x + F.sin(angle) * y, F.cos(angle) * y - F.sin(angle) * x)


def arc_degrees(cosine_or_sine: Column, inverse=F.asin) -> Column:
    """Inverse sine or cosine in degrees with the argument clipped to [-1, 1]."""
    return F.degrees(inverse(F.greatest(F.least(cosine_or_sine, F.lit(1.0)), F.lit(-1.0))))
