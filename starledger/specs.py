"""Catalog layouts, vocabularies, precedence, thresholds, sites.

Everything in this module is data.  Operators take these tables as arguments, so the same
operator runs on any catalog with another layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CatalogTable:
    """One landed catalog: where it comes from and which headers become typed columns."""

    name: str
    source: str
    endpoint: str
    #: (typed column, CSV header, kind); kind is text, int, num or tic.
    columns: tuple[tuple[str, str, str], ...]


# --- fixed values: column layouts (typed column, header in the file, kind) -------------------
TOI_LIST = CatalogTable("raw_exofop_toi", "exofop", "toi_csv", (
    ("toi", "TOI", "text"),
    ("tic_id", "TIC ID", "int"),
    ("tfopwg_disposition", "TFOPWG Disposition", "text"),
    ("tess_disposition", "TESS Disposition", "text"),
    ("period_days", "Period (days)", "num"),
    ("duration_hr", "Duration (hours)", "num"),
    ("depth_ppm", "Depth (ppm)", "num"),
    ("planet_radius_re", "Planet Radius (R_Earth)", "num"),
    ("epoch_bjd", "Epoch (BJD)", "num"),
    ("teff_k", "Stellar Eff Temp (K)", "num"),
    ("logg", "Stellar log(g) (cm/s^2)", "num"),
    ("rstar_rsun", "Stellar Radius (R_Sun)", "num"),
    ("tmag", "TESS Mag", "num"),
    ("ra_deg", "RA", "num"),
    ("dec_deg", "Dec", "num"),
))
CTOI_LIST = CatalogTable("raw_exofop_ctoi", "exofop", "ctoi_csv", (
    ("ctoi", "CTOI", "text"),
    ("tic_id", "TIC ID", "int"),
    ("promoted_to_toi", "Promoted to TOI", "text"),
    ("user_disposition", "User Disposition", "text"),
    ("period_days", "Period (days)", "num"),
    ("duration_hr", "Duration (hrs)", "num"),
    ("depth_ppm", "Depth ppm", "num"),
    ("planet_radius_re", "Planet Radius (R_Earth)", "num"),
    ("epoch_bjd", "Transit Epoch (BJD)", "num"),
    ("tmag", "TESS Mag", "num"),
    ("ra_deg", "RA", "num"),
    ("dec_deg", "Dec", "num"),
))
ARCHIVE_TOI = CatalogTable("raw_nea_toi", "nea", "tap_toi", (
    ("toi", "toi", "text"),
    ("tid", "tid", "int"),
    ("tfopwg_disp", "tfopwg_disp", "text"),
    ("period_days", "pl_orbper", "num"),
    ("duration_hr", "pl_trandurh", "num"),
    ("depth_ppm", "pl_trandep", "num"),
    ("planet_radius_re", "pl_rade", "num"),
    ("epoch_bjd", "pl_tranmid", "num"),
    ("teff_k", "st_teff", "num"),
    ("logg", "st_logg", "num"),
    ("rstar_rsun", "st_rad", "num"),
    ("tmag", "st_tmag", "num"),
    ("ra_deg", "ra", "num"),
    ("dec_deg", "dec", "num"),
))
KOI_CUMULATIVE = CatalogTable("raw_koi_cumulative", "nea", "tap_cumulative", (
    ("kepid", "kepid", "int"),
    ("kepoi_name", "kepoi_name", "text"),
    ("kepler_name", "kepler_name", "text"),
    ("koi_disposition", "koi_disposition", "text"),
    ("koi_pdisposition", "koi_pdisposition", "text"),
    ("period_days", "koi_period", "num"),
    ("duration_hr", "koi_duration", "num"),
    ("depth_ppm", "koi_depth", "num"),
    ("planet_radius_re", "koi_prad", "num"),
    ("epoch_bjd", "koi_time0bk", "num"),
    ("teff_k", "koi_steff", "num"),
    ("logg", "koi_slogg", "num"),
    ("rstar_rsun", "koi_srad", "num"),
    ("kepmag", "koi_kepmag", "num"),
    ("ra_deg", "ra", "num"),
    ("dec_deg", "dec", "num"),
))
PLANETARY_SYSTEMS = CatalogTable("raw_ps", "nea", "tap_ps", (
    ("pl_name", "pl_name", "text"),
    ("hostname", "hostname", "text"),
    ("tic_id", "tic_id", "tic"),
    ("gaia_id", "gaia_dr3_id", "text"),
    ("hd_name", "hd_name", "text"),
    ("hip_name", "hip_name", "text"),
    ("default_flag", "default_flag", "int"),
    ("soltype", "soltype", "text"),
    ("pl_controv_flag", "pl_controv_flag", "int"),
    ("period_days", "pl_orbper", "num"),
    ("planet_radius_re", "pl_rade", "num"),
    ("depth_pct", "pl_trandep", "num"),
    ("duration_hr", "pl_trandur", "num"),
    ("epoch_bjd", "pl_tranmid", "num"),
    ("teff_k", "st_teff", "num"),
    ("logg", "st_logg", "num"),
    ("rstar_rsun", "st_rad", "num"),
    ("vmag", "sy_vmag", "num"),
    ("tmag", "sy_tmag", "num"),
    ("ra_deg", "ra", "num"),
    ("dec_deg", "dec", "num"),
    ("disc_facility", "disc_facility", "text"),
    ("pl_refname", "pl_refname", "text"),
    ("st_refname", "st_refname", "text"),
    ("pl_pubdate", "pl_pubdate", "text"),
))
COMPOSITE_PLANETS = CatalogTable("raw_pscomppars", "nea", "tap_pscomppars", (
    ("pl_name", "pl_name", "text"),
    ("hostname", "hostname", "text"),
    ("tic_id", "tic_id", "tic"),
    ("gaia_id", "gaia_dr3_id", "text"),
    ("hd_name", "hd_name", "text"),
    ("hip_name", "hip_name", "text"),
    ("period_days", "pl_orbper", "num"),
    ("planet_radius_re", "pl_rade", "num"),
    ("depth_pct", "pl_trandep", "num"),
    ("duration_hr", "pl_trandur", "num"),
    ("epoch_bjd", "pl_tranmid", "num"),
    ("teff_k", "st_teff", "num"),
    ("logg", "st_logg", "num"),
    ("rstar_rsun", "st_rad", "num"),
    ("vmag", "sy_vmag", "num"),
    ("tmag", "sy_tmag", "num"),
    ("ra_deg", "ra", "num"),
    ("dec_deg", "dec", "num"),
    ("disc_facility", "disc_facility", "text"),
))
CATALOG_TABLES = [TOI_LIST, CTOI_LIST, ARCHIVE_TOI, KOI_CUMULATIVE, PLANETARY_SYSTEMS,
                  COMPOSITE_PLANETS]

# --- fixed values: disposition vocabulary (source, word in the source, canonical) ------------
VOCABULARY_BASE = (
    ("exofop_toi", "PC", "CANDIDATE"),
    ("exofop_toi", "APC", "AMBIGUOUS"),
    ("exofop_toi", "CP", "CONFIRMED"),
    ("exofop_toi", "KP", "KNOWN_PLANET"),
    ("exofop_toi", "FP", "FALSE_POSITIVE"),
    ("exofop_toi", "FA", "FALSE_POSITIVE"),
    ("nea_toi", "PC", "CANDIDATE"),
    ("nea_toi", "APC", "AMBIGUOUS"),
    ("nea_toi", "CP", "CONFIRMED"),
    ("nea_toi", "KP", "KNOWN_PLANET"),
    ("nea_toi", "FP", "FALSE_POSITIVE"),
    ("nea_toi", "FA", "FALSE_POSITIVE"),
    ("exofop_ctoi", "PC", "CANDIDATE"),
    ("exofop_ctoi", "EB", "FALSE_POSITIVE"),
    ("exofop_ctoi", "FP", "FALSE_POSITIVE"),
    ("exofop_ctoi", "V", "FALSE_POSITIVE"),
    ("koi", "CONFIRMED", "CONFIRMED"),
    ("koi", "CANDIDATE", "CANDIDATE"),
    ("koi", "FALSE POSITIVE", "FALSE_POSITIVE"),
    ("koi", "NOT DISPOSITIONED", "AMBIGUOUS"),
    ("ps", "Published Confirmed", "CONFIRMED"),
    ("ps", "Published Candidate", "CANDIDATE"),
    ("ps", "TESS Project Candidate", "CANDIDATE"),
    ("ps", "Kepler Project Candidate", "CANDIDATE"),
    ("ps", "CONTROVERSIAL", "AMBIGUOUS"),
    ("pscomppars", "CONFIRMED", "CONFIRMED"),
)
VOCABULARY_AMENDMENT = (
    ("exofop_ctoi", "CP", "CONFIRMED"),
    ("exofop_ctoi", "KP", "KNOWN_PLANET"),
    ("exofop_ctoi", "APC", "AMBIGUOUS"),
)
DISPOSITIONS = ["CONFIRMED", "KNOWN_PLANET", "CANDIDATE", "AMBIGUOUS", "FALSE_POSITIVE"]

# --- fixed values: source precedence per attribute, best first ---------------------------------
PRECEDENCE = {
    "period_days": ["pscomppars", "ps", "koi", "exofop_toi", "nea_toi", "exofop_ctoi"],
    "planet_radius_re": ["pscomppars", "ps", "koi", "exofop_toi", "nea_toi", "exofop_ctoi"],
    "depth_ppm": ["exofop_toi", "nea_toi", "koi", "exofop_ctoi", "ps", "pscomppars"],
    "duration_hr": ["pscomppars", "ps", "koi", "exofop_toi", "nea_toi", "exofop_ctoi"],
    "epoch_bjd": ["pscomppars", "ps", "koi", "exofop_toi", "nea_toi", "exofop_ctoi"],
    "disposition": ["pscomppars", "ps", "koi", "exofop_toi", "nea_toi", "exofop_ctoi"],
    "teff_k": ["pscomppars", "ps", "exofop_toi", "nea_toi", "koi"],
    "logg": ["pscomppars", "ps", "exofop_toi", "nea_toi", "koi"],
    "rstar_rsun": ["pscomppars", "ps", "exofop_toi", "nea_toi", "koi"],
    "vmag": ["pscomppars", "ps"],
    "tmag": ["exofop_toi", "nea_toi", "pscomppars", "ps"],
}
RESOLVED_CANDIDATE_ATTRIBUTES = ["period_days", "planet_radius_re"]
RESOLVED_STAR_ATTRIBUTES = ["teff_k", "logg", "rstar_rsun"]

# --- fixed values: display axes (attribute, level, unit, kind, relative spread that conflicts) --
ATTRIBUTE_AXES = [
    ("disposition", "candidate", None, "disposition", None),
    ("period_days", "candidate", "days", "numeric", 0.01),
    ("planet_radius_re", "candidate", "R_earth", "numeric", 0.10),
    ("depth_ppm", "candidate", "ppm", "numeric", 0.10),
    ("duration_hr", "candidate", "hr", "numeric", 0.10),
    ("epoch_bjd", "candidate", "BJD", "numeric", None),
    ("teff_k", "star", "K", "numeric", 0.05),
    ("rstar_rsun", "star", "R_sun", "numeric", 0.10),
    ("logg", "star", "log10(cm/s^2)", "numeric", 0.10),
    ("parallax_mas", "star", "mas", "numeric", 0.10),
    ("tmag", "star", "mag", "numeric", 0.05),
    ("vmag", "star", "mag", "numeric", 0.05),
]
UNKNOWN_AXIS_RANK = 99
UNKNOWN_AXIS_THRESHOLD = 0.10

# --- fixed values: the browsable conflict lists -------------------------------------------------
CONFLICT_LISTS = {
    "radius": {"attribute": "planet_radius_re", "level": "candidate", "unit": "R_earth",
               "threshold": "0.10"},
    "teff": {"attribute": "teff_k", "level": "star", "unit": "K", "threshold": "0.05"},
}
REPORT_TOLERANCE = {"period_days": 0.01, "planet_radius_re": 0.10, "teff_k": 0.05,
                    "rstar_rsun": 0.10}
REPORT_EXAMPLES = 12

# --- fixed values: text that counts as a number -------------------------------------------------
NUMBER_PATTERN = r"^-?[0-9]+\.?[0-9]*([eE][-+]?[0-9]+)?$"
REPORT_NUMBER_PATTERN = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"

# --- fixed values: matching ---------------------------------------------------------------------
SKY_TOLERANCE_ARCSEC = 2.0
PERIOD_TOLERANCE = 0.01

# --- fixed values: light-curve products ---------------------------------------------------------
AUTHOR_RANK = {"SPOC": 0, "TESS-SPOC": 1, "QLP": 2}
CADENCE_SCORE = {120: 0, 200: 1, 600: 2, 1800: 3, 20: 4}
OTHER_CADENCE_SCORE = 5
MISSING_EXPOSURE_S = 9999.0
FLUX_COLUMNS = {
    "SPOC": ["pdcsap_flux", "sap_flux"],
    "TESS-SPOC": ["pdcsap_flux", "sap_flux"],
    "QLP": ["kspsap_flux", "sap_flux", "det_flux"],
}
OTHER_FLUX_COLUMNS = ["sap_flux"]

# --- fixed values: target selection --------------------------------------------------------------
DEEP_PPM = 3000.0
LONG_PERIOD_DAYS = 10.0
DISCOVERY_PERIOD_DAYS = 30.0
PER_STRATUM = 5
SINGLE_TRANSIT_PICKS = 8
LONG_PERIOD_PICKS = 10
VETTING_QUOTA = {"gold_planet": 4, "gold_fp": 3, "discovery": 3}

# --- fixed values: light-curve processing --------------------------------------------------------
PERIOD_MIN_DAYS = 0.6
PERIOD_MAX_DAYS = 50.0
DETREND_WINDOW_DAYS = 0.75
BIN_MINUTES = 10
SEGMENT_GAP_DAYS = 10.0
TRIAL_DURATIONS_DAYS = [0.04, 0.06, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5]
MIN_GOOD_CADENCES = 50
BJD_MINUS_BTJD = 2457000.0
SNR_MIN = 7.0
SHALLOW_PPM = 500
HARMONICS = [1.0, 2.0, 0.5, 3.0, 1.0 / 3.0, 1.5, 2.0 / 3.0]

# --- fixed values: false-positive vetting --------------------------------------------------------
ODD_EVEN_SIGMA = 3.0
SECONDARY_SNR = 5.0
DEEP_ECLIPSE_PPM = 100000.0
VETTING_TOOL = "heuristic_vetting"
VETTING_NOTE = "heuristic light-curve vetting, not a calibrated false-positive probability"

# --- fixed values: observatories (key, name, latitude, longitude east, elevation km) -------------
SITES = [
    ("kitt_peak", "Kitt Peak, Arizona (TFOP)", 31.9583, -111.5967, 2.096),
    ("paranal", "Cerro Paranal / VLT, Chile", -24.6275, -70.4044, 2.635),
    ("mauna_kea", "Maunakea, Hawaii", 19.8207, -155.4681, 4.205),
    ("la_palma", "Roque de los Muchachos, La Palma", 28.7606, -17.8814, 2.396),
    ("siding_spring", "Siding Spring, Australia (TFOP)", -31.2733, 149.0644, 1.165),
    ("sutherland", "SAAO Sutherland, South Africa", -32.3790, 20.8110, 1.798),
    ("generic_north", "Generic mid-northern site (35N)", 35.0, 0.0, 0.5),
]
DEFAULT_SITE = "kitt_peak"
CUSTOM_SITE_ELEVATION_KM = 0.5

# --- fixed values: benchmark host stars -----------------------------------------------------------
FAMOUS_HOSTS = [
    "TRAPPIST-1", "TOI-700", "TOI-270", "LHS 475", "LTT 1445 A", "GJ 1132", "GJ 1214", "GJ 357",
    "GJ 436", "GJ 486", "GJ 667 C", "GJ 9827", "GJ 3470", "GJ 3929", "GJ 367", "GJ 806",
    "GJ 1252", "K2-18", "K2-141", "55 Cnc", "HD 209458", "HD 189733", "WASP-12", "WASP-121",
    "WASP-39", "WASP-127", "L 98-59", "TOI-561", "TOI-1338", "TOI-849", "HAT-P-11", "HD 3167",
    "K2-138", "AU Mic", "LP 890-9",
]
CONFLICT_HOST_LIMIT = 24

# --- fixed values: orbit density -------------------------------------------------------------------
LEO_CEILING_KM = 2000.0
ALTITUDE_BIN_KM = 50
INCLINATION_BIN_DEG = 5
SHELL_KM = 200
SHELL_DISPLAY_CEILING_KM = 1400
DENSITY_LEVELS = 6
TOP_OWNERS = 8
CURRENT_ELEMENT_SOURCE = "celestrak_gp"

# --- fixed values: wording of recorded reasons and flags ---------------------------------------------
MISS_LONG_PERIOD = "P=%.1f d > 50 d periodic-search cap (blind spot; needs single-event)"
MISS_SHALLOW = "shallow (%.0f ppm); best BLS/TLS SNR=%.1f < 7"
MISS_NO_SIGNAL = "no signal above SNR 7 (best=%.1f); detrending/short baseline?"
MISS_OTHER_SIGNAL = "strongest signal did not match catalog P (best SNR=%.1f); wrong-alias/blend?"
FLAG_ODD_EVEN = "odd/even %.1fsigma"
FLAG_SECONDARY = "secondary SNR %.1f"
FLAG_DEEP = "deep %.1f%%"
FLAG_NONE = "no strong FP tell"
NOTE_NO_FILES = "no light-curve files"
NOTE_ALL_MASKED = "all sectors empty after quality mask"
NOTE_SHORT_SEGMENT = "best segment too short (%d pts, %.1f d)"
NOTE_SINGLE_DIP = "single dip localised; no period inferred"


def vocabulary(spark: SparkSession, *seeds: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """(source, source_value, canonical, seed_order): every seed file, later files marked later."""
    seeds = seeds or (VOCABULARY_BASE, VOCABULARY_AMENDMENT)
    rows = [(*row, order) for order, seed in enumerate(seeds) for row in seed]
    return spark.createDataFrame(
        rows, "source string, source_value string, canonical string, seed_order int")


def precedence(spark: SparkSession, table: dict[str, list[str]] | None = None) -> DataFrame:
    """(attribute, source, rank): 0 is the most trusted source of the attribute."""
    rows = [(attribute, source, rank) for attribute, order in (table or PRECEDENCE).items()
            for rank, source in enumerate(order)]
    return spark.createDataFrame(rows, "attribute string, source string, rank int")


def attribute_axes(spark: SparkSession) -> DataFrame:
    """(attribute, level, unit, kind, threshold, axis_rank)."""
    rows = [(*axis, rank) for rank, axis in enumerate(ATTRIBUTE_AXES)]
    return spark.createDataFrame(
        rows, "attribute string, level string, unit string, kind string, threshold double, "
              "axis_rank int")


def sites(spark: SparkSession) -> DataFrame:
    """(site, site_name, lat_deg, lon_deg, elev_km)."""
    return spark.createDataFrame(
        SITES, "site string, site_name string, lat_deg double, lon_deg double, elev_km double")
