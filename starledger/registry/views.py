"""The driver's tables seen as catalogs, claims, light curves and orbits.

Each view is one SELECT that both Spark and DuckDB run, so a query and its oracle start from the
same rows.  Every view covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass(frozen=True)
class Dialect:
    """The few spellings on which the two engines differ."""

    name: str

    def div(self, a: str, b: str | int) -> str:
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def micros(self, ts: str) -> str:
        return f"unix_micros({ts})" if self.name == "spark" else f"epoch_us({ts})"

    def json_int(self, text: str, key: str) -> str:
        path = f"get_json_object({text}, '$.{key}')" if self.name == "spark" else (
            f"json_extract_string({text}, '$.{key}')")
        return f"CAST({path} AS BIGINT)"

    def add_seconds(self, ts: str, seconds: str) -> str:
        if self.name == "spark":
            return f"timestamp_micros(unix_micros({ts}) + CAST({seconds} AS BIGINT) * 1000000)"
        return f"make_timestamp(epoch_us({ts}) + CAST({seconds} AS BIGINT) * 1000000)"

    def steps(self, n: int) -> str:
        """0 .. n as rows."""
        return f"explode(sequence(0, {n}))" if self.name == "spark" else f"unnest(range(0, {n + 1}))"

    def dealt(self, table: str) -> str:
        """The table over many tasks: rows that each make hundreds come in one small file, which one task would read."""
        return f"(SELECT /*+ REPARTITION({DEALT}) */ * FROM {table})" if self.name == "spark" else table

    def add_days(self, day: str, n: str) -> str:
        if self.name == "spark":
            return f"date_add(DATE '{day}', CAST({n} AS INT))"
        return f"(DATE '{day}' + CAST({n} AS INT))"


DEALT = 48       # tasks over the parts and suppliers whose rows are multiplied
SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")
VIEWS: dict[str, Callable[[Dialect], str]] = {}


def view(fn: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    VIEWS[fn.__name__] = fn
    return fn


class Tables:
    """Lazy access to tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self._load(name)
        return self._seen[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            # The files carry zone-less timestamps; the operators work on instants (UTC).
            zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
            return df.withColumns({c: df[c].cast("timestamp") for c in zoneless})
        text = VIEWS[name](SPARK)
        used = [t for t in [*TABLES, *VIEWS] if "{" + t + "}" in text]
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


def ctes(*names: str) -> str:
    """``name AS (...)`` items for DuckDB, dependencies first, ready to follow WITH."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        text = VIEWS[name](DUCKDB)
        for other in VIEWS:
            if "{" + other + "}" in text:
                add(other)
        for other in [*TABLES, *VIEWS]:
            text = text.replace("{" + other + "}", other)
        done[name] = f"{name} AS ({text})"

    for name in names:
        add(name)
    return ", ".join(done.values())


def with_views(*names: str) -> str:
    return "WITH " + ctes(*names) + " "


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"

# --- claims about parts -----------------------------------------------------------------------------


@view
def claims(d: Dialect) -> str:
    v = f"(1000 + {CENTS} % 300)"
    plain = f"CAST({d.div(v, 100)} AS STRING) || '.' || lpad(CAST({v} % 100 AS STRING), 2, '0')"
    word = f"{CENTS} % 6"
    return f"""
    SELECT CASE WHEN l_linenumber <= 5 THEN l_partkey END AS candidate_id,
           CASE WHEN l_linenumber > 5 THEN {d.div('l_partkey', 4)} END AS star_id,
           CAST(l_partkey AS STRING) AS source_key,
           CASE l_linenumber WHEN 1 THEN 'period_days' WHEN 2 THEN 'planet_radius_re'
                WHEN 3 THEN 'depth_ppm' WHEN 4 THEN 'disposition' WHEN 5 THEN 'epoch_bjd'
                WHEN 6 THEN 'teff_k' ELSE 'tmag' END AS attribute,
           CASE WHEN l_linenumber = 4 THEN
                CASE WHEN l_suppkey % 6 = 0 THEN 'CONFIRMED'
                     WHEN l_suppkey % 6 = 1 THEN CASE {word} WHEN 0 THEN 'Published Confirmed'
                          WHEN 1 THEN 'Published Candidate' WHEN 2 THEN 'CONTROVERSIAL'
                          WHEN 3 THEN 'TESS Project Candidate' WHEN 4 THEN 'published confirmed'
                          ELSE 'Retracted' END
                     WHEN l_suppkey % 6 = 2 THEN CASE {word} WHEN 0 THEN 'CONFIRMED'
                          WHEN 1 THEN 'CANDIDATE' WHEN 2 THEN 'FALSE POSITIVE'
                          WHEN 3 THEN 'NOT DISPOSITIONED' ELSE 'CANDIDATE' END
                     WHEN l_suppkey % 6 = 5 THEN CASE {word} WHEN 0 THEN 'PC' WHEN 1 THEN 'EB'
                          WHEN 2 THEN 'KP' WHEN 3 THEN 'V' WHEN 4 THEN 'pc' ELSE 'APC' END
                     ELSE CASE {word} WHEN 0 THEN 'PC' WHEN 1 THEN 'APC' WHEN 2 THEN 'CP'
                          WHEN 3 THEN 'KP' WHEN 4 THEN 'FP' ELSE 'FA' END END
                WHEN l_orderkey % 97 = 0 THEN 'n/a'
                WHEN l_orderkey % 89 = 0 THEN CAST({d.div(v, 100)} AS STRING) || '.'
                WHEN l_orderkey % 83 = 0 THEN CAST({v} AS STRING) || 'e-2'
                ELSE {plain} END AS value,
           CAST(NULL AS STRING) AS unit,
           CASE l_suppkey % 6 WHEN 0 THEN 'pscomppars' WHEN 1 THEN 'ps' WHEN 2 THEN 'koi'
                WHEN 3 THEN 'exofop_toi' WHEN 4 THEN 'nea_toi' ELSE 'exofop_ctoi' END AS source,
           CASE l_returnflag WHEN 'A' THEN '<a href="x">Ref ' || CAST(l_suppkey AS STRING) || ' </a>'
                WHEN 'N' THEN '' END AS source_ref,
           l_shipdate AS observed_at, l_orderkey AS ingest_run_id,
           l_orderkey * 8 + l_linenumber AS raw_id
    FROM {{lineitem}}"""


@view
def vocab(d: Dialect) -> str:
    from starledger import specs

    values = ", ".join(str(row) for row in (*specs.VOCABULARY_BASE, *specs.VOCABULARY_AMENDMENT))
    return f"SELECT * FROM (VALUES {values}) AS v(source, source_value, canonical)"


@view
def ranks(d: Dialect) -> str:
    from starledger import specs

    values = ", ".join(f"('{a}', '{s}', {i})" for a, order in specs.PRECEDENCE.items()
                       for i, s in enumerate(order))
    return f"SELECT * FROM (VALUES {values}) AS v(attribute, source, rank)"


@view
def axes(d: Dialect) -> str:
    from starledger import specs

    def text(x):
        return "NULL" if x is None else f"'{x}'"

    values = ", ".join(
        f"({text(a)}, {text(lv)}, {text(u)}, {text(k)}, "
        f"{'CAST(NULL AS DOUBLE)' if t is None else f'CAST({t} AS DOUBLE)'}, {i})"
        for i, (a, lv, u, k, t) in enumerate(specs.ATTRIBUTE_AXES))
    return (f"SELECT * FROM (VALUES {values}) "
            "AS v(attribute, level, unit, kind, threshold, axis_rank)")


@view
def stars(d: Dialect) -> str:
    """One star for every four parts."""
    return f"""
    SELECT sid AS star_id, CASE WHEN sid % 5 <> 0 THEN sid * 7 END AS tic_id,
           'Host ' || CAST(sid AS STRING) AS canonical_name,
           CASE WHEN sid % 11 <> 0 THEN (sid * 137.50776405003785e0) % 360e0 END AS ra_deg,
           degrees(asin(2e0 * ((sid * 0.7548776662466927e0) % 1e0) - 1e0)) AS dec_deg
    FROM (SELECT DISTINCT {d.div("p_partkey", 4)} AS sid FROM {{part}})"""


@view
def candidates(d: Dialect) -> str:
    return f"""
    SELECT p_partkey AS candidate_id, {d.div('p_partkey', 4)} AS star_id,
           p_name || ' ' || CAST(p_partkey AS STRING) AS canonical_name,
           CASE p_size % 6 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'KNOWN_PLANET'
                WHEN 2 THEN 'CANDIDATE' WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'FALSE_POSITIVE' END
           AS disposition
    FROM {{part}}"""


@view
def identifiers(d: Dialect) -> str:
    none = "CAST(NULL AS BIGINT)"
    return f"""
    SELECT star_id, {none} AS candidate_id, 'tic' AS id_type, CAST(tic_id AS STRING) AS id_value,
           'nea' AS source, 1e0 AS confidence FROM {{stars}} WHERE tic_id IS NOT NULL
    UNION ALL SELECT star_id, {none}, 'name', canonical_name, 'nea', 1e0 FROM {{stars}}
    UNION ALL SELECT {none}, p_partkey, 'toi', CAST(p_partkey AS STRING) || '.01', 'exofop', 1e0
              FROM {{part}}
    UNION ALL SELECT {none}, p_partkey, 'toi', CAST(p_partkey AS STRING) || '.01', 'nea', 0.9e0
              FROM {{part}} WHERE p_partkey % 2 = 0
    UNION ALL SELECT {none}, p_partkey, 'name', p_name || ' b', 'nea', 1e0 FROM {{part}}"""


@view
def audit(d: Dialect) -> str:
    return """
    SELECT CASE WHEN star_id IS NOT NULL THEN 'star' ELSE 'candidate' END AS entity_type,
           coalesce(star_id, candidate_id) AS surviving_id,
           CASE id_type WHEN 'tic' THEN 'tic_exact' WHEN 'toi' THEN 'candidate_seed'
                ELSE 'catalog_xref' END AS rule_fired
    FROM {identifiers}"""


# --- load ledger from events ------------------------------------------------------------------------


@view
def ledger(d: Dialect) -> str:
    return f"""
    SELECT event_id AS ingest_run_id,
           CASE event_type WHEN 'click' THEN 'exofop' WHEN 'view' THEN 'nea' ELSE event_type END
           AS source,
           'ep' || CAST(user_id % 7 AS STRING) AS endpoint, ts AS started_at,
           CASE WHEN event_id % 13 <> 0 THEN {d.add_seconds('ts', 'event_id % 5000')} END
           AS finished_at,
           {d.json_int('props', 'k')} AS rows_ingested,
           CAST(round(value * 100) AS BIGINT) AS bytes_downloaded,
           CASE WHEN value < 10 THEN 'error' WHEN value < 20 THEN 'skipped_fresh' ELSE 'ok' END
           AS status
    FROM {{events}}"""


@view
def landed_rows(d: Dialect) -> str:
    return """
    SELECT l_orderkey AS ingest_run_id, l_orderkey * 8 + l_linenumber AS raw_id, l_partkey, l_quantity
    FROM {lineitem}"""


# --- text cells ---------------------------------------------------------------------------------------


@view
def cells(d: Dialect) -> str:
    key = "CAST(p_partkey AS STRING)"
    return f"""
    SELECT p_partkey,
           CASE p_partkey % 12 WHEN 0 THEN 'TIC ' || {key} WHEN 1 THEN ' ' || {key} || ' '
                WHEN 2 THEN '' WHEN 3 THEN {key} || '.7' WHEN 4 THEN 'not a tic'
                WHEN 5 THEN '-' || {key} || '.25' WHEN 6 THEN {key} || 'd' WHEN 7 THEN '1e3'
                WHEN 8 THEN 'tic' || {key} WHEN 9 THEN '   ' WHEN 10 THEN '.5' END AS cell
    FROM {{part}}"""


@view
def citations(d: Dialect) -> str:
    return """
    SELECT page_id, html AS ref FROM {pages}
    UNION ALL SELECT -1 - l_orderkey * 8 - l_linenumber,
           CASE l_returnflag WHEN 'A' THEN '<a refstr="R" href="u">Smith et al. ' ||
                CAST(l_suppkey AS STRING) || ' </a>' WHEN 'N' THEN '' ELSE '<br> <b></b>' END
    FROM {lineitem}"""


# --- light curves from events ---------------------------------------------------------------------------


@view
def points(d: Dialect) -> str:
    t = f"(({d.micros('ts')} - 1704067200000000) / 86400000000e0)"
    return f"""
    SELECT user_id AS tic_id, CAST(floor({t} / 7e0) AS BIGINT) AS sector,
           CASE user_id % 3 WHEN 0 THEN 'SPOC' WHEN 1 THEN 'TESS-SPOC' ELSE 'QLP' END AS author,
           CAST(CASE WHEN user_id % 5 = 0 THEN NULL ELSE 120 END AS INT) AS cadence_s,
           {t} AS time, 1e0 + value / 10000e0 AS flux, event_id,
           CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS quality
    FROM {{events}}"""


@view
def series(d: Dialect) -> str:
    return "SELECT tic_id, sector, time, flux, event_id FROM {points} WHERE quality = 0"


@view
def monitor(d: Dialect) -> str:
    """Series as dense as the operators' own widths ask for: the events of five groups of users in order
    of arrival, a cadence of 1,296 seconds, a pause of a day after every 700, a slow wave."""
    k = "CAST(place AS DOUBLE)"
    t = f"({k} * 0.015e0 + floor({k} / 700e0))"
    return f"""
    SELECT tic_id, CAST(floor({t} / 7e0) AS BIGINT) AS sector, CAST(1296 AS INT) AS cadence_s, {t} AS time,
           1e0 + value / 10000e0 + 0.02e0 * sin({k} * 0.02e0) AS flux, event_id,
           CAST(CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS quality
    FROM (SELECT user_id % 5 AS tic_id, value, event_id,
                 row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) - 1 AS place FROM {{events}})"""


@view
def photometry(d: Dialect) -> str:
    nan = "CAST('NaN' AS DOUBLE)"
    return f"""
    SELECT tic_id, sector, author, cadence_s, time,
           CASE WHEN author <> 'QLP' AND tic_id % 4 <> 0 THEN
                CASE WHEN event_id % 17 = 0 THEN {nan} ELSE flux END END AS pdcsap_flux,
           CASE WHEN tic_id % 8 <> 0 THEN flux + 1e0 END AS sap_flux,
           CASE WHEN author = 'QLP' AND tic_id % 7 <> 0 THEN flux + 2e0 END AS kspsap_flux,
           flux + 3e0 AS flux,
           CASE WHEN author <> 'QLP' AND tic_id % 4 <> 0 THEN 0.001e0 END AS pdcsap_flux_err,
           0.002e0 AS flux_err,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE quality END AS quality
    FROM {{points}}"""


@view
def products(d: Dialect) -> str:
    return """
    SELECT l_partkey AS tic_id, l_orderkey * 8 + l_linenumber AS idx,
           CASE l_suppkey % 5 WHEN 0 THEN 'SPOC' WHEN 1 THEN 'TESS-SPOC' WHEN 2 THEN 'QLP'
                WHEN 3 THEN 'SPOC' ELSE 'CDIPS' END AS author,
           CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 120e0 WHEN 1 THEN 20e0 WHEN 2 THEN 200e0
                WHEN 3 THEN 600e0 WHEN 4 THEN 1800e0 END AS exptime,
           CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS STRING) END AS sequence_number,
           CASE WHEN l_linenumber = 7 THEN 'Kepler' ELSE 'TESS Sector 0' ||
                CAST(l_linenumber AS STRING) END AS mission
    FROM {lineitem}"""


# --- targets, runs and detections ------------------------------------------------------------------------


@view
def pool(d: Dialect) -> str:
    return f"""
    SELECT p_partkey AS candidate_id, {d.div('p_partkey', 2)} AS tic_id,
           CAST(p_partkey AS STRING) || '.01' AS toi,
           CASE p_size % 6 WHEN 0 THEN 'CP' WHEN 1 THEN 'KP' WHEN 2 THEN 'FP' WHEN 3 THEN 'FA'
                WHEN 4 THEN 'PC' ELSE 'APC' END AS tfopwg_disp,
           CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN 0e0
                ELSE (p_partkey % 45) + 0.5e0 END AS period_days,
           CASE WHEN p_partkey % 29 <> 0 THEN 2458000e0 + p_partkey % 1000 END AS epoch_bjd,
           p_size * 120e0 AS depth_ppm, 1e0 + p_size % 5 AS duration_hr,
           CASE WHEN p_size <> 50 THEN p_retailprice / 100e0 END AS tmag
    FROM {{part}}"""


@view
def targets(d: Dialect) -> str:
    return """
    SELECT p_partkey AS target_id, p_partkey * 3 AS tic_id,
           CAST(p_partkey AS STRING) || '.01' AS toi,
           CASE p_type WHEN 'STANDARD' THEN 'gold_planet' WHEN 'ECONOMY' THEN 'gold_planet'
                WHEN 'MEDIUM' THEN 'gold_fp' WHEN 'PROMO' THEN 'gold_fp' ELSE 'discovery' END
           AS cohort,
           p_brand AS stratum, CASE WHEN p_size % 2 = 0 THEN 'CP' ELSE 'KP' END AS tfopwg_disp,
           CASE WHEN p_partkey % 19 <> 0 THEN p_size * 1.5e0 END AS known_period_days,
           2458000.25e0 + p_partkey % 100 AS known_epoch_bjd,
           (p_partkey % 40) * 50e0 AS known_depth_ppm,
           CASE WHEN p_size <> 50 THEN p_retailprice / 100e0 END AS tmag
    FROM {part}"""


@view
def runs(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey AS pipeline_run_id, o_custkey AS target_id, o_custkey * 3 AS tic_id,
           CASE WHEN o_orderstatus <> 'P' THEN 'ok' WHEN o_orderkey % 3 = 0 THEN 'error'
                ELSE 'no_data' END AS status,
           CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice / 1000e0 END AS runtime_s,
           CAST(o_orderdate AS DATE) AS data_vintage, o_orderdate AS started_at,
           CAST(round(o_totalprice) AS BIGINT) AS n_points, o_orderpriority AS notes
    FROM {{orders}}"""


@view
def detections(d: Dialect) -> str:
    return f"""
    SELECT l_orderkey AS pipeline_run_id,
           CASE WHEN l_linenumber <= 3 THEN 'bls' WHEN l_linenumber <= 5 THEN 'tls'
                ELSE 'single_event' END AS method,
           CAST(l_linenumber AS BIGINT) AS rank,
           CASE WHEN l_linenumber <= 5 THEN (l_suppkey % 50 + 1) * 1.5e0 * (1e0 + l_tax / 10e0) END
           AS period_days,
           1000e0 + {CENTS} % 100000 / 1000e0 AS epoch_bjd, l_discount * 10000e0 AS depth_ppm,
           2e0 + l_linenumber / 4e0 AS duration_hr,
           CASE WHEN l_orderkey % 41 <> 0 THEN l_quantity / 2.5e0 END AS snr
    FROM {{lineitem}}"""


# --- orbits ------------------------------------------------------------------------------------------------


@view
def satellites(d: Dialect) -> str:
    return f"""
    SELECT p_partkey AS satellite_id,
           CASE WHEN p_partkey % 50 <> 0 THEN 40000 + p_partkey END AS norad_id,
           'SAT ' || p_name || ' ' || CAST(p_partkey AS STRING) AS canonical_name,
           CASE p_type WHEN 'LARGE' THEN 'DEBRIS' WHEN 'SMALL' THEN 'ROCKET BODY'
                ELSE 'PAYLOAD' END AS object_type,
           CASE WHEN p_size <> 7 THEN {d.add_days('2023-10-01', 'p_size * 9')} END AS launch_date
    FROM {{part}}"""


@view
def elements(d: Dialect) -> str:
    perigee = f"(250e0 + {CENTS} % 1700 + 0.25e0)"
    apogee = f"({perigee} + l_quantity * 10e0)"
    a = f"(6378.135e0 + ({perigee} + {apogee}) / 2e0)"
    return f"""
    SELECT 40000 + l_partkey AS norad_id, l_shipdate AS epoch,
           CASE WHEN l_returnflag = 'A' THEN 'spacetrack_gp_history' ELSE 'celestrak_gp' END
           AS source,
           sqrt(398600.8e0 / ({a} * {a} * {a})) * 86400e0 / 6.283185307179586e0 AS mean_motion,
           l_quantity * 5e0 / {a} AS eccentricity,
           CASE WHEN l_orderkey % 37 <> 0 THEN ({CENTS} % 1790) / 10e0 END AS inclination,
           (l_orderkey % 360) * 1e0 AS ra_of_asc_node, (l_suppkey * 7 % 360) * 1e0
           AS arg_of_pericenter, ({CENTS} % 360) * 1e0 AS mean_anomaly, 0.0001e0 AS bstar,
           {perigee} AS perigee_km, {apogee} AS apogee_km
    FROM {{lineitem}}"""


@view
def ownership(d: Dialect) -> str:
    return """
    SELECT p_partkey AS satellite_id, CAST(p_partkey % 25 AS BIGINT) AS operator_id,
           CASE WHEN p_partkey % 9 = 0 THEN 'builder' ELSE 'owner' END AS role,
           CASE WHEN p_partkey % 7 = 0 THEN DATE '2024-06-01' END AS valid_to
    FROM {part}"""


@view
def operators(d: Dialect) -> str:
    return ("SELECT CAST(n_nationkey AS BIGINT) AS operator_id, n_name AS canonical_name "
            "FROM {nation}")


@view
def requests(d: Dialect) -> str:
    """One observing request per supplier; seven of nine name a site, one is custom, one unknown."""
    return f"""
    SELECT s_suppkey AS request_id, (s_suppkey * 137.50776405003785e0) % 360e0 AS ra,
           degrees(asin(2e0 * ((s_suppkey * 0.7548776662466927e0) % 1e0) - 1e0)) AS dec,
           {d.add_seconds("TIMESTAMP '2026-07-16 05:00:00'", 's_suppkey % 3 * 3600')} AS start,
           60 - CAST(s_suppkey % 2 AS INT) AS window_min, 30 AS step_sec,
           CASE s_suppkey % 9 WHEN 0 THEN 'kitt_peak' WHEN 1 THEN 'paranal' WHEN 2 THEN 'mauna_kea'
                WHEN 3 THEN 'la_palma' WHEN 4 THEN 'siding_spring' WHEN 5 THEN 'sutherland'
                WHEN 6 THEN 'generic_north' WHEN 7 THEN 'nowhere' END AS site,
           CASE WHEN s_suppkey % 9 = 8 AND s_suppkey % 2 = 0 THEN -30e0 + s_suppkey % 60 END AS lat,
           CASE WHEN s_suppkey % 9 = 8 THEN 20e0 END AS lon,
           CASE WHEN s_suppkey % 4 = 0 THEN 1.5e0 END AS elev
    FROM {d.dealt("{supplier}")}"""


@view
def site_table(d: Dialect) -> str:
    from starledger import specs

    values = ", ".join(f"('{k}', '{n}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE), "
                       f"CAST({e} AS DOUBLE))" for k, n, a, o, e in specs.SITES)
    return f"SELECT * FROM (VALUES {values}) AS v(site, site_name, lat_deg, lon_deg, elev_km)"


@view
def circular(d: Dialect) -> str:
    """Satellites on circular orbits in closed form, one row per part and step: positions in km."""
    radius = "(6878e0 + p_size * 10e0)"
    i = "radians((p_partkey * 17 % 180) * 1e0)"
    node = "radians((p_partkey * 47 % 360) * 1e0)"
    def at(step: int) -> str:
        u = f"radians((p_partkey * 31 % 360) + {step} * 8e0)"
        return f"""
    SELECT p_partkey AS satellite_id, 40000 + p_partkey AS norad_id, p_name AS name,
           500e0 + p_size * 10e0 AS alt_km, {step} AS step,
           {radius} * (cos({node}) * cos({u}) - sin({node}) * sin({u}) * cos({i})) AS x,
           {radius} * (sin({node}) * cos({u}) + cos({node}) * sin({u}) * cos({i})) AS y,
           {radius} * sin({u}) * sin({i}) AS z,
           CASE WHEN p_partkey % 43 = 0 THEN 6 ELSE 0 END AS error
    FROM {d.dealt("{part}")}"""

    return " UNION ALL ".join(at(step) for step in range(3))


@view
def positions(d: Dialect) -> str:
    """The same satellites every 30 seconds of three hours: inertial positions in km."""
    radius = "(6878e0 + p_size * 10e0)"
    i = "radians((p_partkey * 17 % 180) * 1e0)"
    node = "radians((p_partkey * 47 % 360) * 1e0)"
    u = "radians((p_partkey * 31 % 360) + k * 2e0)"
    return f"""
    SELECT p_partkey AS satellite_id, 40000 + p_partkey AS norad_id, p_name AS name,
           500e0 + p_size * 10e0 AS alt_km,
           {d.add_seconds("TIMESTAMP '2026-07-16 05:00:00'", 'k * 30')} AS instant,
           {radius} * (cos({node}) * cos({u}) - sin({node}) * sin({u}) * cos({i})) AS x,
           {radius} * (sin({node}) * cos({u}) + cos({node}) * sin({u}) * cos({i})) AS y,
           {radius} * sin({u}) * sin({i}) AS z,
           CASE WHEN p_partkey % 43 = 0 THEN 6 ELSE 0 END AS error
    FROM (SELECT *, {d.steps(360)} AS k FROM {d.dealt("{part}")})"""


# --- raw catalogs -----------------------------------------------------------------------------------------


def _place(key: str) -> tuple[str, str]:
    return (f"({key} * 137.50776405003785e0) % 360e0",
            f"degrees(asin(2e0 * (({key} * 0.7548776662466927e0) % 1e0) - 1e0))")


def _period(key: str, extra: str = "0") -> str:
    """Hundredths of a day, as an exact decimal; keys that share it are the same planet."""
    return f"CAST(CAST(100000 + ({key}) * 3700 % 400000 + {extra} AS BIGINT) / 100000e0 AS DECIMAL(28,10))"


_LOADED = "TIMESTAMP '2026-01-01 00:00:00' AS loaded_at"


def _number(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(28,10))"


@view
def raw_exofop_toi(d: Dialect) -> str:
    return f"""
    SELECT CAST(p_partkey AS STRING) || '.01' AS toi,
           CASE WHEN p_partkey % 23 <> 0 THEN {d.div('p_partkey', 3)} END AS tic_id,
           CASE p_size % 6 WHEN 0 THEN 'CP' WHEN 1 THEN 'KP' WHEN 2 THEN 'FP' WHEN 3 THEN 'FA'
                WHEN 4 THEN 'PC' ELSE 'odd' END AS tfopwg_disposition,
           {_period('p_partkey')} AS period_days, {_number('1.5 + p_size % 7')} AS duration_hr,
           {_number('p_size * 120')} AS depth_ppm,
           {_number('1.0 + p_size / 10e0')} AS planet_radius_re,
           {_number('2458000.5 + p_partkey % 1000')} AS epoch_bjd,
           {_number('4000 + p_partkey % 2000')} AS teff_k, {_number('4.25')} AS logg,
           {_number('0.5 + p_size % 10 / 10e0')} AS rstar_rsun,
           {_number('9 + p_partkey % 100 / 10e0')} AS tmag,
           p_partkey AS raw_id, CAST(1 AS BIGINT) AS ingest_run_id, {_LOADED}
    FROM {{part}}"""


@view
def raw_nea_toi(d: Dialect) -> str:
    """Every second part under the designation of the other list, the rest under one of its own."""
    return f"""
    SELECT CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '.01' ELSE '.03' END AS toi,
           CASE WHEN p_partkey % 23 <> 0 THEN {d.div('p_partkey', 3)} END AS tid,
           CASE p_size % 5 WHEN 0 THEN 'CP' WHEN 1 THEN 'KP' WHEN 2 THEN 'FP' WHEN 3 THEN 'FA'
                ELSE 'PC' END AS tfopwg_disp,
           {_period('p_partkey', '2')} AS period_days, {_number('1.5 + p_size % 6')} AS duration_hr,
           {_number('p_size * 121')} AS depth_ppm,
           {_number('1.0 + p_size / 9e0')} AS planet_radius_re,
           {_number('2458000.5 + p_partkey % 1000')} AS epoch_bjd,
           {_number('4000 + p_partkey % 2100')} AS teff_k, {_number('4.5')} AS logg,
           {_number('0.5 + p_size % 11 / 10e0')} AS rstar_rsun,
           {_number('9 + p_partkey % 100 / 10e0')} AS tmag,
           {_place(d.div('p_partkey', 3))[0]} AS ra_deg, {_place(d.div('p_partkey', 3))[1]} AS dec_deg,
           p_partkey AS raw_id, CAST(2 AS BIGINT) AS ingest_run_id, {_LOADED}
    FROM {{part}}"""


@view
def raw_exofop_ctoi(d: Dialect) -> str:
    ra, dec = _place("s_suppkey")
    return f"""
    SELECT CAST(s_suppkey AS STRING) || '.02' AS ctoi, s_suppkey AS tic_id,
           CASE s_suppkey % 4 WHEN 0 THEN 'PC' WHEN 1 THEN 'EB' WHEN 2 THEN 'KP' END
           AS user_disposition,
           {_period('3 * s_suppkey', '100')} AS period_days, {_number('2.5')} AS duration_hr,
           {_number('s_suppkey % 50 * 100')} AS depth_ppm,
           {_number('1.0 + s_suppkey % 50 / 10e0')} AS planet_radius_re,
           {_number('2458000.5')} AS epoch_bjd, {ra} AS ra_deg, {dec} AS dec_deg,
           s_suppkey AS raw_id, CAST(3 AS BIGINT) AS ingest_run_id, {_LOADED}
    FROM {{supplier}}"""


@view
def raw_koi_cumulative(d: Dialect) -> str:
    ra, dec = _place("c_custkey")
    return f"""
    SELECT c_custkey AS kepid,
           'K' || lpad(CAST(c_custkey AS STRING), 8, '0') || '.01' AS kepoi_name,
           CASE WHEN c_custkey % 4 = 0 THEN 'Kepler-' || CAST(c_custkey AS STRING) || ' b'
                WHEN c_custkey % 4 = 1 THEN 'HD ' || CAST(c_custkey AS STRING) || ' b' END
           AS kepler_name,
           CASE c_custkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'CANDIDATE'
                WHEN 2 THEN 'FALSE POSITIVE' WHEN 3 THEN 'NOT DISPOSITIONED' ELSE 'unclear' END
           AS koi_disposition,
           CASE WHEN c_custkey % 13 <> 0 THEN {_period('3 * c_custkey', '150')} END AS period_days,
           {_number('3.5')} AS duration_hr, {_number('c_custkey % 500 * 10')} AS depth_ppm,
           {_number('1.0 + c_custkey % 40 / 10e0')} AS planet_radius_re,
           {_number('2455000.25')} AS epoch_bjd, {_number('4500 + c_custkey % 1500')} AS teff_k,
           {_number('4.4')} AS logg, {_number('0.8')} AS rstar_rsun,
           CASE WHEN c_custkey % 17 <> 0 THEN {ra} END AS ra_deg,
           {dec} + CASE WHEN {dec} > 0 THEN -1e0 ELSE 1e0 END
                   * (c_custkey % 5) * 0.6e0 / 3600e0 AS dec_deg,
           c_custkey AS raw_id, CAST(4 AS BIGINT) AS ingest_run_id, {_LOADED}
    FROM {{customer}}"""


@view
def raw_ps(d: Dialect) -> str:
    ra, dec = _place("o_custkey")
    letter = "CASE o_orderkey % 3 WHEN 0 THEN ' b' WHEN 1 THEN ' c' ELSE ' d' END"
    host = "'HD ' || CAST(o_custkey AS STRING)"
    return f"""
    SELECT {host} || {letter} AS pl_name, {host} AS hostname,
           CASE WHEN o_custkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN o_custkey END AS tic_id,
           'Gaia DR3 ' || CAST(o_custkey * 1000 AS STRING) AS gaia_id,
           CASE WHEN o_custkey % 2 = 0 THEN {host} ELSE '' END AS hd_name,
           CASE WHEN o_custkey % 3 = 0 THEN 'HIP ' || CAST(o_custkey AS STRING) END AS hip_name,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CAST(1 AS BIGINT)
                ELSE CAST(0 AS BIGINT) END AS default_flag,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Published Confirmed'
                WHEN '2-HIGH' THEN 'Published Candidate' WHEN '3-MEDIUM' THEN 'TESS Project Candidate'
                ELSE 'Kepler Project Candidate' END AS soltype,
           CASE WHEN o_orderkey % 29 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END
           AS pl_controv_flag,
           CASE WHEN o_orderkey % 17 <> 0 THEN
                {_period('3 * o_custkey + o_orderkey % 3', 'o_orderkey % 7 * 10')} END AS period_days,
           {_number('1.0 + o_orderkey % 60 / 10e0')} AS planet_radius_re,
           CASE WHEN o_orderkey % 6 <> 0 THEN {_number('o_orderkey % 80 / 1000e0')} END AS depth_pct,
           {_number('2.0')} AS duration_hr, {_number('2457000.5 + o_orderkey % 900')} AS epoch_bjd,
           {_number('4000 + o_custkey % 2000 + o_orderkey % 300')} AS teff_k, {_number('4.3')} AS logg,
           {_number('0.7')} AS rstar_rsun, {_number('10.5')} AS vmag, {_number('9.75')} AS tmag,
           CASE WHEN o_orderkey % 4 <> 0 THEN {ra} END AS ra_deg,
           CASE WHEN o_orderkey % 4 <> 0 THEN {dec} END AS dec_deg,
           'Ref ' || CAST(o_orderkey % 50 AS STRING) AS pl_refname,
           'Star ref ' || CAST(o_orderkey % 50 AS STRING) AS st_refname,
           o_orderkey AS raw_id, CAST(5 AS BIGINT) AS ingest_run_id, {_LOADED}
    FROM {{orders}}"""


@view
def raw_pscomppars(d: Dialect) -> str:
    ra, dec = _place("c_custkey")
    host = "'HD ' || CAST(c_custkey AS STRING)"
    return f"""
    SELECT {host} || ' b' AS pl_name, {host} AS hostname,
           CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS tic_id,
           'Gaia DR3 ' || CAST(c_custkey * 1000 AS STRING) AS gaia_id,
           CAST(NULL AS STRING) AS hd_name, CAST(NULL AS STRING) AS hip_name,
           {_period('3 * c_custkey', '20')} AS period_days,
           {_number('1.0 + c_custkey % 60 / 10e0')} AS planet_radius_re,
           {_number('c_custkey % 90 / 1000e0')} AS depth_pct, {_number('2.25')} AS duration_hr,
           {_number('2457000.5')} AS epoch_bjd, {_number('4100 + c_custkey % 2000')} AS teff_k,
           {_number('4.35')} AS logg, {_number('0.75')} AS rstar_rsun, {_number('10.25')} AS vmag,
           {_number('9.5')} AS tmag, {ra} AS ra_deg, {dec} AS dec_deg,
           c_custkey AS raw_id, CAST(6 AS BIGINT) AS ingest_run_id, {_LOADED}
    FROM {{customer}}"""


@view
def designations(d: Dialect) -> str:
    """Orders as designations of their customer, with periods close enough to compete."""
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return f"""
    SELECT o_custkey AS star_id,
           CASE o_orderstatus WHEN 'F' THEN 'toi' WHEN 'O' THEN 'name' ELSE 'koi' END AS id_type,
           lpad(CAST({d.div('o_orderkey', 2)} AS STRING), 9, '0') AS id_value,
           CASE WHEN o_orderkey % 2 = 0 THEN 'exofop' ELSE 'nea' END AS source,
           CASE WHEN o_orderkey % 13 <> 0 THEN (500 + {cents} % 60) / 100e0 END AS period,
           CASE WHEN o_orderkey % 4 = 0 THEN 'P-' || CAST(o_orderkey % 1000 AS STRING)
                WHEN o_orderkey % 4 = 1 THEN '' END AS planet_name,
           o_orderkey % 2 AS source_order, o_orderkey AS raw_id
    FROM {{orders}}"""
