import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import sightline as sl
from starledger.plans.passes import find_passes

REQUEST = ("request_id bigint, ra double, dec double, start timestamp, window_min int, step_sec int, "
           "site string, lat double, lon double, elev double")
AT = dt.datetime(2026, 7, 16, 5, 0)


def requests(spark):
    return spark.createDataFrame([
        (1, 258.831475, 4.960211, AT, 60, 30, "kitt_peak", None, None, None),
        (2, 346.6263919, -5.0434618, AT, 60, 30, "kitt_peak", None, None, None),
        (3, 258.831475, 4.960211, AT, 60, 30, None, None, None, None),
        (4, 258.8, 4.9, AT, 60, 30, "nowhere", None, None, None)], REQUEST)


def test_visibility_depends_on_earth_rotation_only(spark):
    placed = sl.with_site(requests(spark), specs.sites(spark))
    assert placed.count() == 3  # the unknown site drops out
    grid = sl.time_grid(placed.select("request_id", "start", "window_min", "step_sec"))
    assert grid.filter("request_id = 1").count() == 121
    track = sl.target_track(placed.drop("start", "window_min", "step_sec").join(
        grid.select("request_id", "step", "instant", "gmst"), "request_id"))
    seen = {r.request_id: r for r in sl.target_visibility(track, 20.0).collect()}
    assert seen[1].target_visible and seen[1].target_max_alt_deg > 20
    assert not seen[2].target_visible and seen[3].target_max_alt_deg == seen[1].target_max_alt_deg


def ephemeris(spark, n=600):
    """Circular orbits in closed form, every 30 seconds of an hour."""
    rows = []
    for i in range(n):
        radius, tilt, node = 6878.0 + i % 50, np.radians(30 + i % 70), np.radians(i * 7 % 360)
        for k in range(121):
            u = np.radians(i * 13 % 360 + k * 1.9)
            rows.append((i, 40000 + i, f"SAT {i}", radius - 6378, AT + dt.timedelta(seconds=30 * k),
                         radius * (np.cos(node) * np.cos(u) - np.sin(node) * np.sin(u) * np.cos(tilt)),
                         radius * (np.sin(node) * np.cos(u) + np.cos(node) * np.sin(u) * np.cos(tilt)),
                         radius * np.sin(u) * np.sin(tilt), 0))
    return spark.createDataFrame(
        [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows],
        "satellite_id bigint, norad_id bigint, name string, alt_km double, instant timestamp, "
        "x double, y double, z double, error int")


def test_passes_keep_their_invariants(spark):
    owners = spark.createDataFrame([(i, f"Owner {i % 3}") for i in range(300)]
                                   + [(i, "A second owner") for i in range(0, 300, 2)],
                                   "satellite_id bigint, operator string")
    moves = ephemeris(spark)
    found = find_passes(requests(spark), moves, owners, specs.sites(spark), sep_deg=10.0, max_results=5)
    facts = {r.request_id: r for r in found.requests.collect()}
    hits = [r for r in found.hits.collect() if r.request_id == 1]
    assert facts[1].n_found > 5 and facts[1].truncated and len(hits) == 5
    assert facts[2].n_found == 0 and not facts[2].target_visible
    assert all(h.sep_deg < 10 and h.sat_alt_deg > 0 for h in hits)
    hits.sort(key=lambda h: h.place)
    assert [h.sep_deg for h in hits] == sorted(h.sep_deg for h in hits)
    tally = found.tally.filter("request_id = 1").agg(F.sum("hits")).first()[0]
    assert tally == facts[1].n_found
    assert not found.tally.filter("operator = 'Unattributed'").isEmpty()
    whole = find_passes(requests(spark), moves, owners, specs.sites(spark), sep_deg=10.0)
    listed = [r for r in whole.hits.collect() if r.request_id == 1]
    assert len(listed) == len({r.satellite_id for r in listed}) == facts[1].n_found


def test_horizon_cells_lose_no_visible_satellite(spark):
    from starledger.functions.frames import observer_vectors

    moves = ephemeris(spark, 80)
    places = spark.createDataFrame([(1, 90.0, 0.0, 0.0), (2, -33.9, 18.5, 1.8), (3, 0.0, -78.0, 5.0)],
                                   "observer_id bigint, lat double, lon double, elev double")
    vectors = observer_vectors(F.col("lat"), F.col("lon"), F.col("elev"))
    observers = places.select("observer_id", *[v.alias(k) for k, v in vectors.items()]).crossJoin(
        moves.select("instant").distinct().withColumn("gmst", F.lit(0.7)))
    got = {(r.observer_id, r.satellite_id, r.instant) for r in sl.in_sight(moves, observers).collect()}
    site = {r.observer_id: r for r in observers.dropDuplicates(["observer_id"]).collect()}
    want = set()
    for m in moves.collect():
        e = np.array([np.cos(.7) * m.x + np.sin(.7) * m.y, np.cos(.7) * m.y - np.sin(.7) * m.x, m.z])
        for i, o in site.items():
            if np.dot(e - [o.obs_x, o.obs_y, o.obs_z], [o.up_x, o.up_y, o.up_z]) > 0:
                want.add((i, m.satellite_id, m.instant))
    assert got == want


def test_fractional_steps_keep_their_time(spark):
    window = spark.createDataFrame([(1, AT, 0.1, 1.5)], "request_id int, start timestamp, window_min double, step_sec double")
    got = [r.instant - AT for r in sl.time_grid(window).orderBy("step").collect()]
    assert got == [dt.timedelta(seconds=1.5 * k) for k in range(5)]


def test_cells_never_lose_a_close_pair(spark):
    from starledger.operators.cells import near_pairs

    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(v)],
                               "i int, x double, y double, z double")
    other = df.selectExpr("i AS j", "x AS px", "y AS py", "z AS pz")
    for radius in (1.0, 12.0, 30.0):
        pairs = near_pairs(df, other, ("x", "y", "z"), ("px", "py", "pz"), radius)
        dot = "x * px + y * py + z * pz"
        got = {(r.i, r.j) for r in pairs.filter(f"{dot} > cos(radians({radius}))").collect()}
        want = {(i, j) for i, j in zip(*np.where(v @ v.T > np.cos(np.radians(radius))))}
        assert got == want and pairs.count() == pairs.distinct().count()


def test_cones_lose_no_satellite_and_meet_few(spark):
    """Close passes equal those of comparing every sightline with every satellite."""
    rng = np.random.default_rng(6)
    n = 1500
    way = rng.normal(size=(n, 3))
    way /= np.linalg.norm(way, axis=1)[:, None]
    radius = rng.choice([6650.0, 6900.0, 7400.0, 8300.0, 42164.0], n)
    sats = [(i, AT, *map(float, way[i] * radius[i]), int(i % 50 == 0)) for i in range(n)]
    positions = spark.createDataFrame(sats, "satellite_id int, instant timestamp, x double, y double, z double, error int")
    lines = spark.createDataFrame(
        [(k, float(ra), float(dec), AT, float(gmst), float(lat), float(lon), 1.0) for k, (ra, dec, gmst, lat, lon) in enumerate(
            zip(rng.uniform(0, 360, 300), rng.uniform(-90, 90, 300), rng.uniform(0, 6.28, 300),
                rng.choice([-90, -33, 0, 5, 60, 90], 300), rng.uniform(-180, 180, 300)))],
        "request_id int, ra double, dec double, instant timestamp, gmst double, lat double, lon double, elev double")
    from starledger.functions.frames import observer_vectors
    vectors = observer_vectors(F.col("lat"), F.col("lon"), F.col("elev"))
    lines = lines.select("request_id", "ra", "dec", "instant", "gmst", *[v.alias(k) for k, v in vectors.items()])
    p = np.array([s[2:5] for s in sats])
    for sep in (2.0, 12.0, 40.0):
        want = set()
        for o in lines.collect():
            c, s = np.cos(o.gmst), np.sin(o.gmst)
            site, up = (np.array([c * x - s * y, s * x + c * y, z]) for x, y, z in (
                (o.obs_x, o.obs_y, o.obs_z), (o.up_x, o.up_y, o.up_z)))
            ra, dec = np.radians(o.ra), np.radians(o.dec)
            to = p - site
            to /= np.linalg.norm(to, axis=1)[:, None]
            near = to @ [np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)] > np.cos(np.radians(sep))
            want |= {(o.request_id, int(i)) for i in np.flatnonzero(near & (to @ up > 0)) if i % 50}
        got = sl.cone_approaches(lines, positions, sep).collect()
        assert {(r.request_id, r.satellite_id) for r in got} == want and len(got) == len(want) > 10
        assert all(r.sep_deg < sep and r.sat_alt_deg > 0 for r in got)


def test_small_tables_of_observers_are_sent_and_large_ones_merged(spark, monkeypatch):
    """Positions are shuffled only where the caps are too many to be sent; the satellites seen are the same."""
    from starledger.functions.frames import observer_vectors

    vectors = observer_vectors(F.lit(40.0), F.lit(10.0), F.lit(1.0))
    moves = ephemeris(spark, 60)
    observers = moves.select("instant").distinct().select("instant", F.lit(0.3).alias("gmst"),
                                                          *[v.alias(k) for k, v in vectors.items()])
    seen = []
    for few, join in ((1 << 19, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(sl, "FEW_ROWS", few)
        rows = sl.in_sight(moves, observers)
        assert join in rows._jdf.queryExecution().sparkPlan().toString()
        seen.append(sorted((r.satellite_id, r.instant, r.range_km) for r in rows.collect()))
    assert seen[0] == seen[1] and seen[0]


def test_multiplied_tables_are_dealt_over_tasks(spark):
    """One small file of parts must not make one task of all positions."""
    from starledger.registry.views import DEALT, Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    assert min(t.positions.rdd.getNumPartitions(), t.circular.rdd.getNumPartitions()) >= DEALT


@pytest.mark.parametrize("n", [4, 900])
def test_the_closest_few_are_those_of_all_pairs(spark, n):
    """Whatever the density, a request's closest satellites and their closest steps are found; far ones stay out."""
    rng = np.random.default_rng(n)
    way = rng.normal(size=(2 * n, 3))
    way /= np.linalg.norm(way, axis=1)[:, None]
    seen = spark.createDataFrame(
        [(k % n, k % n, "s", 500.0, k // n, *map(float, v), 10.0, int(k % 50 == 0)) for k, v in enumerate(way)],
        "satellite_id int, norad_id int, name string, alt_km double, step int, u_x double, u_y double, u_z double, "
        "sat_alt_deg double, error int")
    aim = way[:40] if n > 40 else np.vstack([way, -way])
    track = spark.createDataFrame([(i % 30, *map(float, v), 45.0, AT) for i, v in enumerate(aim)],
                                  "request_id int, g_x double, g_y double, g_z double, target_alt_deg double, instant timestamp")
    whole = sl.closest_per_satellite(sl.close_approaches(track, seen, [], 25.0, 20.0))
    some = sl.closest_few(track, seen, [], 25.0, 20.0, 3)
    names = ["request_id", "satellite_id", "sep_deg", "place"]
    first, second = (sorted(map(tuple, sl.capped_hits(x, 3).select(*names).collect())) for x in (whole, some))
    assert first == second and first
    if n > 40:
        assert some.count() < whole.count() / 3


def _looks(spark, n_lines, n_satellites, steps=3):
    """(track, seen): some ids look two ways, some rows come twice, some satellites have no id or no direction."""
    rng = np.random.default_rng(n_satellites)
    way = rng.normal(size=(n_satellites * steps, 3))
    way /= np.linalg.norm(way, axis=1)[:, None]
    rows = [(k % n_satellites if k % n_satellites != 3 else None, 7, "s", 500.0 + k % n_satellites, k // n_satellites,
             *map(float, v), 10.0, int(k % 50 == 1)) for k, v in enumerate(way)]
    rows += rows[:5] + [(1, 7, "s", 501.0, None, None, 0.0, 1.0, 10.0, 0)]
    seen = spark.createDataFrame(rows, "satellite_id int, norad_id int, name string, alt_km double, step int, u_x double, "
                                 "u_y double, u_z double, sat_alt_deg double, error int")
    aim = rng.normal(size=(n_lines, 3))
    aim /= np.linalg.norm(aim, axis=1)[:, None]
    looks = [(i % (n_lines - 4) if i % 10 else None, *map(float, v), 45.0 - 30 * (i == 2), AT) for i, v in enumerate(aim)]
    looks += looks[:4] + [(5, None, 0.0, 1.0, 45.0, AT)]
    track = spark.createDataFrame(looks, "request_id int, g_x double, g_y double, g_z double, target_alt_deg double, "
                                  "instant timestamp")
    return track, seen


def _sorted(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("cut", [False, True])
def test_approaches_by_tile_are_those_of_the_join(spark, monkeypatch, cut):
    """Every pair and every closest step, also where tiles are cut into shares of satellites and of sightlines."""
    from starledger.operators import approaches
    if cut:
        monkeypatch.setattr(approaches, "STEPS_PER_SHARE", 100)
        monkeypatch.setattr(approaches, "LINES_PER_TILE", 20)
    track, seen = _looks(spark, 60, 200)
    whole = sl.close_approaches(track.dropna(subset=["g_x"]), seen.dropna(subset=["u_x"]), [], 20.0, 20.0)
    names = ["request_id", "satellite_id", "step", "sep_deg", "alt_km"]
    got = _sorted(sl.fixed_approaches(track, seen, 20.0, 20.0, ["alt_km"]).select(*names))
    assert got == _sorted(whole.select(*names)) and len(got) > 100
    names.remove("step")
    got = _sorted(sl.closest_fixed_approaches(track, seen, 20.0, 20.0, ["alt_km"]).select(*names))
    assert got == _sorted(sl.closest_per_satellite(whole).select(*names)) and len(got) > 50
    # A third of the satellites has no owner; counts of the tiles add up to those of the pairs.
    owners = spark.createDataFrame([(i, f"o{i % 4}") for i in range(200) if i % 3], "satellite_id int, operator string")
    plain = sl.owner_tally(sl.with_owner(sl.closest_per_satellite(whole), owners))
    counted = sl.owner_tally(sl.closest_fixed_approaches(
        track, sl.with_owner(seen, owners), 20.0, 20.0, ["operator"], tally=True), counted=True)
    assert counted.dtypes == plain.dtypes and _sorted(counted) == _sorted(plain)


@pytest.mark.parametrize("closest", [False, True])
def test_a_tile_is_worked_off_in_slabs(monkeypatch, closest):
    """Neither the batches that a tile's satellites come in nor the slabs change its pairs; no batch grows with them."""
    import pyarrow as pa

    from starledger.operators import approaches
    rng = np.random.default_rng(5)
    g, u = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(7, 3)), rng.normal(size=(90, 3))))
    rows = [(0, *v, i, None, None) for i, v in enumerate(g)] + [(1, *v, None, i // 9, i % 9) for i, v in enumerate(u)]
    columns = ["_tag", "_x", "_y", "_z", "_request", "satellite_id", "step"]
    types = [pa.int32(), *[pa.float64()] * 3, *[pa.int64()] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], columns)
    zero = pa.array([0] * len(rows), pa.int64())
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, *batch.columns], ["_cell", "_share", "_part", *columns])

    def pairs(height):
        parts = [batch.slice(i, height) for i in range(0, len(rows), height)]
        return [b.to_pylist() for b in approaches._Pairs(60.0, [], closest, "request_id")(iter(parts))]

    def flat(found):
        return sorted(tuple(r.values()) for part in found for r in part)

    expected = flat(pairs(1000))
    dots = np.degrees(np.arccos(g @ u.T))
    best = {(i, s) for i, s in np.argwhere(dots.reshape(7, 10, 9).min(axis=2) < 60)}
    assert {r[:2] for r in expected} == best and len(expected) == (len(best) if closest else (dots < 60).sum())
    monkeypatch.setattr(approaches, "SLAB", 20)
    monkeypatch.setattr(approaches, "PAIRS_PER_BATCH", 30)
    for height in (1, 4, 13, 1000):
        found = pairs(height)
        assert flat(found) == expected and max(map(len, found)) < 30 + 9 * 20


def test_pairs_of_sightlines_and_satellites_are_not_shuffled(spark):
    """The pairs grow with requests times satellites: what comes after them combines in the task that finds them."""
    track, seen = _looks(spark, 20, 50)
    track = track.filter("request_id is not null").dropDuplicates(["request_id"])
    for rows in (sl.fixed_approaches(track, seen, 20.0, 20.0, []),
                 sl.closest_fixed_approaches(track, seen, 20.0, 20.0, [])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("MapInArrow")] and "Exchange" in plan


def test_rounded_is_round(spark):
    from starledger.functions.numeric import rounded
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, 1.0000005, 9.9999995, -1.0000005, -0.3, 7.1234564999999, 1e-9, -1e-9,
              123456.7890125, 1e12 + 0.1234567, float("inf"), float("nan"), None,
              *map(float, np.random.default_rng(1).uniform(-10, 10, 2000))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.filter(~rounded(F.col("v"), 6).eqNullSafe(F.round("v", 6))).count() == 0


def test_satellites_far_from_every_cone_are_not_shuffled(spark, monkeypatch):
    """Only cubes that a cone crosses are dealt out, where they fit a task; the passes found are the same either way."""
    from starledger.functions.frames import observer_vectors

    rng = np.random.default_rng(8)
    way = rng.normal(size=(600, 3))
    way /= np.linalg.norm(way, axis=1)[:, None]
    sats = [(i if i % 7 else None, AT, *map(float, w * 7000.0), 0) for i, w in enumerate(way)]
    positions = spark.createDataFrame(sats, "satellite_id int, instant timestamp, x double, y double, z double, error int")
    vectors = observer_vectors(F.lit(40.0), F.lit(10.0), F.lit(1.0))
    lines = spark.createDataFrame([(k, 30.0 * k, 20.0, AT, 0.3) for k in range(12)],
                                  "request_id int, ra double, dec double, instant timestamp, gmst double").select(
        "request_id", "ra", "dec", "instant", "gmst", *[v.alias(k) for k, v in vectors.items()])
    seen = []
    for few, semi in ((1 << 19, True), (0, False)):
        monkeypatch.setattr(sl, "FEW_ROWS", few)
        near = sl.cone_approaches(lines, positions, 20.0)
        assert ("LeftSemi" in near._jdf.queryExecution().optimizedPlan().toString()) == semi
        seen.append(sorted(near.collect(), key=str))
    assert seen[0] == seen[1] and len(seen[0]) > 5


def test_closest_steps_carry_only_the_columns_read(spark):
    """A name that nobody reads is not in the plan; the picked columns come from one row."""
    near = spark.createDataFrame([(1, 2, 0, 7, "a", 500.0, 3.0, 40.0, AT), (1, 2, 1, 7, "b", 501.0, 2.0, 41.0, AT),
                                  (1, 2, 2, 8, None, 502.0, 2.0, 42.0, AT), (1, 3, 0, 9, None, 503.0, 1.0, 43.0, AT)],
                                 "request_id int, satellite_id int, step int, norad_id int, name string, alt_km double, "
                                 "sep_deg double, sat_alt_deg double, instant timestamp")
    for together in (False, True):
        best = sl.closest_per_satellite(near, together=together)
        assert sorted(tuple(r)[:-1] for r in best.collect()) == [
            (1, 2, 7, "b", 501.0, 2.0, 41.0), (1, 3, 9, None, 503.0, 1.0, 43.0)]
        plan = best.select("request_id", "satellite_id", "sep_deg")._jdf.queryExecution().optimizedPlan().toString()
        assert "min_by(name" not in plan and "min_by(sep_deg" in plan
