import random

from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import designations as dz
from starledger.operators import links as lk
from starledger.operators import resolution as rs
from starledger.operators.ids import with_dense_id
from starledger.operators.skymatch import nearest_star

OBS = ("star_id bigint, id_type string, id_value string, source string, period double, "
       "planet_name string, source_order int, raw_id bigint")


def cluster(spark, rows):
    data = [(star, t, v, s, p, None, 0, i) for i, (star, t, v, s, p) in enumerate(rows)]
    return dz.cluster(dz.collapse(spark.createDataFrame(data, OBS)))


def as_map(clustered):
    return {(r.star_id, r.id_type, r.id_value): (f"{r.seed_type}:{r.seed_value}", r.rule,
                                                 tuple(r.competing or ()))
            for r in clustered.collect()}


def test_clustering_cases(spark):
    rows = [(1, "toi", "101.01", "exofop", 1.43), (1, "toi", "101.01", "nea", 1.43),
            (2, "toi", "174.01", "exofop", 3.7695), (2, "name", "HD 3167 b", "nea", 3.77),
            (3, "name", "K b", "nea", 5.0), (3, "name", "K c", "nea", 12.0),
            (4, "name", "A", "nea", 5.0), (4, "name", "C", "nea", 5.06),
            (4, "toi", "9.01", "exofop", 5.03),
            (5, "koi", "K1.01", "nea", None), (5, "toi", "2.01", "exofop", None)]
    clustered = cluster(spark, rows)
    got = as_map(clustered)
    assert got[(1, "toi", "101.01")] == ("toi:101.01", "candidate_seed", ())
    assert got[(2, "toi", "174.01")] == ("name:HD 3167 b", "period_match<1pct", ())
    assert got[(3, "name", "K c")][0] == "name:K c"
    assert got[(4, "toi", "9.01")] == ("toi:9.01", "candidate_seed", ("name:A", "name:C"))
    assert got[(5, "toi", "2.01")][0] == "toi:2.01" and len(got) == 10
    both = clustered.filter("star_id = 1").first().sources
    assert both == ["exofop", "nea"]


def brute_force(designations, tol=0.01):
    seeds, out = [], {}
    for key, period in sorted(designations):
        hits = [k for k, p in seeds if period and p and abs(p - period) / max(p, period) < tol]
        if len(hits) == 1:
            out[key] = (":".join(hits[0]), "period_match<1pct", ())
        else:
            out[key] = (":".join(key), "candidate_seed", tuple(":".join(h) for h in hits))
            seeds.append((key, period))
    return out


def test_clustering_equals_brute_force_on_a_hot_star(spark):
    rng = random.Random(7)
    rows = []
    for star, n, spread in ((1, 1500, 40.0), (2, 300, 0.2), (3, 3, 0.01)):
        for i in range(n):
            period = None if rng.random() < 0.05 else round(5.0 + rng.random() * spread, 4)
            rows.append((star, rng.choice(["toi", "koi", "name"]), f"{i:05d}", "nea", period))
    got = as_map(cluster(spark, rows))
    for star in (1, 2, 3):
        want = brute_force([((t, v), p) for s, t, v, _, p in rows if s == star])
        assert {k[1:]: v for k, v in got.items() if k[0] == star} == want


def test_audit_holds_one_row_per_link_and_flag(spark):
    clustered = cluster(spark, [(4, "name", "A", "nea", 5.0), (4, "name", "C", "nea", 5.06),
                                (4, "toi", "9.01", "exofop", 5.03)])
    rows = dz.candidate_links(clustered, dz.candidates(clustered))
    flagged = dz.ambiguous(clustered)
    audit = lk.audit_of_links(rows).unionByName(lk.audit_of_ambiguous(flagged))
    assert lk.audit_gap(rows, flagged, audit).isEmpty() and lk.bad_owner(rows).isEmpty()
    assert audit.filter("score IS NULL").count() == 1 and audit.count() == 4
    assert not lk.audit_gap(rows, flagged, audit.limit(3)).isEmpty()


def test_insert_if_absent_treats_nulls_as_equal(spark):
    schema = "star_id bigint, candidate_id bigint, id_type string, id_value string, source string"
    old = spark.createDataFrame([(1, None, "tic", "7", "nea")], schema)
    new = spark.createDataFrame([(1, None, "tic", "7", "nea"), (2, None, "tic", "8", "nea"),
                                 (2, None, "tic", "8", "nea")], schema)
    assert [r.star_id for r in lk.drop_existing(new, old).collect()] == [2]


def test_dense_ids_do_not_depend_on_partitioning(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    for parts in (1, 13):
        got = with_dense_id(rows.repartition(parts), "n", ["k"], start=1)
        assert got.filter(F.col("n") != F.col("k") + 1).isEmpty()


def test_sky_match_edges(spark):
    arc = 1 / 3600.0
    stars = spark.createDataFrame([
        (1, 0.0, 10.0), (2, 50.0, 20.0), (3, 120.0, 89.99995), (4, 200.0, None), (5, 80.0, -30.0),
        (6, 50.0, 20.0)], "star_id bigint, ra_deg double, dec_deg double")
    probes = spark.createDataFrame([
        (10, 359.99999, 10.0), (11, 50.0, 20.0 + 1.99 * arc), (12, 50.0, 20.0 + 2.01 * arc),
        (13, 300.0, 89.99995), (14, None, 5.0), (15, 80.0, -30.0), (16, 80.0, -30.0 + arc)],
        "kepid bigint, ra_deg double, dec_deg double")
    got = {r.kepid: (r.star_id, r.sep_arcsec)
           for r in nearest_star(stars, probes, "kepid").collect()}
    assert set(got) == {10, 11, 13, 15, 16}
    assert got[10][0] == 1 and got[11][0] == 2 and got[13][0] == 3  # across RA 0 and the pole
    assert abs(got[11][1] - 1.99) < 1e-6 and got[15] == (5, 0.0) and got[16][0] == 5


CLAIM = ("star_id bigint, candidate_id bigint, source_key string, attribute string, value string, "
         "source string, source_ref string, observed_at timestamp, ingest_run_id bigint, "
         "raw_id bigint, unit string")


def claims(spark, rows):
    import datetime as dt

    at = dt.datetime(2026, 1, 1)
    return spark.createDataFrame(
        [(s, c, "k", a, v, src, None, at, 1, i, None) for i, (s, c, a, v, src) in enumerate(rows)],
        CLAIM)


def test_precedence_resolution(spark):
    said = claims(spark, [
        (None, 1, "period_days", "5.5", "exofop_toi"), (None, 1, "period_days", "5.0", "ps"),
        (None, 1, "disposition", "FP", "exofop_toi"),
        (None, 1, "disposition", "Published Confirmed", "ps"),
        (9, None, "teff_k", "5780", "exofop_toi"), (9, None, "teff_k", "3200", "ps"),
        (None, 2, "period_days", "junk", "pscomppars"), (None, 2, "period_days", "7", "ps"),
        (None, 3, "disposition", "who knows", "pscomppars"), (None, 3, "disposition", "PC", "nea_toi"),
        (None, 4, "period_days", "1", "ps"), (None, 4, "period_days", "2", "ps")])
    ranks = specs.precedence(spark)
    latest = rs.last_per_source(said, "candidate_id")
    numeric = {(r.eid, r.attribute): r.value for r in rs.pick_numeric(latest, ranks).collect()}
    # The best source's text is no number: no fall-through for candidate 2.
    assert numeric == {(1, "period_days"): 5.0, (4, "period_days"): 2.0}
    votes = rs.disposition_votes(latest, ranks, specs.vocabulary(spark))
    words = {r.eid: r.disposition for r in rs.resolve_dispositions(votes).collect()}
    assert words == {1: "CONFIRMED", 3: "CANDIDATE"}
    assert [tuple(r) for r in rs.unmapped_words(votes).collect()] == [("pscomppars", "who knows")]
    teff = rs.pick_numeric(rs.last_per_source(said, "star_id"), ranks).first().value
    assert teff == 3200.0


def test_claims_that_are_read_once_are_not_written(spark, monkeypatch):
    import datetime as dt

    from starledger.plans import graph

    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label="cut": written.append(label) or df)
    at = dt.datetime(2026, 1, 1)
    numbers = ["period_days", "duration_hr", "depth_pct", "planet_radius_re", "epoch_bjd", "teff_k", "logg",
               "rstar_rsun", "vmag", "tmag"]
    raw = spark.createDataFrame(
        [(5, "A b", "ref", None, 0, "Published Confirmed", *[1.5] * 10, at, 1, 1),
         (5, "A c", None, None, 0, None, *[None] * 9, 9.0, at, 1, 2),
         (None, "B b", None, None, 0, "Published Confirmed", *[2.5] * 10, at, 1, 3)],
        "tic_id bigint, pl_name string, pl_refname string, st_refname string, pl_controv_flag int, soltype string, "
        + ", ".join(f"{n} double" for n in numbers) + ", loaded_at timestamp, ingest_run_id bigint, raw_id bigint")
    links = spark.createDataFrame(
        [(1, None, "tic", "5", "nea"), (None, 7, "name", "A b", "nea"), (None, 8, "name", "A c", "nea")],
        "star_id bigint, candidate_id bigint, id_type string, id_value string, source string").withColumn(
        "confidence", F.lit(1.0))
    built = graph.Graph({"raw_ps": raw}, None, None, links, None, None, None)
    rows = built.claim_rows()
    counted = {r.attribute: r["count"] for r in rows.groupBy("attribute").count().collect()}
    assert not written
    assert counted["period_days"] == 1 and counted["tmag"] == 2 and counted["teff_k"] == 1
    assert sorted(map(tuple, built.claims.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert written == ["claims"]
