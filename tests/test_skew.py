"""One key holds a third of all rows: results stay whole, and lineage cuts go to the shared folder."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starledger import specs
from starledger.operators import blocks, picks, resolution
from starledger.operators import conflicts as cf
from starledger.session import checkpoint_root
from tests.test_identity import claims


def test_hot_series_keeps_every_row_and_box(spark):
    rng = np.random.default_rng(11)
    hot = np.sort(rng.uniform(0, 200, 6000))
    parts = [pd.DataFrame({"tic_id": 1, "time": hot, "flux": rng.normal(1, 1e-3, hot.size)})]
    parts += [pd.DataFrame({"tic_id": i, "time": np.sort(rng.uniform(0, 50, 200)),
                            "flux": rng.normal(1, 1e-3, 200)}) for i in range(2, 62)]
    data = pd.concat(parts)
    boxed = blocks.sliding_boxes(spark.createDataFrame(data), ["tic_id"], "time", "flux", [0.5, 2.0])
    got = boxed.toPandas().sort_values(["tic_id", "time"])
    assert len(got) == len(data)
    one = got[got["tic_id"] == 1]
    t, f = hot, parts[0]["flux"].to_numpy()
    for i, half in ((0, 0.25), (1, 1.0)):
        inside = [(t >= c - half) & (t <= c + half) for c in t[::500]]
        assert one[f"count_{i}"].to_numpy()[::500].tolist() == [int(m.sum()) for m in inside]
        assert np.allclose(one[f"mean_{i}"].to_numpy()[::500], [f[m].mean() for m in inside])


def test_hot_entity_conflicts_and_picks(spark):
    rows = [(None, 1, "planet_radius_re", f"{10 + i % 7}.{i % 10}", ("ps", "koi", "nea_toi")[i % 3])
            for i in range(3000)]
    rows += [(None, 2 + i, "planet_radius_re", "5", "ps") for i in range(2000)]
    said = claims(spark, rows)
    found = cf.numeric_conflicts(said, "candidate_id", "planet_radius_re", "0.10").collect()
    assert [(r.eid, r.n_sources, float(r.mn), float(r.mx)) for r in found] == [(1, 3, 10.0, 16.9)]
    latest = resolution.last_per_source(said, "candidate_id")
    assert latest.count() == 2003
    values = {r.eid: r.value for r in resolution.pick_numeric(
        latest, specs.precedence(spark)).collect()}
    last_ps = [v for _, c, _, v, s in rows if c == 1 and s == "ps"][-1]
    assert values[1] == float(last_ps) and values[2] == 5.0


def test_top_k_ships_k_rows_per_task(spark):
    df = spark.range(100000).select((F.col("id") % 3).alias("k"), "id")
    kept = picks.top_k(df, ["k"], [F.col("id")], 4)
    assert sorted(r.id for r in kept.collect()) == list(range(12))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        checkpoint_root(Session())


def test_scratch_tables_can_be_removed(spark, monkeypatch):
    import os

    from starledger import session

    monkeypatch.setattr(session, "_WRITTEN", [])
    kept = session.cut_lineage(spark.range(5), "kept")
    path = session._WRITTEN[0].removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    assert session.remove_scratch(spark) == 1 and not os.path.exists(path) and session._WRITTEN == []
