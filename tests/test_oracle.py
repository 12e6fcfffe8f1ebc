"""Every registered query against DuckDB on the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Whole-pipeline queries; tools/check_oracle.py covers them.
LONG = {name for name in QUERIES if name.startswith(("e09", "g05_pass_finder_hits", "l05_box_search_c",
                                                     "l06_second", "l07_template_s", "l09", "l03"))}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    assert compare(got, rows_of([c[0] for c in cur.description], cur.fetchall())) is None


def test_entry_is_the_radius_page(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 50 and [r.spread for r in rows] == sorted(
        (r.spread for r in rows), reverse=True)
