"""Every registered query of the library against its SQL twin."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalog, fixture, oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | fixture.QUERIES, oracle.ORACLES | fixture.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("up", [True, False])
def test_whole_graph_is_walked(spark, up):
    edges = {(r["from_id"], r["to_id"]) for r in QUERIES["call_edges"](spark, SF).collect()}
    steps = {}
    for a, b in edges:
        steps.setdefault(b if up else a, set()).add(a if up else b)
    want = set()
    for root in steps:
        seen, front = set(), {root}
        for depth in (1, 2, 3):
            front = set().union(*(steps.get(x, ()) for x in front)) - seen
            seen |= front
            want |= {(root, x, depth) for x in front}
    got = QUERIES[f"all_{'callers' if up else 'callees'}_upto_3"](spark, SF).collect()
    assert {(r["root"], r["node"], r["depth"]) for r in got} == want and len(got) == len(want)
