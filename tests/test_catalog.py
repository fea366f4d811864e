"""Every query against its SQL, on the smallest tables."""

import glob
import os

import pytest

from cairn import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got, want = sorted(tuple(text(r[c]) for c in names) for r in df.collect()), sorted(tuple(map(text, r)) for r in cur.fetchall())
    assert want or name == "trace_between", "an empty result proves nothing"  # no path among the smallest tables
    assert got == want


def test_both_outcomes_of_chains_are_there(spark):
    rows = catalog.queries()["chain_verify"](spark, SF).groupBy("ok").count().collect()
    assert {r.ok for r in rows} == {True, False} and {r.ok: r["count"] for r in rows}[True] > {r.ok: r["count"] for r in rows}[False]
