"""Every engine query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from cinnabar.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_learned_rules(spark):
    got = [r["clause"] for r in QUERIES["learned_rules"](spark, SF).collect()]
    assert got in (["hot_order(0, 1) :-  building(1), urgent(0)"], ["hot_order(0, 1) :-  urgent(0), building(1)"])
    m = QUERIES["learned_metrics"](spark, SF).first()
    assert (m["precision"], m["recall"]) == (1.0, 1.0)
