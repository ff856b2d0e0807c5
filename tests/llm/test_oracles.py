import os

import duckdb
import pytest

import __spark_entry__ as entry
from arcspool.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[cols].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names) == sorted(Q.QUERIES) and len(names) == 11
