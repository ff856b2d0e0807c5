"""The driver's contract, and each registered core query against its SQL."""

import importlib.util
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from arcspool import queries as base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def values(frame):
    def plain(x):
        if isinstance(x, str) or x is None or x != x:
            return x if isinstance(x, str) else None
        return float(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([plain(x) for x in row]) for row in frame.where(frame.notna(), None).values.tolist())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "pr"] and entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, duck, name):
    got = base.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in base.ORACLES:
        want = duck.execute(base.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_without_llm(monkeypatch):
    """The entry module imports and registers the core queries where the optional subpackage is missing."""
    monkeypatch.setitem(sys.modules, "arcspool.llm", None)
    monkeypatch.setitem(sys.modules, "arcspool.llm.queries", None)
    spec = importlib.util.spec_from_file_location("entry_alone", entry.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(base.QUERIES) and set(alone.oracle_sql()) == set(base.ORACLES)
