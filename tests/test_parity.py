"""Every core query against its SQL on the smallest tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from parity import normal

MODULES = [importlib.import_module(m) for m in entry.MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
