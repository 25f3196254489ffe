"""Every query against its SQL twin over the smallest tables; those without one must run and keep their rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from loomgrid.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, tables):
    out = QUERIES[name](spark, sf_dir)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(v) for v in r) for r in out.select(columns).collect()), key=repr)
    if name in SQL:
        rows = tables.sql(SQL[name])
        assert sorted(rows.columns) == columns
        places = [rows.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in places) for r in rows.fetchall()), key=repr)
    else:
        assert got


def test_entry(spark):
    assert entry_module.entry(spark).count() == 30
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
