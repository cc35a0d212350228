"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandline import catalog
from tests.conftest import SF

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same_rows(spark, con, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = con.sql(sql)
    at = [found.columns.index(n) for n in names]
    assert sorted(found.columns) == names
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same_rows(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
