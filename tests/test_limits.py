"""The reference's limits, on small tables made to exceed them."""

import duckdb
import pytest

from strandline import catalog
from strandline.sources import readers

BIG = "x" * 200_001


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("limits"))
    docs = [(i, "a", "t") for i in range(210)] + [(-1, "a", BIG), (300, "b", BIG[1:]), (301, "c", "\n" * 5000), (302, "c", "y" * 524_289), (303, "c", "\n" * 4999)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    turns = [(1, k, "z" * 4000) for k in range(30)] + [(2, k, "z" * 10) for k in range(12)] + [(3, k, "z" * n) for k, n in enumerate((3500, 3500, 3500, 3301, 50))]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


def rows(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, df.collect()))
    if name in catalog.oracle_sql():
        assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
    return got


def test_snapshot_scan(spark, folder):
    got = rows(spark, folder, "snapshot_scan")
    assert [r for r in got if r[0] == "a"] == [("a", i, i + 1) for i in range(200)] and ("b", 300, 1) in got and ("c", 302, 2) not in got


def test_large_file_mode(spark, folder):
    got = {r[0]: r[1] for r in rows(spark, folder, "large_file_mode")}
    assert {k for k, v in got.items() if v == "raw_diff_only"} == {301, 302}


def test_running_budget(spark, folder):
    assert rows(spark, folder, "running_budget") == [(1, 4, 14_000), (2, 8, 80), (3, 4, 13_801)]


def test_batch_pack(spark, folder):
    got = rows(spark, folder, "batch_pack")
    assert [r for r in got if r[0] == 1] == [(1, b, 4, 14_000) for b in range(3)]
    assert [r for r in got if r[0] == 2] == [(2, 0, 8, 80), (2, 1, 4, 40)]


def test_snapshot_places(spark):
    files = [("r", "a.py", 10, b"a"), ("r", "b.py", 999, b"b"), ("r", "c.py", 10, b"\xff"), ("r", "d.py", 10, b"d")]
    df = spark.createDataFrame(files, "repo_url string, path string, length long, content binary")
    got = readers.snapshot(df, most=2, max_bytes=100).collect()
    assert sorted((r.path, r.ord) for r in got) == [("a.py", 1), ("d.py", 2)]


def test_connected_components_over_all_lines(spark, tmp_path):
    """Against union-find."""
    import random

    rng = random.Random(3)
    orders = [(i, rng.randint(1, 40)) for i in range(60)]
    lines = [(rng.randint(0, 59), rng.randint(1, 45), rng.randint(2, 5), 10.0) for _ in range(70)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    customers = {}
    for o, s, _, _ in lines:
        customers.setdefault(s, set()).add(dict(orders)[o])
    groups = {c: {c} for _, c in orders}
    for cs in customers.values():
        whole = set().union(*(groups[c] for c in cs))
        for c in whole:
            groups[c] = whole
    want = sorted((c, min(groups[c])) for c in {c for cs in customers.values() if len(cs) > 1 for c in cs})
    assert sorted(map(tuple, catalog.queries()["connected_components"](spark, str(tmp_path)).collect())) == want
