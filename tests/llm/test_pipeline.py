"""The pipeline's stages against brute force, each on its own input."""

import collections

import duckdb
import pytest

import corpus_pipeline as P
from strandline.llm import queries as Q
from strandline.llm import sp_sampling
from tests.conftest import SF
from tests.llm import edge
from tests.llm.test_documents import AZ, brute_near


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == list(P.COLUMNS) for df in stages[1:-1])


def test_quality(stages):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({Q.OP2_SQL})").fetchall() if k}
    before = rows(stages[0])
    assert rows(stages[1]) == {i: before[i] for i in want}


def test_lines(stages):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(AZ)

    before, seen = rows(stages[1]), collections.defaultdict(set)
    for i, t in before.items():
        for line in t.split("\n"):
            seen[key(line)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10) for i, t in before.items()}
    assert rows(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near(stages):
    before = sorted(rows(stages[2]).items())
    kept = {before[i][0] for i, _, c in brute_near([t for _, t in before], 5, 80) if i == c}
    assert set(rows(stages[3])) == kept


def test_mix(stages):
    before, after = rows(stages[3]), stages[4].collect()
    source = {r.doc_id: r.source for r in stages[3].collect()}
    sizes = {i: len(t.split()) for i, t in before.items()}
    assert all(before[r.doc_id] == r.text for r in after)
    assert max(collections.Counter(r.doc_id for r in after).values()) <= 3
    names, total = sorted(set(source.values())), sum(sizes.values())
    own = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = total - sum(3 * own[s] for s in full)
        share = left / sum(weight[s] for s in names if s not in full)
        target = {s: 3 * own[s] if s in full else share * weight[s] for s in names}
        over = {s for s in names if target[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in after:
        taken[r.source] += sizes[r.doc_id]
    assert all(abs(taken[s] - target[s]) <= max(0.1 * target[s], 60) for s in names)


def test_encode(spark, stages):
    want = collections.Counter((r.doc_id, r.text) for r in stages[4].collect())
    back = sp_sampling.decode(stages[5]).where("sample = 0").collect()
    assert collections.Counter((r.doc_id, r.decoded_text) for r in back) == want


def test_awkward_rows_and_run(spark):
    docs = edge.table(spark)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.select(*P.COLUMNS), SF).columns == list(P.COLUMNS)
        assert stage(spark, edge.empty(spark), SF).count() == 0
    assert P.run(spark, SF).count() > 0
