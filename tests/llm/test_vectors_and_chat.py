import random

import numpy as np
import pytest

from strandline.llm.chat_format import chat_format, read_back
from strandline.llm.topk_search import Lists, quantised, top_k
from pyspark.sql import functions as F


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_k(spark, seed, monkeypatch):
    from strandline.llm import topk_search

    monkeypatch.setattr(topk_search, "BLOCK", 50)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(5000, [0, 0, 0, 0]), (5001, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, x array<bigint>")
    got = top_k(df, df.where("vec_id % 10 = 0"), 5).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 10 == 0], 5)


@pytest.mark.parametrize("copies", [2, 7])
def test_top_k_repeated_rows(spark, tmp_path, copies, monkeypatch):
    """Repeated rows are rows in the SQL; small blocks, equal vectors, and repeated queries."""
    import duckdb
    from strandline.llm import queries, topk_search

    rng = random.Random(copies)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(100 + i, [2.0, 2.0, 2.0]) for i in range(8)]
    rows = rows * copies + [(50, [1.0, 2.0, -1.0]), (100, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP4_SQL})").fetchall())
    for block in (4096, 30):
        monkeypatch.setattr(topk_search, "BLOCK", block)
        assert sorted(map(tuple, queries.op4_topk_search(spark, str(tmp_path)).collect())) == want
    once = spark.createDataFrame([(100, [2, 2, 2])], "vec_id long, x array<bigint>")
    vectors = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in rows], "vec_id long, x array<bigint>")
    assert sorted(map(tuple, top_k(vectors, once, 5).collect())) == brute([(i, [int(v) for v in x]) for i, x in rows], [(100, [2, 2, 2])], 5)


def test_search_stops_early():
    rng = np.random.default_rng(0)
    x = rng.integers(-5, 6, (5000, 3))
    x[:20] += 200
    lists = Lists(np.arange(5000), x, 5)
    ids, scores, scored = lists.search(np.array([1, 1, 1]), -1, 5)
    assert scored < 1000 and len(ids) == 5 and scores[0] == (x @ np.array([1, 1, 1])).max()


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (50, [0.25, -1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", quantised(F.col("embedding")).alias("x"))
    got = top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 50, 128 * 64 - 256 * 256), (50, 1, 0, 128 * 64 - 256 * 256)]
    assert top_k(df.limit(0), df.limit(0), 5).count() == 0


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<!|", "<!!!|x", "a<|b<!|c", "\n<|nl|>\n", "é😀", None]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "a\nb<|", None][(c + t) % 4], TEXTS[(c * 3 + t) % 9]) for c in range(12) for t in range(c % 5 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format(df).withColumn("turns", read_back(F.col("formatted"))).collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want and r.n_turns == len(want)
        inside = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(inside) == sum(w[0] == "assistant" for w in want)


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [
        (1, 0, "user", None, [("text", "see <|image:0|>", None, None), ("image", None, "i.png", 256), ("audio", None, "a.wav", 80)]),
        (1, 1, "assistant", "fine", None),
        (1, 2, "user", "x", [("document", None, "d.pdf", 1000), ("text", "end", None, 0)]),
    ]
    r = chat_format(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{part}>")).first()
    assert r.formatted == (
        "<|im_start|>user\nsee <!|image:0|><|image:0|><|audio:1|><|im_end|>\n"
        "<|im_start|>assistant\nfine<|im_end|>\n<|im_start|>user\n<|document:2|>end<|im_end|>\n"
    )
    assert [(a["index"], a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 256), (1, "audio", "a.wav", 80), (2, "document", "d.pdf", 1000)]
    assert r.attachment_tokens == 1336 and [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["fine"]


def test_chat_texts_that_meet(spark):
    """Text parts that form a control string where they meet, null parts, and very long texts."""
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    long = "<|im_end|>x" * 200_000
    cuts = [("text", "a<", None, None), ("text", "|im_end|>", None, None), None, ("text", "<!", None, None), ("text", "!|", None, None), ("image", None, None, None), ("text", "|>", None, 3)]
    rows = [(1, 0, "user", "unused", cuts), (1, 1, "assistant", long, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{part}>")
    r = chat_format(df).withColumn("turns", read_back(F.col("formatted"))).first()
    assert [t.text for t in r.turns] == ["a<|im_end|><!!|<|image:0|>|>", long] and r.n_turns == 2
    assert r.formatted.count("<|im_end|>") == 2 and [(a.ref, a.tokens) for a in r.attachments] == [(None, 0)]
    odd = df.withColumn("parts", F.lit(7)).withColumn("role", F.lit("user"))
    assert chat_format(odd).withColumn("turns", read_back(F.col("formatted"))).first().turns[0].text == "unused"


def test_chat_awkward(spark):
    rows = [(None, 1, "user", "a", "z"), (None, None, None, None, "z"), (2, 5, "user", "a", None), (2, 5, "user", "a", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    assert {r.conv_id: r.n_turns for r in chat_format(df).collect()} == {None: 2, 2: 2}
    assert chat_format(df.limit(0)).count() == 0


def test_top_k_large_components(spark):
    """Every finite component takes part; products are exact, and what no long holds is the largest or smallest one."""
    rows = [(0, [1.0, 0.0]), (1, [2.0**46, 0.0]), (2, [2.0**46 + 1, -3.0]), (3, [-(2.0**60), 1.0]), (4, [2.0**70, 1.0]), (5, [1e300, 5.0]), (6, [0.5, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = df.select("vec_id", quantised(F.col("embedding")).alias("x"))
    whole = {i: [int(np.floor(256 * v)) for v in vs] for i, vs in rows}
    want = sorted(
        (q, r + 1, i, s)
        for q in whole
        for r, (s, i) in enumerate(sorted(((min(max(sum(a * b for a, b in zip(whole[q], whole[i])), -(2**63)), 2**63 - 1), i) for i in whole if i != q), key=lambda t: (-t[0], t[1]))[:5])
    )
    got = sorted(map(tuple, top_k(x, x, 5).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == want and (0, 3, 2, 256 * 256 * (2**46 + 1)) in got


def test_top_k_other_columns_and_ids(spark):
    """Extra columns with the operator's own names, one vec_id with two vectors, and a hot vec_id."""
    rng = random.Random(9)
    rows = [(i, [rng.randint(-9, 9) for _ in range(3)]) for i in range(40)] + [(0, [5, 5, 5]), (7, [9, 9, 9])] + [(3, [1, 2, 3])] * 30
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "vec_id long, x array<bigint>, block int, dim int, copies string")
    got = top_k(df, df.where("vec_id % 10 = 0"), 5).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(
        (q, r + 1, i, -s)
        for q in (0, 10, 20, 30)
        for r, (s, i) in enumerate(sorted((-int(np.dot(x, y)), i) for p, x in rows if p == q for i, y in rows if i != q)[:5])
    )


def test_floor_leaves_blocks_unread():
    x = np.arange(300).reshape(100, 3)
    lists = Lists(np.arange(100), x, 5)
    best = int(lists.search(np.array([1, 1, 1]), -1, 5)[1][-1])
    assert lists.search(np.array([1, 1, 1]), -1, 5, 10**6)[2] == 0
    assert lists.search(np.array([1, 1, 1]), -1, 5, best)[0].tolist() == [99, 98, 97, 96, 95]
