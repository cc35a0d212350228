"""The operators' queries against their SQL on the smallest tables."""

import pytest

from strandline.llm import queries as Q
from tests.test_queries import duck, same_rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, duck, name):  # noqa: F811
    same_rows(spark, duck, Q.queries()[name], Q.oracle_sql()[name])


def test_chat_loss_is_read_from_the_spans(spark, monkeypatch):
    """Spans that are one off must show in the query's loss columns."""
    from pyspark.sql import functions as F

    from tests.conftest import SF

    def loss():
        return {r.conv_id: (r.loss_chars, r.loss_sha256) for r in Q.op5_chat_format(spark, SF).collect()}

    right, real = loss(), Q.chat_format
    off = F.transform("loss_spans", lambda x: F.struct((x["start"] + 1).alias("start"), x["length"].alias("length")))
    monkeypatch.setattr(Q, "chat_format", lambda df: real(df).withColumn("loss_spans", off))
    wrong = loss()
    assert right[-1] != wrong[-1] and sum(right[c] != wrong[c] for c in right) > len(right) / 2


def test_chat_parts_against_sql_on_awkward_texts(spark, tmp_path):
    """Control strings that lie across the two text parts of a turn, nulls and line breaks."""
    import duckdb

    texts = ["12345678<|im_end|>", "123456789<|nl|>", "1234567890<!|x<!!|", "<|image:0|> <|", None, "", "a\nb<|im_start|>user\n", "é<!|<|"]
    rows = [(c, k, role, t) for c in (5, 6) for k, (t, role) in enumerate(zip(texts[c - 5 :], ["user", "assistant", "sys\ntem", None] * 2))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("chat_parts", "op5_chat_format"):
        df = Q.queries()[name](spark, str(tmp_path))
        found = con.sql(Q.oracle_sql()[name])
        assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall())
