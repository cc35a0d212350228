"""Spark expressions against plain-Python models on generated values; each example is a whole column."""

import hashlib
import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
TEXT = st.text(alphabet=st.sampled_from("abcXYZ019_- .!?\n\té|#*%:/"), max_size=60)
LINES = st.lists(TEXT, min_size=20, max_size=200)


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@FEW
@given(st.lists(st.floats(0, 1000).map(lambda v: round(v, 3)), min_size=50, max_size=300))
def test_rounding(spark, values):
    assert column(spark, values, "double", S.python_round) == [round(v, 2) for v in values]


@FEW
@given(LINES)
def test_tokens(spark, values):
    def model(v):
        return {t for t in re.findall(V.TOKEN, v.lower()) if t not in V.STOPWORDS and not re.fullmatch("[0-9]+", t)}

    assert [set(x) for x in column(spark, values, "string", T.tokens)] == [model(v) for v in values]
    assert column(spark, values, "string", T.token_list) == [list(dict.fromkeys(re.findall(V.TOKEN, v.lower()))) for v in values]


@FEW
@given(LINES)
def test_sentences_and_trims(spark, values):
    def split(v):
        return [s.strip() for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", v) if s.strip()]

    def trim(v):
        v = v.strip()
        return v if len(v) <= 20 else v[:17].rstrip() + "..."

    assert column(spark, values, "string", T.sentences) == [split(v) for v in values]
    assert column(spark, values, "string", lambda x: T.trim_to(x, 20)) == [trim(v) for v in values]
    assert column(spark, values, "string", T.compact) == ["\n".join(s.strip() for s in v.split("\n") if s.strip()) for v in values]


@FEW
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cc", "Cs")), max_size=30), min_size=20, max_size=100))
def test_digest(spark, values):
    def model(v):
        raw = json.dumps({"b": v, "a": 1}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(raw.encode()).hexdigest()[:24]

    assert column(spark, values, "string", lambda x: S.stable_digest(24, b=x, a=F.lit(1))) == [model(v) for v in values]


@FEW
@given(st.lists(st.tuples(st.lists(st.integers(0, 6), max_size=8), st.lists(st.integers(0, 6), max_size=8)), min_size=20, max_size=100))
def test_overlaps(spark, pairs):
    df = spark.createDataFrame([(i, list(set(a)), list(set(b))) for i, (a, b) in enumerate(pairs)], "i long, a array<int>, b array<int>")
    got = df.select("i", S.overlap(F.col("a"), F.col("b")).alias("o"), S.recall(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    for g, (a, b) in zip(got, pairs):
        both, small, right = len(set(a) & set(b)), min(len(set(a)), len(set(b))), len(set(b))
        assert g.o == (both / small if small else 0.0) and g.r == (both / right if right else 0.0)
