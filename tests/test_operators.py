"""Behaviour of operators on small literal tables."""

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import candidates as C
from strandline.operators import contributions as N
from strandline.operators import diffs, graph, ordering, ranking, sequences
from strandline.sources import readers, sinks
from strandline.streaming import progress


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x", [0.575, 0.125, 2.675, 1.005, 0.685, 1234.565])
def test_python_round(spark, x):
    assert value(spark, S.python_round(F.lit(x))) == round(x, 2)


def test_repo_key_and_aliases(spark):
    assert value(spark, T.repo_key(F.lit("https://GitHub.com/a/b.git)."))) == "https://github.com/a/b"
    assert value(spark, T.repo_key(F.lit("https://github.com/a"))) is None
    assert value(spark, T.repo_aliases(F.lit("https://github.com/Own/Name"))) == ["name", "own/name"]
    assert value(spark, T.has_alias(F.lit("uses trl here"), F.lit("trl"))) and not value(spark, T.has_alias(F.lit("ctrl"), F.lit("trl")))
    assert value(spark, T.declares_base(F.lit("x\nThis is based on trl.\ny"), F.array(F.lit("trl"))))


def test_paths(spark):
    paths = ["src/a.py", "docs/a.py", ".hidden.py", "a/.git/b.py", "a/README.md", "a/b.png", "A.RS", "assets/x.json"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in df.where(T.included_file(F.col("path"))).collect()} == {"src/a.py", "A.RS"}
    assert value(spark, T.ancestors(F.lit("a/b/c.py"))) == ["a", "a/b"] and value(spark, T.ancestors(F.lit("a"))) == []
    assert value(spark, T.import_paths(F.array(F.lit("b.c"), F.lit("a")))) == ["a.py", "a/__init__.py", "b/c.py", "b/c/__init__.py"]


def test_texts(spark):
    assert value(spark, T.title_of(F.lit("We propose a small thing that does one two three four five six."))) == "a small thing that does one two three"
    assert value(spark, T.trim_to(F.lit("abcdefghij"), 8)) == "abcde..." and value(spark, T.trim_to(F.lit(" ab "), 8)) == "ab"
    assert value(spark, T.strip_latex(F.lit("A \\textbf{bold} \\cite{x} fact~here % note\n\\href{u}{link}"))) == "A bold fact here link"
    assert value(spark, T.dependency_names(F.lit("# c\nTorch>=2\n\n-e Foo[x]==1\ntorch"))) == ["torch", "foo"]
    assert value(spark, T.paper_id(F.lit("https://arxiv.org/abs/2106.09685v2"))) == "2106.09685"
    assert value(spark, T.json_block(F.lit('x ```json\n[1]\n``` y'))) == "[1]" and value(spark, T.json_block(F.lit('so {"a":1} ok'))) == '{"a":1}'


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x long")
    assert sorted((r.x, r.place) for r in ordering.numbered(df, [F.desc("x")], "place").collect()) == [(x, 101 - x) for x in range(101)]


def test_change_points_and_margin(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None)]
    df = spark.createDataFrame(rows, "k long, o long, s string")
    assert sorted((r.k, r.o) for r in ranking.change_points(df, "k", ["o"], ["s"]).collect()) == [(1, 1), (1, 3), (1, 5), (2, 1)]
    cases = [(0.9, 0.85, "ambiguous"), (0.9, 0.5, "moved"), (0.45, 0.1, "low_confidence"), (0.1, 0.0, "added")]
    for best, second, want in cases:
        assert value(spark, ranking.match_type(F.lit(best), F.lit(second), 0.55, 0.4, 0.08)) == want


def test_sequences(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.95), (2, 11, 0.2)], "target long, source long, score double")
    assert sorted((r.target, r.source) for r in sequences.greedy(df).collect()) == [(1, 10), (2, 11)]
    items = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c", "a"]), (1, 3, ["x", "y"])], "g long, ord long, tokens array<string>")
    assert sorted((r.cluster, r.size) for r in sequences.leaders(items, "g", 2).collect()) == [(0, 2), (1, 1)]


def test_diffs(spark):
    old, new = "a\nb\nc\nd\ne\nf\ng\nh", "a\nB\nc\nd\ne\nf\ng\nh\ni"
    df = spark.createDataFrame([(1, old, new)], "pair_id long, old string, new string")
    got = diffs.hunks(df.select("pair_id", diffs.unified("old", "new").alias("d")), "pair_id", "d").orderBy("hunk").collect()
    assert [(r.hunk, r.old_start, r.added, r.removed) for r in got] == [(1, 1, 1, 1), (2, 6, 1, 0)] or sum(r.added for r in got) == 2


def test_candidates_rank(spark):
    jobs = spark.createDataFrame([("j", "https://github.com/me/own"), ("k", "https://github.com/me/k")], "job string, own_url string")
    papers = spark.createDataFrame([("j", "see https://github.com/a/b and https://github.com/me/own, with trl")], "job string, text string")
    readme = spark.createDataFrame([("j", "intro\nThis is based on a/b: https://github.com/a/b")], "job string, text string")
    files = spark.createDataFrame([("j", "requirements.txt", "trl>=1\npeft"), ("j", "m.py", "from trl import DPOTrainer\nclass X(DPOTrainer): pass")], "job string, path string, text string")
    parts = [C.paper_mentions(papers), C.readmes(readme), C.dependencies(files), C.frameworks(files), C.code_references(files)]
    got = C.ranked(parts, jobs).orderBy("job", "place").collect()
    assert [(r.job, r.repo_url, r.strategy) for r in got][:2] == [
        ("j", "https://github.com/a/b", "readme_base_declaration"), ("j", "https://github.com/huggingface/trl", "framework_signature")
    ]
    assert got[-1].job == "k" and got[-1].strategy == "fallback" and not any(r.repo_url.endswith("/own") for r in got)


def test_fingerprint_and_shape(spark):
    code = "class Alpha:\n  pass\ndef beta(): pass"
    files = spark.createDataFrame([("j", "src/model.py", code), ("j", "requirements.txt", "torch")], "job string, path string, text string")
    others = spark.createDataFrame([("u", "src/model.py", code), ("u", "requirements.txt", "torch"), ("v", "x/y.rs", "")], "repo_url string, path string, text string")
    assert [(r.repo_url, r.confidence) for r in C.fingerprints(files, others).collect()] == [("u", 0.92)]
    assert [(r.repo_url, r.confidence) for r in C.shapes(files, others).collect()] == [("u", 0.88)]


def test_contributions(spark):
    papers = spark.createDataFrame([("j", "T", "We propose a low-rank adapter module. We show an efficient attention kernel for exact loss. Other.")], "job string, title string, text string")
    assert {r.title for r in N.by_signature(papers).collect()} == {"Low-rank adaptation modules", "IO-aware fused attention kernel"}
    assert N.by_sentence(papers).count() == 2
    sections = spark.createDataFrame([("j", 1, "2 Contributions", "- We propose a routing encoder module with efficient attention kernels\n- We introduce a frozen adapter objective for alignment of exact loss"), ("j", 2, "Notes", "x")], "job string, ord int, heading string, text string")
    found = N.findings(sections, ("contributions",))
    made = N.from_findings(found).collect()
    assert made and all(r.complexity >= 2 for r in made)
    assert N.synthesise(found).count() >= 1
    merged = N.merge_by_title(spark.createDataFrame([("j", 1, "C1", "A b", ["x", "y"]), ("j", 2, "C2", "a B", ["y", "z"])], "job string, ord int, id string, title string, keywords array<string>")).collect()
    assert [(r.id, r.title, r.keywords) for r in merged] == [("C1", "A b", ["x", "y", "z"])]
    contributions = spark.createDataFrame([("j", "C1", "Low-rank adapter", ["adapter"], ["Insert trainable low-rank adapter matrices"]), ("j", "C2", "Kernel", ["kernel"], [])], "job string, contribution_id string, title string, keywords array<string>, hints array<string>")
    clusters = spark.createDataFrame([("j", "D1", "adapter.py adds low-rank adapter matrices"), ("j", "D2", "cuda kernel")], "job string, cluster_id string, text string")
    scores = N.match_scores(contributions, clusters)
    assert {(r.cluster_id, r.contribution_id) for r in N.assign(scores).collect()} == {("D1", "C1"), ("D2", "C2")}


def test_readers(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1")
    (root / "src/b.py").write_bytes(b"\xff\xfe bad")
    (root / "README.md").write_text("hi")
    files = readers.file_tree(spark, str(root)).withColumn("repo_url", F.lit("r"))
    assert [(r.path, r.text) for r in readers.snapshot(files).collect()] == [("src/a.py", "x = 1")]
    assert {r.t for r in files.select(readers.lossy_text(F.col("content")).alias("t")).collect()} == {"x = 1", " bad", "hi"}
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name, body in (("a.tex", "short"), ("main.tex", "\\documentclass{x}\\begin{document}")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    archives = spark.createDataFrame([("s", bytearray(raw.getvalue())), ("t", bytearray(b"plain tex"))], "source string, content binary")
    got = {r.source: r.name for r in readers.primary_tex(readers.tar_members(archives)).collect()}
    assert got == {"s": "main.tex", "t": ""}
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A\n b</title><summary>S</summary><author><name>X Y</name></author></entry></feed>"
    r = readers.atom_entries(spark.createDataFrame([(feed,), ("<feed/>",)], "xml string")).collect()
    assert [(x.title, x.abstract, x.authors) for x in r] == [("A b", "S", ["X Y"])]
    hits = spark.createDataFrame([("s", "q", '{"items":[{"html_url":"https://github.com/a/b","owner":{"login":"A"},"created_at":"2020-01-01T00:00:00Z"},{"repository":{"html_url":"https://github.com/c/d"}}]}')], "strategy string, query string, payload string")
    assert [r.repo_url for r in readers.search_hits(hits).orderBy("ord").collect()] == ["https://github.com/a/b", "https://github.com/c/d"]


def test_sinks(spark, tmp_path):
    table = str(tmp_path / "jobs")
    assert sinks.read(spark, table) is None
    sinks.upsert(spark.createDataFrame([(1, "queued", 0.0), (2, "queued", 0.0)], "id long, status string, p double"), table, ["id"])
    sinks.upsert(spark.createDataFrame([(2, "", 0.5), (3, "running", None)], "id long, status string, p double"), table, ["id"])
    assert sorted(map(tuple, sinks.read(spark, table).collect())) == [(1, "queued", 0.0), (2, "queued", 0.5), (3, "running", None)]
    log = str(tmp_path / "log")
    events = "k long, seq long, s string"
    sinks.append_changed(spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], events), log, "k", ["s"], "seq")
    sinks.append_changed(spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (2, 1, "a")], events), log, "k", ["s"], "seq")
    assert sorted((r.k, r.seq) for r in sinks.read(spark, log).collect()) == [(1, 1), (1, 4), (2, 1)]
    assert len(sinks.versions(spark, log)) == 2
    assert sinks.migrate(spark.range(1), {"timeline": "array<string>", "note": "string"}).columns == ["id", "timeline", "note"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    n = events.count()
    for k, (a, b) in enumerate(((0, 0.4), (0.4, 0.7), (0.7, 1.1))):
        lo, hi = events.approxQuantile("event_id", [float(a), min(float(b), 1.0)], 0.0)
        part = events.where((F.col("event_id") >= lo if a == 0 else F.col("event_id") > lo) & (F.col("event_id") <= hi))
        part.coalesce(1).write.mode("append").parquet(source)
    ordered = events.withColumn("ts", F.timestamp_seconds("event_id"))  # arrival order is event order
    stream = progress.event_stream(spark, source, events.schema).withColumn("ts", F.timestamp_seconds("event_id"))
    progress.run_available(progress.changes(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.user_id, r.event_id) for r in ranking.change_points(ordered, "user_id", ["ts", "event_id"], ["event_type"]).collect()}
    assert n and got == want
    table = str(tmp_path / "latest")
    progress.run_upserts(progress.latest(stream).select("user_id", "event_type", "ts"), table, str(tmp_path / "cp2"), "user_id", "ts")
    best = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("e"))
    assert {(r.user_id, r.event_type) for r in sinks.read(spark, table).collect()} == {(r.user_id, r.e) for r in best.collect()}
    assert os.path.isdir(table)
