import random

import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.functions import unicode as U
from strandline.operators import changes, papers, reviews
from tests.conftest import SF


def test_unicode(spark):
    df = spark.createDataFrame([("Ａbc_Def-1",), (None,)], "x string")
    assert [r.y for r in df.select(U.normalize_identifier("x").alias("y")).collect()] == ["abc def 1", None]
    assert U.plain_claim("Some\u00ad thing re-\nused  HERE") == "some thing reused here"
    assert U.claim_sentences("See e.g. Fig. 3. Next one.\n- item two") == ["See e.g. Fig. 3.", "Next one.", "item two"]
    assert U.code_names("a.b(c)") == ["a", "b", "c"] and U.code_names("def (") == []
    assert U.toml_dependencies('[project]\ndependencies = ["Torch>=2", "x[y]"]\n[tool.poetry.dependencies]\npython="3"\nzed="1"') == ["torch", "x", "zed"]
    assert U.toml_dependencies("= no") == []


def test_latex_and_pages(spark):
    tex = "\\title{A \\emph{nice} title}\n\\author{Ann Bee \\and Cee Dee}\n\\begin{abstract}Short.\\end{abstract}\\section{One}body https://github.com/a/b\\section{Two}more"
    r = papers.latex_parts(spark.createDataFrame([("j", tex, "m", "n"), ("k", "plain", "m", "n")], "job string, tex string, meta_title string, meta_abstract string")).orderBy("job").collect()
    assert r[0].title == "A nice title" and r[0].authors == ["Ann Bee", "Cee Dee"] and [s.heading for s in r[0].sections] == ["Links", "One", "Two"]
    assert (r[1].title, r[1].abstract, r[1].sections) == ("m", "n", [])
    pages = spark.createDataFrame([("j", 1, "The title of this paper\n1 Introduction\nhello\nworld"), ("j", 2, "more\nMethods\nx")], "job string, page int, text string")
    got = {x.section: (x.heading, x.text) for x in papers.page_sections(pages).collect()}
    assert got == {0: (None, "The title of this paper"), 1: ("1 Introduction", "hello\nworld\nmore"), 2: ("Methods", "x")}
    assert papers.page_title(pages).first().title == "The title of this paper"


def test_project_pages(spark):
    rows = [("j", "https://x.org/nice", "<p>code: https://github.com/a/nice</p>", "https://github.com/a/nice", "Nice things")]
    assert papers.project_page_scores(spark.createDataFrame(rows, "job string, page_url string, html string, repo_url string, title string")).first().score == 9


def test_snapshots(spark):
    base = spark.createDataFrame([("a.py", "1"), ("b.py", "2"), ("c.py", "3")], "path string, text string")
    target = spark.createDataFrame([("a.py", "1"), ("b.py", "x"), ("d.py", "3"), ("e.py", "9")], "path string, text string")
    df = changes.compare_snapshots(base, target)
    assert {(r.path, r.diff_type) for r in df.collect()} == {("b.py", "modified"), ("c.py", "deleted"), ("d.py", "added"), ("e.py", "added")}
    assert [tuple(r) for r in changes.moved_files(df).collect()] == [("c.py", "d.py")]
    old = spark.createDataFrame([("src/model.py", "class A: pass\n" * 5), ("src/other.py", "zzz")], "path string, text string")
    new = spark.createDataFrame([("lib/model.py", "class A: pass\n" * 5)], "path string, text string")
    assert [(r.old_path, r.match_type) for r in changes.fuzzy_matches(old, new).collect()] == [("src/model.py", "moved")]


def test_clusters(spark):
    rows = [
        (1, "a.py", "LOSS", ["loss"], [], "L1", "d1"), (2, "b.py", "LOSS", ["loss", "x"], [], "L2", "d2"), (3, "c.py", "LOSS", ["x"], [], "L2", "d3"),
        (4, "d.py", "CORE", ["loss"], [], "L4", "d4"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, change_type string, tags array<string>, imports array<string>, label string, dir string")
    got = {r.cluster: (r.files, r.label, r.tags) for r in changes.clusters(df).collect()}
    assert got == {1: (["a.py", "b.py", "c.py"], "L2", ["loss", "x"]), 4: (["d.py"], "L4", ["loss"])}
    assert {(r.a, r.b): r.reasons for r in changes.link_reasons(df).collect()} == {(1, 2): ["tag:loss"], (2, 3): ["label:L2", "tag:x"]}
    assert {r.cluster: r.related for r in changes.related(changes.clusters(df)).collect()} == {1: [4], 4: [1]}


def test_ranges(spark):
    """Clusters of hunks: those of overlapping anchors, over bins of several sizes, or else the file's."""
    rng = random.Random(6)
    hunks = [(rng.choice("pqr"), f"h{k}", rng.choice([0, -1, rng.randint(1, 300)]), rng.choice([0, 1, 5, 90])) for k in range(60)]
    anchors = [(rng.choice("pq"), rng.choice("ABC"), a, a + rng.choice([0, 3, 150, -2])) for a in (rng.randint(0, 350) for _ in range(14))]
    members = [("p", "A"), ("p", "D"), ("q", "B"), ("s", "C"), ("p", "D")]
    want = set()
    for path, hunk, start, length in hunks:
        end = start + max(length - 1, 0)
        hit = {c for p, c, a, b in anchors if p == path and start > 0 and a > 0 and start <= b and a <= end and a <= b}
        want |= {(hunk, c) for c in hit or {c for p, c in members if p == path}}
    rows = [spark.createDataFrame(*x) for x in ((hunks, "path string, hunk_id string, start int, length int"), (anchors, "path string, cluster string, start_line int, end_line int"), (members, "path string, cluster string"))]
    for lines in (1, 7, 64):
        assert {(r.hunk_id, r.cluster) for r in changes.owners_of_ranges(*rows, bin_lines=lines).collect()} == want
    assert len(want) > 30


def test_reviews(spark):
    claims = spark.createDataFrame([("j", "k1", "c1"), ("j", "k1", "c2"), ("j", "k2", "c3")], "job string, contribution_key string, claim_id string")
    links = spark.createDataFrame([("c1", True), ("c1", False), ("c3", True)], "claim_id string, accepted boolean")
    got = {(r.claim_id, r.status, r.contribution_status) for r in reviews.project_statuses(claims, links).collect()}
    assert got == {("c1", "mapped", "partially_mapped"), ("c2", "unmapped", "partially_mapped"), ("c3", "mapped", "mapped")}
    mappings = spark.createDataFrame([("j", "D", "C", 0, 0, 0.0, 0.0, 0.9, 0.5, "FULL"), ("j", "E", "C", 1, 2, 0.5, 0.1, 0.6, 0.7, "PARTIAL")], "job string, cluster_id string, contribution_id string, comparable int, anchors int, snippet_fidelity double, formula_fidelity double, coverage double, confidence double, coverage_type string")
    assert [r.cluster_id for r in reviews.demote_weak(mappings).collect()] == ["E"] and reviews.focus(mappings).first().cluster_id == "E"
    sent = reviews.submit(spark.createDataFrame([(" arXiv:2106.09685 ", None)], "paper_source string, repo_url string")).first()
    assert sent.kind == "arxiv" and sent.status == "queued" and len(sent.job) == 24
    with pytest.raises(Exception):
        reviews.submit(spark.createDataFrame([(" ", None)], "paper_source string, repo_url string")).collect()
    state = reviews.status_view(spark.createDataFrame([("j", "building", "linking", 1, 2)], "job string, build_status string, phase string, done int, total int")).first()
    assert state.percent == pytest.approx(5.5 / 8 * 100)
    files = spark.createDataFrame([("r", "b", "2"), ("r", "a", "1")], "repo_url string, path string, text string")
    assert reviews.revision(files).first().revision == reviews.revision(files.orderBy("path")).first().revision
    assert files.select(reviews.cache_key(a=F.lit("x"))).first()[0]


def test_map_files(spark):
    old = spark.createDataFrame([("a.py", "1"), ("b.py", "same"), ("src/model.py", "class A: pass\n" * 6), ("gone.py", "q")], "path string, text string")
    new = spark.createDataFrame([("a.py", "2"), ("c.py", "same"), ("lib/model.py", "class A: pass\n" * 6 + "x = 1"), ("fresh.rs", "z")], "path string, text string")
    got = {(r.source_path, r.current_path, r.match_type) for r in changes.map_files(old, new).collect()}
    assert got == {
        ("a.py", "a.py", "exact_path"), ("b.py", "c.py", "content_moved"), ("src/model.py", "lib/model.py", "content_moved"), ("gone.py", None, "deleted"), (None, "fresh.rs", "added"),
    }


def test_renames_without_shared_words(spark):
    """Against the full comparison of all files of one extension."""
    import difflib
    import random
    import re

    rng = random.Random(5)
    def body(n):
        return "".join(rng.choice("abcdefgh \n") for _ in range(n))

    texts = [body(rng.randint(20, 120)) for _ in range(8)]
    old = [(f"old{i}/{'pqrstuvw'[i] * 4}.py", t) for i, t in enumerate(texts)] + [("main.py", "def run():\n    return 42\n" * 9), ("notes.md", "z"), ("Makefile", "all: build\n")]
    new = [(f"new{i}/{'ghijklmn'[i] * 4}.py", t[: len(t) * 9 // 10] + body(5)) for i, t in enumerate(texts)] + [("train.py", "def run():\n    return 42\n" * 9 + "x = 1\n"), ("Rules", "all: build\n\n")]
    frame = [spark.createDataFrame(x, "path string, text string") for x in (old, new)]

    def ext(p):
        return p.rsplit(".", 1)[1] if "." in p else ""

    def score(a, b):
        shared = set(re.findall("[a-z0-9]+", a[0].lower())) & set(re.findall("[a-z0-9]+", b[0].lower()))  # "py" at most
        return min(difflib.SequenceMatcher(None, a[1], b[1]).ratio() + 0.05 * len(shared), 1.0)

    ranked = {b[0]: sorted(((-score(a, b), a[0]) for a in old if ext(a[0]) == ext(b[0]))) for b in new}
    found = {r.new_path: r for r in changes.fuzzy_matches(*frame).collect()}
    assert set(found) == set(ranked)
    for path, best in ranked.items():
        assert found[path].old_path == best[0][1] and found[path].best == pytest.approx(-best[0][0])
        assert found[path].second == pytest.approx(-best[1][0] if len(best) > 1 else 0.0)
    got = {(r.source_path, r.current_path, r.match_type) for r in changes.map_files(*frame).collect()}
    assert got == {r[:2] + r[3:4] for r in brute_map(dict(old), dict(new))} and ("main.py", "train.py", "content_moved") in got


def brute_map(old, new):
    """Files in order of path, one after the other: (source, current, diff_type, match_type, similarity)."""
    import difflib
    import re

    def words(p):
        return set(re.findall("[a-z0-9]+", p.lower()))

    def parts(p):
        name = p.rsplit("/", 1)[-1]
        return (name.rsplit(".", 1)[0], "." + name.rsplit(".", 1)[1].lower()) if "." in name else (name, "")

    used, out = set(), []
    for c in sorted(new):
        if c in old:
            used.add(c)
            if old[c] != new[c]:
                out.append((c, c, "modified", "exact_path", 1.0))
            continue
        same = next((s for s in sorted(old) if old[s] == new[c] and s not in used), None)
        if same:
            used.add(same)
            out.append((same, c, "modified", "content_moved", 1.0))
            continue
        found = []
        for s in old:
            if s not in used and parts(s)[1] == parts(c)[1]:
                x = difflib.SequenceMatcher(None, old[s], new[c]).ratio() + min(0.05 * len(words(s) & words(c)), 0.2)
                found.append((min(1.0, x + (0.12 if parts(s)[0] == parts(c)[0] else 0.0)), s))
        found.sort(reverse=True)
        best, second = [*found, (0.0, None), (0.0, None)][:2]
        if best[0] >= 0.55 and second[0] >= 0.55 and best[0] - second[0] < 0.08:
            out.append((None, c, "added", "ambiguous", best[0]))
        elif best[0] >= 0.55:
            used.add(best[1])
            out.append((best[1], c, "modified", "content_moved", best[0]))
        elif best[0] >= 0.40:
            out.append((best[1], c, "added", "low_confidence", best[0]))
        else:
            out.append((None, c, "added", "added", 0.0))
    return out + [(s, None, "deleted", "deleted", 0.0) for s in sorted(set(old) - used)]


def map_rows(spark, old, new):
    frames = [spark.createDataFrame(list(x.items()), "path string, text string") for x in (old, new)]
    got = changes.map_files(*frames).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    return sorted(((r.source_path, r.current_path, r.diff_type, r.match_type, r.similarity) for r in got), key=key), sorted(brute_map(old, new), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_map_files_against_brute_force(spark, seed):
    """Copies, ties, ambiguous and faint matches, paths that are taken before their turn, chains of wishes."""
    import random

    rng = random.Random(seed)
    lines = [f"value_{i} = compute({i})" for i in range(12)]

    def body():
        return "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))

    texts = [body() for _ in range(7)]
    names = [f"{rng.choice(['src', 'lib', 'a', 'b'])}/{rng.choice(['model', 'data', 'run', 'x', 'y', 'zed'])}{i % 5}.{rng.choice(['py', 'py', 'md'])}" for i in range(40)]
    old = {n: rng.choice([rng.choice(texts), body()]) for n in names[:26]}
    new = {n: rng.choice([rng.choice(texts), body(), old.get(n, "q")]) for n in names[14:]}
    got, want = map_rows(spark, old, new)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])


def test_map_files_verdicts(spark):
    """An ambiguous file takes nothing; a faint match is named, and its old file counts as deleted; equal files are left out."""
    a, b = "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilom"
    got, want = map_rows(spark, {"src/a.py": a, "src/b.py": b, "k.py": "same"}, {"new.py": a[:-1] + "x", "k.py": "same"})
    assert got == want and ("deleted", "deleted") in {r[2:4] for r in got} and got[0][:4] == (None, "new.py", "added", "ambiguous")
    got, want = map_rows(spark, {"src/a.py": "abcdefghij"}, {"new_file.py": "abcd123456"})
    assert got == want and {r[3] for r in got} == {"low_confidence", "deleted"} and got[0][0] == "src/a.py"


def test_file_mapping_query(spark):
    from strandline import catalog
    from strandline.plans.lineage import item_trees
    from strandline.plans.registry import Tables
    from tests.conftest import SF

    old, new = ({r.path: r.text for r in x.collect()} for x in item_trees(Tables(spark, SF)))
    got = {(r.source_path, r.current_path, r.diff_type, r.match_type) for r in catalog.queries()["file_mapping"](spark, SF).collect()}
    assert got == {r[:4] for r in brute_map(old, new)} and len({r[3] for r in got}) >= 4


def test_greedy_against_brute_force(spark):
    import random

    from strandline.operators import sequences

    rng = random.Random(3)
    rows = [(t, s, rng.randint(1, 4) / 4) for t in range(30) for s in rng.sample(range(25), 12)]
    used, want = set(), []
    for t in range(30):
        free = sorted((-x, s) for a, s, x in rows if a == t and s not in used)
        if free:
            used.add(free[0][1])
            want.append((t, free[0][1], -free[0][0]))
    got = sequences.greedy(spark.createDataFrame(rows, "target long, source long, score double")).collect()
    assert sorted(map(tuple, got)) == want


def test_payloads_and_views(spark):
    reply = 'ok ```json\n[{"title": "T", "implementation_complexity": 9, "confidence": "x"}, {"title": " "}]\n```'
    r = reviews.coerce_contribution(spark.createDataFrame([("j", reply), ("k", "nothing")], "job string, payload string")).collect()
    assert [(x.job, x.title, x.keywords, x.complexity, x.confidence, x.repo_url) for x in r] == [("j", "T", [], 5, 0.45, None)]
    files = spark.createDataFrame([("r", "src/a.py", "import os"), ("r", "src/b.py", "import os\nimport re"), ("s", "x", "")], "repo_url string, path string, text string")
    assert reviews.context_summary(files).where("repo_url = 'r'").first().summary == "folders: src (2)\nimports: os (2), re (1)"
    a = spark.createDataFrame([("j", ["x", "y"])], "job string, warnings array<string>")
    b = spark.createDataFrame([("j", ["y", "z"])], "job string, warnings array<string>")
    assert reviews.all_warnings(a, b).first().warnings == ["x", "y", "z"]
    hunks = spark.createDataFrame([("f", 1, 1, 1, 1, 2, 3, 1), ("f", 2, 9, 1, 10, 1, 0, 2)], "file_id string, hunk long, old_start int, old_count int, new_start int, new_count int, added long, removed long")
    p = changes.file_payloads(hunks).first()
    assert (p.added, p.removed, p.changed, p.n_hunks, [h.hunk for h in p.hunks]) == (3, 3, 6, 2, [1, 2]) and len({h.hunk_id for h in p.hunks}) == 2
    anchors = spark.createDataFrame([("D", "b", True), ("D", "a", False), ("D", "b", False)], "cluster_id string, path string, comparable boolean")
    assert [(r.path, r.n, r.comparable) for r in reviews.cluster_files(anchors).orderBy("place").collect()] == [("b", 2, 1), ("a", 1, 0)]


def test_details_and_anchor_traces(spark):
    from strandline.operators import contributions as N

    own = spark.createDataFrame([("j", 1, "Low rank adapter", ["adapter", "matrices"], ["Table 1"], 2)], "job string, place int, title string, keywords array<string>, evidence_refs array<string>, complexity int")
    details = spark.createDataFrame([("j", 1, "The adapter matrices are trained", ["Eq. 2"]), ("j", 2, "Unrelated", [])], "job string, ord int, snippet string, refs array<string>")
    r = N.merge_details(own, details).first()
    assert (r.hints, r.evidence_refs, r.complexity) == (["The adapter matrices are trained"], ["Table 1", "Eq. 2"], 3)
    anchors = spark.createDataFrame([("j", "D", "C", "lora/adapter.py", 3, "lora rank update", ["adapter"]), ("j", "D", "C", "x.py", 1, "nothing", ["adapter"])], "job string, cluster_id string, contribution_id string, path string, start int, snippet string, keywords array<string>")
    assert [(x.path, x.score) for x in N.trace_anchors(anchors).collect()] == [("lora/adapter.py", 2)]


def test_small_text_functions(spark):
    from strandline.functions import text as T

    df = spark.createDataFrame([("file:///x", "class A(b.Base[int], Other):\n pass")], "u string, code string")
    r = df.select(T.is_local(F.col("u")).alias("l"), T.base_classes(F.col("code")).alias("b"), T.case_slug(F.col("u"), [("s", ("///x",))]).alias("c")).first()
    assert (r.l, r.b, r.c) == (True, ["Base", "Other"], "s")


def test_artifacts(spark, tmp_path):
    from strandline.sources import readers, sinks

    files = spark.createDataFrame([("k1", "f1", 3), ("k1", "f2", 4), ("k2", "f3", 5)], "cache_key string, file_id string, n int")
    sinks.write_artifacts(files, str(tmp_path / "a"))
    sinks.write_artifacts(files.where("cache_key = 'k1' and file_id = 'f1'"), str(tmp_path / "a"))
    sessions = spark.createDataFrame([("k1", "ready"), ("k2", "building")], "cache_key string, build_status string")
    got = readers.artifacts(spark, str(tmp_path / "a"), sessions, "file_id string, n int").collect()
    assert [(r.cache_key, r.file_id, r.n) for r in got] == [("k1", "f1", 3)]
    paths = spark.createDataFrame([("a.py",), ("b.rs",)], "path string")
    assert [r.path for r in readers.primary_language(paths).collect()] == ["a.py"]


def test_pairs_are_listed_without_a_shuffle_of_pairs(spark):
    plan = catalog.queries()["theta_self_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan


def test_links_are_never_broadcast(spark):
    plan = catalog.queries()["theta_self_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_links_of_blocks_and_of_repeated_ids(spark):
    rows = [(k, f"t{k % 2}", [f"n{k % 3}", None, f"n{k % 4}"], [f"m{k % 5}"] if k % 7 else None, f"l{k % 6}" if k % 5 else None, f"d{k % 2}") for k in range(40)]
    # Ids 3 and 8 have two rows of one type, and both have rows of the types of the others.
    rows += [(3, "t1", ["n9"], [], "l9", "d9"), (8, "t0", ["n9", "n9"], ["m9"], "l8", "d1"), (3, "t0", ["n0"], ["m9"], "l8", "d0"), (8, "t1", [], ["m0"], "l9", "d9")]
    rows += [(None, "t0", ["n0"], [], "l1", "d0"), (50, None, ["n0"], [], "l1", "d0"), (51, "t0", None, None, None, None)]
    has = {}
    for k, kind, *lists, label, folder in rows:
        found = [f"{n}:{v}" for n, vs in zip(("tag", "import", "label", "dir"), (*lists, [label], [folder])) for v in vs or [] if v]
        has.setdefault(k, set()).update((kind, r) for r in found if k is not None and kind)
    want = {(a, b): sorted({r for _, r in has[a] & has[b]}) for a in has for b in has if a is not None and b is not None and a < b and has[a] & has[b]}
    df = spark.createDataFrame(rows, "id long, change_type string, tags array<string>, imports array<string>, label string, dir string")
    for block in (3, 1024):
        got = [((r.a, r.b), r.reasons) for r in changes.link_reasons(df, block).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_sharing_pairs(spark):
    rows = [(k, [f"n{k % 3}", f"b{k % 4}", *(["n0"] if k % 5 else [None])]) for k in range(60)] + [(99, []), (98, None)]
    sets = {k: {x for x in tags or [] if x} for k, tags in rows}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    for block in (2, 1024):
        got = [tuple(r) for r in changes.sharing_pairs(df, block).collect()]
        assert len(got) == len(want) and set(got) == want
    plan = catalog.queries()["related_clusters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan
