"""Anchors, base files and merged contributions against plain models of their rules, on random input."""

import difflib
import hashlib
import random
import re
from pathlib import PurePosixPath as P

import pytest

from strandline import catalog
from strandline.functions import fixed_values as V
from strandline.operators import basefiles, changes, sequences
from tests.conftest import SF
from tests.test_brute_force import neighbours, sentences, table


def plain_anchors(path, base_path, old, new):
    a, b = (old or "").splitlines(), new.splitlines()
    rows = []

    def digest(*parts):
        return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:12]

    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op not in ("insert", "replace") or len(rows) == 3:
            continue
        now, was = b[max(j1 - 3, 0) : j2 + 3][:24], a[max(i1 - 3, 0) : i2 + 3][:24]
        text, before = "\n".join(now).strip(), "\n".join(was).strip()
        if not text or text == before:
            continue
        lines = [max(j1 - 3, 0) + 1, max(j1 - 3, 0) + len(now)]
        lines += [max(i1 - 3, 0) + 1, max(i1 - 3, 0) + len(was)] if before else [None, None]
        ident = digest(path, base_path or "", *(x or 0 for x in lines), text, before, op)
        rows.append((ident, base_path or path if before else None, {"insert": "addition"}.get(op, "modification"), *lines, text, before or None))
    if not rows and b:
        top, under = b[:8], "\n".join(a[:8]).strip()
        lines = [1, len(top), *([1, min(len(a), len(top))] if a else [None, None])]
        ident = digest(path, base_path or "", *(x or 0 for x in lines), "\n".join(top), under, "context")
        rows.append((ident, base_path or path if a else None, "context", *lines, "\n".join(top), under or None))
    return [(*r, bool((r[-1] or "").strip()) and bool(r[-2].strip()) and r[-1].strip() != r[-2].strip()) for r in rows]


def rows_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.pair_id, r.place)):
        out.setdefault(r.pair_id, []).append((r.patch_id, r.base_path, r.anchor_kind, r.start_line, r.end_line, r.original_start_line, r.original_end_line, r.snippet, r.original_snippet, r.comparable))
    return out


def test_anchors(spark):
    rng, pairs = random.Random(5), []
    for k in range(60):
        old = [rng.choice(["a", "b", "  ", "", "x = 1", "end\r"]) + rng.choice(["", str(rng.randint(0, 5))]) for _ in range(rng.choice([0, 1, 5, 12, 60]))]
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(new))
            new[at : at + rng.randint(0, 2)] = [rng.choice(["new", "", " ", "b1"])] * rng.choice([0, 1, 1, 30])
        pairs.append((k, f"p/{k}.py", rng.choice([None, "base.py"]), "\n".join(old) if old or k % 2 else None, "\n".join(new) + rng.choice(["", "\n"])))
    df = spark.createDataFrame(pairs, "pair_id long, path string, base_path string, old string, new string")
    want = {k: plain_anchors(p, b, o, n) for k, p, b, o, n in pairs}
    assert rows_of(changes.anchors(df)) == {k: v for k, v in want.items() if v}


def test_anchors_of_neighbours(spark):
    want = {d: plain_anchors(f"d/{d}", f"d/{o}", a, b) for d, o, a, b in neighbours()}
    assert rows_of(catalog.queries()["line_opcodes"](spark, SF)) == want and len(want) >= 5


def plain_base(path, text, tags, base):
    imported = re.findall(r"\b(?:from|import)\s+([A-Za-z_][A-Za-z0-9_\.]*)", text)
    define = re.compile(r"\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)")
    if path in base:
        return path
    for name in sorted(set(imported)):
        for end in (".py", "/__init__.py"):
            if name.replace(".", "/") + end in base:
                return name.replace(".", "/") + end
    derived = set()
    for group in re.findall(r"class\s+[A-Za-z_][A-Za-z0-9_]*\(([^)]*)\)", text):
        derived |= {x.strip().split("[")[0].split(".", 1)[-1] for x in group.split(",")}
    for name in sorted(x for x in derived if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", x)):
        at = [p for p, t in base.items() for s in define.findall(t) if s == name]
        if len(at) == 1:
            return at[0]

    def signature(p):
        p = P(p)
        return {x.lower() for x in p.parts if len(x) >= 3} | ({p.stem.lower()} if len(p.stem) >= 3 else set()) | ({p.suffix.lower()} if len(p.suffix) > 1 else set())

    words = {x.lower() for name in imported for x in [y for y in name.split(".") if y][-2:]}
    mine, best = signature(path) | {x.lower() for x in tags} | words, (4, "")
    for p in sorted(base):
        low = base[p].lower()
        if P(path).suffix and P(p).suffix.lower() != P(path).suffix.lower():
            continue
        score = 6 * (P(p).stem.lower() == P(path).stem.lower()) + 2 * len(mine & signature(p)) + sum(3 for x in tags if x and x.lower() in low)
        score += sum(2 for x in words if x in low) + sum(x in low for x in {s.lower() for s in define.findall(text)})
        if score > best[0]:
            best = score, p
    return best[1] or None


def test_base_matches(spark):
    rng = random.Random(9)
    names = ["model", "Loss", "utils", "io", "train", "adapter"]

    def path():
        folders = "".join(rng.choice(["src/", "lib/", "a/"]) for _ in range(rng.randint(0, 2)))
        return folders + rng.choice(names) + rng.choice([".py", ".py", ".md", ".PY", ""])

    def code():
        lines = [
            f"import {rng.choice(names)}.{rng.choice(names)}", f"from {rng.choice(['src', 'lib', 'x'])}.{rng.choice(names)} import y", f"class {rng.choice('ABC')}{rng.choice(names)}(m.{rng.choice('ABC')}{rng.choice(names)}[T], k=v, Z): pass",
            f"class {rng.choice('ABC')}{rng.choice(names)}: pass", f"def {rng.choice(names)}_step(x): pass", "# LoRA adapter loss",
        ]
        return "\n".join(rng.sample(lines, rng.randint(0, 4)))

    changed, base, want = [], [], {}
    for j in range(12):
        tree = {path(): code() for _ in range(rng.choice([0, 1, 6, 15]))}
        base += [(f"j{j}", p, t) for p, t in tree.items()]
        for p in {path() for _ in range(8)}:
            text, tags = code(), rng.sample(["adapter", "Loss", "rank"], rng.randint(0, 2))
            changed.append((f"j{j}", p, text, tags))
            want[f"j{j}", p] = plain_base(p, text, tags, tree)
    new = spark.createDataFrame(changed, "job string, path string, text string, tags array<string>")
    old = spark.createDataFrame(base, "job string, path string, text string")
    assert {(r.job, r.new_path): r.base_path for r in basefiles.base_matches(new, old).collect()} == want
    assert len(set(want.values())) > 10 and None in want.values()


@pytest.mark.parametrize("rare", [0, 2, 16])
def test_base_matches_by_classes_and_look_up(spark, rare):
    rng, words = random.Random(rare), ["model", "loss", "train", "io"]
    base = {f"{rng.choice(words)}/{rng.choice(words)}{k}.py": f"# {rng.choice(words)} {rng.choice(words)} net{k % 9}" for k in range(60)}
    changed = [(f"{rng.choice(words)}/{rng.choice(words)}{k}.py", f"def net{k % 12}(): pass", rng.sample(words, 2)) for k in range(100, 200)]
    changed += [(f"x/{P(p).name}", "def f(): pass", ["io"]) for p in list(base)[:20]]
    want = {p: plain_base(p, text, tags, base) for p, text, tags in changed}
    new = spark.createDataFrame([("j", *r) for r in changed], "job string, path string, text string, tags array<string>")
    old = spark.createDataFrame([("j", *r) for r in base.items()], "job string, path string, text string")
    assert {r.new_path: r.base_path for r in basefiles.base_matches(new, old, rare=rare).collect()} == want and len(set(want.values())) > 10


def test_base_matches_of_equal_paths(spark):
    """Two texts of one path are two files: their points don't add up, and their path is a file's own once."""
    old = [("j", "a/m.py", f"# loss {k}") for k in range(5)] + [("j", "b/n.py", "# loss adapter")]
    new = [("j", "c/new.py", "", ["loss", "adapter"]), ("j", "a/m.py", "", [])]
    got = basefiles.base_matches(spark.createDataFrame(new, "job string, path string, text string, tags array<string>"), spark.createDataFrame(old, "job string, path string, text string"))
    assert sorted((r.new_path, r.base_path) for r in got.collect()) == [("a/m.py", "a/m.py"), ("c/new.py", "b/n.py")]


def test_contained_words_in_parts(spark):
    texts = spark.createDataFrame([("a", "p", "one two three"), ("b", "q", "one"), ("b", "r", None)], "job string, path string, text string")
    words = spark.createDataFrame([("a", w) for w in ("one", "wo t", "four", "three", "e", "")] + [("b", "two"), ("b", "one")], "job string, word string")
    got = basefiles.contained_words(texts, words, per_automaton=2).collect()
    assert sorted(map(tuple, got)) == [("a", "p", "e"), ("a", "p", "one"), ("a", "p", "three"), ("a", "p", "wo t"), ("b", "q", "one")]


def plain_merge(primary, secondary):
    def union(a, b, n):
        return list(dict.fromkeys(a + b))[:n]

    kept = [dict(x) for x in primary]
    for x in secondary:
        hit = next((k for k in kept if len(set(k["keywords"]) & set(x["keywords"])) + len(k["words"] & x["words"]) >= 2), None)
        if hit is None:
            kept.append(dict(x))
            continue
        hit.update(keywords=union(hit["keywords"], x["keywords"], 6), hints=union(hit["hints"], x["hints"], 5), refs=union(hit["refs"], x["refs"], 4))
        hit.update(problem=hit["problem"] or x["problem"], baseline=hit["baseline"] or x["baseline"], level=max(hit["level"] or 1, x["level"] or 1))
    out = {}
    for x in kept:
        o = out.get(x["title"].lower())
        if o is None:
            out[x["title"].lower()] = x
        else:
            section = o["section"] if o["section"] != "Abstract" else x["section"]
            same = {"id": o["id"], "title": o["title"], "section": section, "keywords": union(o["keywords"], x["keywords"], 6), "hints": union(o["hints"], x["hints"], 4)}
            out[x["title"].lower()] = same | {"problem": None, "baseline": None, "refs": [], "level": None}
    return [(x["id"], x["title"], x["section"], x["keywords"], x["hints"], x["problem"], x["baseline"], x["refs"], x["level"]) for x in out.values()]


def merged_rows(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r[0], r.place)):
        out.setdefault(r[0], []).append((r.id, r.title, r.section, r.keywords, r.impl_hints, r.problem_solved, r.baseline_difference, r.evidence_refs, r.complexity))
    return out


def test_a_kept_item_grows(spark):
    """{b, c, d} is taken up although {a, b} alone shares one word with it: {a, b, c} came before."""
    schema = "job long, ord int, id string, title string, words array<string>, section string, keywords array<string>, impl_hints array<string>, problem_solved string, baseline_difference string, evidence_refs array<string>, complexity int"

    def row(n, keywords):
        return (1, n, f"c{n}", f"t{n}", [], "S", keywords, None, None, None, None, None)

    first = spark.createDataFrame([row(0, ["a", "b"])], schema)
    second = spark.createDataFrame([row(1, ["a", "b", "c"]), row(2, ["b", "c", "d"])], schema)
    assert [(r.id, r.keywords) for r in sequences.merge_sets(first, second, "job").collect()] == [("c0", ["a", "b", "c", "d"])]


def test_folded_sets(spark):
    def tokens(s):
        found = dict.fromkeys(w for w in re.findall(V.TOKEN, s.lower()) if w not in V.STOPWORDS and not w.isdigit())
        return list(found)

    sides = {}
    for conv, turn, role, text in sorted(table("conversations", "conv_id, turn, role, text")):
        for pos, s in enumerate(sentences(text)):
            w = tokens(s)
            x = {"id": f"{conv}-{turn}-{pos}", "title": s, "words": set(w), "section": "Abstract" if pos == 0 else f"Section {pos}", "keywords": w[:3], "hints": w[2:6]}
            x |= {"problem": s if len(s) > 60 else None, "baseline": s if len(s) <= 60 else None, "refs": [f"turn {turn}", f"place {pos}"], "level": len(s) % 5}
            sides.setdefault(conv, ([], []))[role != "user"].append(x)
    assert merged_rows(catalog.queries()["folded_sets"](spark, SF)) == {c: plain_merge(*x) for c, x in sides.items()}
    assert any(len(plain_merge(*x)) < len(x[0]) + len(x[1]) for x in sides.values())


def test_similar_files_by_job(spark):
    """Pairs of several jobs at once against all pairs, and fewer of them than there are."""
    rng = random.Random(21)
    words = ["alpha", "beta", "gamma", "delta", "x = 1", "\n", "Ω"]

    def tree(job, n):
        out = {}
        for k in range(n):
            name = rng.choice(["src/", "lib/core/", ""]) + rng.choice([f"m{k}", "model", "Util"]) + rng.choice([".py", ".py", ".md", ""])
            out[name] = None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 10, 60, 300])))
        return [(job, p, t) for p, t in out.items()]

    old = [r for j in "abc" for r in tree(j, 14)]
    new = [r for j in "abcd" for r in tree(j, 12)] + [("a", "kept/copy.py", old[0][2])]
    schema = "job string, path string, text string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)

    def words_of(p):
        return set(re.sub("[^a-z0-9]+", " ", p.lower()).split())

    want, every = {}, 0
    for job, p, t in new:
        for other, q, u in old:
            if job == other and P(p).suffix == P(q).suffix and t is not None and u is not None:
                every += 1
                bonus = min(0.05 * len(words_of(p) & words_of(q)), 0.2) + 0.12 * (P(p).stem.lower() == P(q).stem.lower())
                score = min(difflib.SequenceMatcher(None, u, t).ratio() + bonus, 1.0)
                if score >= 0.4 - 1e-12:
                    want[job, q, p] = score
    got = {(r.job, r.source, r.target): r.score for r in changes.same_extension_pairs(a, b, 0.4).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(want) > 10
    assert changes.comparable_pairs(a, b, 0.4).count() < 0.7 * every
    one = changes.map_files(a.where("job = 'b'").drop("job"), b.where("job = 'b'").drop("job"))
    jobs = changes.map_files(a, b).where("job = 'b'").drop("job")
    assert sorted(map(str, one.collect())) == sorted(map(str, jobs.collect()))


def test_lists_widen_as_needed(spark):
    """Targets that all want the same few sources, and many that do not: the plain choice, from few candidates."""
    rng, n, m = random.Random(2), 60, 150
    scores = {(i, j): rng.random() for i in range(n) for j in range(m)}
    for i in range(12):  # the same sources are best for the first targets
        scores |= {(i, j): 2.0 + (j % 4) / 10 for j in range(20)}
    ranked = {i: sorted(range(m), key=lambda j: (-scores[i, j], j)) for i in range(n)}
    free, want = set(range(m)), {}
    for i in range(n):
        want[i] = next(j for j in ranked[i] if j in free)
        free.discard(want[i])
    asked = []

    def best(k, targets):
        ids = range(n) if targets is None else sorted(r.target for r in targets.collect())
        asked.append(k * len(ids))
        return spark.createDataFrame([(i, j, scores[i, j]) for i in ids for j in ranked[i][:k]], "target long, source long, score double")

    got = {r.target: r.source for r in sequences.greedy_widened(best).collect()}
    assert got == want and sum(asked) < 12 * n < n * m / 5
    assert sequences.greedy_widened(lambda k, t: spark.createDataFrame([], "target long, source long, score double")).count() == 0


def test_bounded_links_meet_few_postings(spark, monkeypatch):
    """Each claim's best documents by full scoring, from far fewer rows of the postings than share a token."""
    from strandline.operators import impact
    from strandline.plans.registry import Tables
    from strandline.plans.review import claim_parts

    claims, passages = claim_parts(Tables(spark, SF.replace("0.001", "0.01")))
    claims = claims.withColumn("tags", pmod_tags("item_id")).withColumn("marker", pmod_tags("item_id") % 2)
    passages = passages.withColumn("tags", pmod_tags("doc_id")).withColumn("marker", pmod_tags("doc_id") % 2)
    index = impact.Passages(passages, claims)

    def best():
        out = {}
        for r in index.best(5).collect():
            out.setdefault(r.item_id, []).append((-r.score, -r.doc_id))
        return {k: sorted(v)[:5] for k, v in out.items()}

    want = best()
    monkeypatch.setattr(impact, "DIRECT_ROWS", 0)
    assert best() == want and len(want) == 40
    few = index.best(3, index.claims.where("item_id < 5").select("item_id"))
    assert {r.item_id for r in few.collect()} == set(range(5))
    made, shared = index.looked_up_rows(5), index.rows
    print("rows of the postings joined", made, "of", shared)
    assert made * 3 < shared


def pmod_tags(column):
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(column), F.lit(4)).cast("long")
