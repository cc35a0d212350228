"""Queries that SQL cannot express, against plain Python over the smallest tables."""

import difflib
import itertools
import re

import duckdb
import pytest

from strandline import catalog
from strandline.functions import fixed_values as V
from strandline.plans.review import SCORES
from tests.conftest import SF

Q = catalog.queries()


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def sentences(text):
    return [s for s in (x.strip(" \t\n\x0b\f\r") for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", text)) if s]


def neighbours():
    """(doc_id, old_id, old text, text) of neighbours of a source whose first sentences begin alike."""
    groups = {}
    for doc, source, text in sorted(table("documents", "doc_id, source, text")):
        first = (sentences(text) or [None])[0]
        groups.setdefault((source, first[:12] if first else None), []).append((doc, text))
    return [(b[0], a[0], a[1], b[1]) for g in groups.values() for a, b in itertools.pairwise(g)]


@pytest.fixture(scope="module")
def near():
    found = neighbours()
    assert len(found) >= 5
    return found


def test_char_ratio(spark, near):
    got = {(r.doc_id, r.old_id): r.ratio for r in Q["char_ratio"](spark, SF).collect()}
    assert got == pytest.approx({(d, o): difflib.SequenceMatcher(None, a, b).ratio() for d, o, a, b in near}, abs=1e-6)


def test_unified_diff(spark, near):
    """Hunks whose added and removed lines turn the old text into the new one, with the ranges of their heads."""
    want = []
    for doc, _, old, new in near:
        lines, number = list(difflib.unified_diff(old.split("\n"), new.split("\n"), n=3, lineterm=""))[2:], 0
        for line in lines:
            if line.startswith("@@"):
                number += 1
                cells = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line).groups()
                want.append([doc, number, *(int(c or 1) for c in cells), 0, 0])
            elif line[0] in "+-":
                want[-1][6 if line[0] == "+" else 7] += 1
    got = Q["unified_diff"](spark, SF).select("pair_id", "hunk", "old_start", "old_count", "new_start", "new_count", "added", "removed")
    assert sorted(map(list, got.collect())) == sorted(want)


def test_greedy_assignment(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    scores, used, want = {}, set(), []
    for item, doc, score in con.sql(SCORES).fetchall():
        scores.setdefault(item, []).append((-score, doc))
    for item in sorted(scores):
        free = [x for x in sorted(scores[item]) if x[1] not in used]
        if free:
            used.add(free[0][1])
            want.append((item, free[0][1], pytest.approx(-free[0][0])))
    got = sorted((r.item_id, r.doc_id, r.score) for r in Q["greedy_assignment"](spark, SF).collect())
    assert got == want and len(want) > 10


def tokens(s):
    return {w for w in re.findall(V.TOKEN, s.lower()) if w not in V.STOPWORDS and not w.isdigit()}


def test_synthesised_contributions(spark):
    """Clusters in order of the findings; ranked by summed scores and kinds, led by the best finding."""
    items, want = {}, []
    for conv, turn, text in sorted(table("conversations", "conv_id, turn, text")):
        kind = ("contributions", "method", "abstract")[turn % 3]
        items.setdefault(conv, []).extend((4 + len(s) % 5, kind, s, tokens(s)) for s in sentences(text))
    for conv, rows in items.items():
        clusters = []
        for row in rows:
            best = max(clusters, key=lambda c: len(c[0] & row[3]), default=None)
            if best is None or len(best[0] & row[3]) < 2:
                clusters.append(best := (set(), []))
            best[0].update(row[3])
            best[1].append(row)
        ranked = sorted(clusters, key=lambda c: (-sum(r[0] for r in c[1]) - len({r[1] for r in c[1]}), -len(c[1])))
        for k, (words, own) in enumerate(ranked[:5]):
            lead = max(own, key=lambda r: (r[0], r[1] == "contributions", r[1] == "method", len(r[2])))
            if len(words) >= 2:
                want.append((str(conv), k, sum(r[0] for r in own), len(own), lead[2], " ".join(sorted(words)[:6])))
    assert sorted(map(tuple, Q["synthesised_contributions"](spark, SF).collect())) == sorted(want) and want


def test_assigned_clusters(spark):
    scores, want = {}, []
    for order, supp, part, quantity in table("lineitem", "l_orderkey, l_suppkey, l_partkey, l_quantity"):
        row = scores.setdefault(order % 500, {}).setdefault(f"{supp % 12:02d}", {})
        row[f"C{part % 7}"] = max(row.get(f"C{part % 7}", 0), int(quantity % 4))
    for job, clusters in scores.items():
        used = set()
        for cluster in sorted(clusters):
            able = [(s, c not in used, c) for c, s in clusters[cluster].items() if s > 0]
            if able:
                s, _, c = max(able)
                used.add(c)
                want.append((str(job), cluster, c, s))
    assert sorted(map(tuple, Q["assigned_clusters"](spark, SF).collect())) == sorted(want) and len(want) > 100


def test_build_lock(spark, tmp_path):
    """One holder at a time; a lock is given back, an expired one is taken over, and its late owner leaves the new one."""
    from strandline.sources.locks import build_lock

    folder = str(tmp_path / "locks")
    with build_lock(spark, folder, "k") as first, build_lock(spark, folder, "k") as second, build_lock(spark, folder, "other") as third:
        assert (first, second, third) == (True, False, True)
    with build_lock(spark, folder, "k") as again:
        assert again
        with build_lock(spark, folder, "k", lifetime=-5) as taker:
            assert taker
            with build_lock(spark, folder, "k") as late:
                assert not late
        assert not (tmp_path / "locks" / "k.lock").exists()


def test_leader_clustering(spark):
    turns, want = {}, []
    for conv, turn, text in sorted(table("conversations", "conv_id, turn, text")):
        turns.setdefault(conv, []).extend((turn * 100_000 + k, tokens(s)) for k, s in enumerate(sentences(text)))
    for conv, items in turns.items():
        clusters = []
        for place, mine in items:
            shared = [len(mine & c[0]) for c in clusters]
            if clusters and max(shared) >= 2:
                best = clusters[shared.index(max(shared))]
                best[0] |= mine
                best[1] += 1
            else:
                clusters.append([set(mine), 1, place])
        want += [(conv, k, n, first) for k, (_, n, first) in enumerate(clusters)]
    assert sorted(map(tuple, Q["leader_clustering"](spark, SF).collect())) == sorted(want)


def test_batch_pack(spark):
    turns, want = {}, []
    for conv, _, text in sorted(table("conversations", "conv_id, turn, text")):
        turns.setdefault(conv, []).append(len(text[: V.PARSE_SECTION_CHARS]))
    for conv, sizes in turns.items():
        batches = [[]]
        for n in sizes:
            if batches[-1] and (len(batches[-1]) >= V.PARSE_SECTIONS or sum(batches[-1]) + n > V.PARSE_TOTAL_CHARS):
                batches.append([])
            batches[-1].append(n)
        want += [(conv, k, len(b), sum(b)) for k, b in enumerate(batches[: V.PARSE_BATCHES])]
    assert sorted(map(tuple, Q["batch_pack"](spark, SF).collect())) == sorted(want)
