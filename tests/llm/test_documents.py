"""Brute force and awkward rows for the operators on documents."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import kn_quality, mixing, near_dedup, sp_sampling, token_counts, unigram
from strandline.llm import substring_dedup as substring
from strandline.llm.line_dedup import line_dedup
from strandline.llm.quality_rules import quality_filter, quality_rules
from strandline.llm.substring_dedup import substring_dedup
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_texts(seed, n, words=14, size=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, size))) for _ in range(n)]
    out += [out[k] for k in (0, 1, 2)] + [out[3] + " tail", "pre " + out[4]]
    shared = " ".join(f"s{i}" for i in range(30))
    return out + [f"{t} {shared} {t}" for t in out[5:12]] + [shared]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("window", [1, 2, 5, 20])
def test_substring_dedup(spark, window):
    texts = make_texts(window, 40, words=4 if window == 5 else 14)
    seen, want = set(), []
    for i, t in enumerate(texts):
        w, gone = WORD.findall(t), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup(docs(spark, texts), window).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("window", [2, 5])
def test_substring_repeats(spark, window):
    """Each repeat is the same words at its source, begins earlier, and can be continued at neither end."""
    texts = make_texts(window + 20, 30, words=5)
    words = {i: WORD.findall(t) for i, t in enumerate(texts)}
    first = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    for r in substring_dedup(docs(spark, texts), window).collect():
        w, covered = words[r.doc_id], set()
        for x in r.repeats:
            own, there = range(x.start, x.start + x.length), words[x.source]
            assert [w[k] for k in own] == there[x.source_start : x.source_start + x.length] and (x.source, x.source_start) < (r.doc_id, x.start)
            places = {s: first[tuple(w[s : s + window])] for s in range(len(w) - window + 1)}
            diagonal = lambda s: places.get(s) == (x.source, x.source_start + s - x.start)
            assert all(map(diagonal, range(x.start, x.start + x.length - window + 1)))
            assert not diagonal(x.start - 1) and not diagonal(x.start + x.length - window + 1)
            covered |= set(own)
        assert len(covered) == r.n_removed and r.n_repeats == len(r.repeats)
        assert r.longest_repeat == max([x.length for x in r.repeats], default=0)


def test_equal_hashes_of_different_windows_stay_apart():
    h, second = np.array([7, 7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 2, 1], np.uint32)
    assert substring._first_of(h, second).tolist() == [0, 1, 0, 1, 4]


def test_substring_shared_ids_and_clashing_names(spark):
    """Rows of one doc_id with different texts are documents in order of text; extra columns change nothing."""
    rows = [(1, "b a b c d e", 5, "x", b"z"), (1, "a b c d e f", 5, "x", b"z"), (0, "q r s t", 5, "x", b"z"), (2, "c d e f", 5, "x", b"z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int, bucket string, docs binary")
    got = sorted(tuple(r) for r in substring_dedup(df, 3).select("doc_id", "n_words", "n_removed", "kept_text", "n_repeats").collect())
    assert got == [(0, 4, 0, "q r s t", 0), (1, 6, 0, "a b c d e f", 0), (1, 6, 5, "b", 1), (2, 4, 4, "", 1)]
    assert substring_dedup(df.withColumn("doc_id", F.col("doc_id").cast("string")), 3).count() == 4


def test_substring_dedup_awkward(spark):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(edge.table(spark), 5).collect()}
    assert (1, 0, 0) in got and (2, 0, 0) in got and (6, 0, 0) in got and (None, 3, 0) in got
    assert (3, 14, 0) in got and (3, 14, 14) in got  # the second of two equal rows goes
    assert (5, 24000, 23993) in got or (5, 24000, 23992) in got
    assert substring_dedup(edge.empty(spark)).count() == 0


def test_line_dedup_awkward_and_first(spark):
    out = line_dedup(edge.table(spark), min_docs=2, columns=("lang", "source")).collect()
    assert len(out) == len(edge.ROWS)
    by = {(r.doc_id, r.n_lines, r.n_dropped) for r in out}
    assert (1, 1, 0) in by and (2, 1, 0) in by and (6, 2, 0) in by
    lines = docs(spark, ["a\nb", "A \nc", "a"])
    got = {r.doc_id: r.kept_text for r in line_dedup(lines, min_docs=2, keep_first=True).collect()}
    assert got == {0: "a\nb", 1: "c", 2: ""}
    assert line_dedup(edge.empty(spark)).count() == 0


def test_line_dedup_many_lines(spark):
    texts = ["\n".join(f"{'common' if k % 7 == 0 else f'd{d}'} {k}" for k in range(300)) for d in range(12)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs(spark, texts)).collect()}
    for d in range(12):
        assert got[d] == (300, 43, "\n".join(f"d{d} {k}" for k in range(300) if k % 7))


def test_line_dedup_counts_ids(spark):
    """Rows that share a doc_id, null or not, are one document for the count, whatever their texts."""
    rows = [(1, f"same\nown {i}") for i in range(10)] + [(None, f"null\nown {i}") for i in range(10)]
    rows += [(100 + i % 9, f"nine\nown {i}") for i in range(20)] + [(200 + i, f"ten\nown {i}") for i in range(10)] + [(200, "ten\nmore")]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    gone = collections.Counter(r.doc_id for r in out if r.n_dropped)
    assert gone == {**{200 + i: 1 for i in range(1, 10)}, 200: 2} and len(out) == len(rows)


def test_quality_rules_awkward(spark):
    out = quality_rules(edge.table(spark)).collect()
    assert len(out) == len(edge.ROWS) and set(out[0].asDict()) >= {"doc_id", "kept", "base_failed"}
    by = {r.doc_id: r for r in out}
    assert by[1].base_failed and by[2].n_words == 0 and by[6].base_failed
    assert by[5].n_words == 24000 and by[5].n_repeat_words == 24000 and not by[5].kept
    assert quality_filter(edge.table(spark)).columns == edge.table(spark).columns
    assert quality_rules(edge.empty(spark)).count() == 0


def test_quality_rules_by_language(spark):
    """Stop words are the row's language's, in lower case or capitalised; a language without a list skips the rule."""
    english, other = "The king and the queen went to a house by the sea in summer, as they had it in mind for this year.", "ord " * 3
    words = " ".join(f"ukendt{i}" for i in range(25))
    rows = [(1, english, "en"), (2, english, "de"), (3, words, "en"), (4, words, "da"), (5, words, None), (6, english.replace(" a ", " the ").upper(), "en"), (7, other, "da")]
    rows += [(8, "\n".join(f"{w}{k}" for k in range(20) for w in ("the", "of")), "da")]  # a page of single words
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_stop_words, r.kept) for r in quality_rules(df).collect()}
    assert got[1][1] and got[1][0] >= 9 and not got[2][1] and got[3] == (0, False) and got[4] == got[5] == (None, True)
    assert got[6] == (0, False) and not got[7][1] and not got[8][1]
    assert sorted(r.doc_id for r in quality_filter(df).collect()) == [1, 4, 5]
    assert quality_rules(df.drop("lang")).where("n_stop_words is not null").count() == 0


def test_quality_filter_measures_once(spark):
    """The filter stays above the measures, so the plan does not write them out again inside it."""
    plan = quality_filter(edge.table(spark))._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter " in x]
    assert len(filters) == 1 and "split(" not in filters[0] and "transform(" not in filters[0]


def brute_near(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(AZ))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a & sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family(seed, n, length, edits):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 8)
    texts = family(seed, 60, 60, 6) + family(seed + 9, 30, 8, 1) + make_texts(seed, 30) + [None, "", "A b", "a  B", "a"]
    got = near_dedup.near_components(docs(spark, texts), 80, 4).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_near(texts, 4, 80)


def test_near_components_of_large_groups(spark, monkeypatch):
    """Groups over many blocks: copies of several bases, chains across bases, and rows that only an edge row links."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 3)
    texts = [t for seed in (3, 4) for t in family(seed, 50, 40, 5)]
    base = [f"c{i}" for i in range(60)]
    for k in range(25):  # each is linked with its neighbours only
        texts.append(" ".join(base[: 60 - 2 * k] + [f"d{i}" for i in range(2 * k)]))
    random.Random(7).shuffle(texts)
    got = near_dedup.near_components(docs(spark, texts), 80, 4).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_near(texts, 4, 80)


def test_open_rows_meet_all_blocks(spark, monkeypatch):
    """Even if a block's walk finds nothing, what is left apart is compared across all blocks of a key."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2**62, (40, 8))
    sig[20:] = sig[:20]  # row i is linked with row i + 20 only
    rows = spark.createDataFrame([(i, 1, 0, s.tolist()) for i, s in enumerate(sig)], "node long, band long, n int, sig array<long>")
    out = near_dedup._joined(rows, "band", 5, 1, 1, near_dedup._estimates(100), F.lit(16)).collect()
    assert sorted(map(tuple, out)) == [(i + 20, i) for i in range(20)]


def test_near_awkward(spark):
    got = near_dedup.near_components(edge.table(spark)).collect()
    assert len(got) == len(edge.ROWS)
    assert {(r.doc_id, r.component_id) for r in got} >= {(1, 1), (2, 2), (3, 3), (4, 3), (None, None), (6, 6)}
    kept = near_dedup.near_dedup(edge.table(spark))
    assert kept.columns == edge.table(spark).columns and kept.count() == len(edge.ROWS) - 1
    assert near_dedup.near_components(edge.empty(spark)).count() == 0


def test_b_bit_estimate():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8):
        est = []
        for _ in range(40):
            both, own = rng.integers(0, 2**64, int(300 * j), np.uint64), int(300 * (1 - j) / 2)
            a, b = (np.concatenate([both, rng.integers(0, 2**64, own, np.uint64)]) for _ in range(2))
            low = [near_dedup.minima(x) & 15 for x in (a, b)]
            est.append(((low[0] == low[1]).mean() - 1 / 16) / (15 / 16))
        assert abs(np.mean(est) - j) < 0.05


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 20, 50, 400])), rng.choice(["a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).collect()
    assert len(out) == 3000 and all(r.taken == r.copies * r.size and r.copies <= 3 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()))
    for s in ("sa", "sb", "sc", "n"):
        own = [r for r in out if r.source_key == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.008 * own[0].target  # there are few sizes
        assert sum(r.size for r in own) == own[0].source_size
        expected = sum(own[0].target / own[0].source_size for _ in own)
        assert abs(sum(r.copies for r in own) - expected) < 15


def test_mixing_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = spark.createDataFrame([(i, "w " * (1 + i * 37 % 50), "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(df).collect()
    for s in ("sa", "sb"):
        own = [r for r in out if r.source_key == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.002 * own[0].target


def test_targets_stop_and_reshare(spark):
    df = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 5)], "source_key string, size long")
    got = {r.source_key: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx({"sa": 30.0, "sb": 970.0, "sc": 15.0})


def test_targets_against_brute_force(spark):
    """Sources by code point, null last; filled sources are set aside one by one."""
    rng = random.Random(2)
    for n in (1, 4, 23):
        rows = [(f"s{chr(65 + i % 26)}{i}" if i else "n", rng.choice([0, 1, 7, 100, 10**6])) for i in range(n)]
        open_, want = {k: (5, 2, 1)[i % 3] for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[0] == "n", r[0])))}, {}
        left = sum(v for _, v in rows)
        while open_:
            share = left / sum(open_.values())
            full = [k for k in open_ if 3 * dict(rows)[k] < share * open_[k] - 1e-9]
            for k in full or list(open_):
                want[k] = 3.0 * dict(rows)[k] if full else share * open_[k]
                left -= want[k] if full else 0
                del open_[k]
        got = {r.source_key: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source_key string, size long")).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_inclusion_probabilities_hold():
    """Over many seeds each document is taken as often as its probability says, and words come near their expectation."""
    size, turns = np.array([0, 3, 10, 40, 45, 80, 90, 100, 120, 150, 180, 200, 220, 260, 300, 380, 400, 500, 900.0] * 4), 1500
    size.sort()
    p, taken, off = np.linspace(0.15, 0.85, len(size)), np.zeros(len(size)), []
    for k in range(turns):
        rng = np.random.default_rng([k, 11])
        flown = mixing.flight(p, size, rng, hold=True)
        assert ((flown > 0) & (flown < 1)).sum() <= mixing.OPEN + 2
        assert abs(flown @ size - p @ size) < 1e-6 and abs(flown.sum() - p.sum()) < 1e-6
        q = mixing.landing(flown, size, rng, float(p @ size))
        taken += q
        off.append(abs(q @ size - p @ size) / (p @ size))
    assert np.abs(taken / turns - p).max() < 4.5 * math.sqrt(0.25 / turns) and np.mean(off) < 0.003


def test_few_documents_are_a_landing_problem():
    """No flight for what the landing decides together; one document more, and some fly."""
    rng = np.random.default_rng(1)
    for n in (1, 8, mixing.OPEN + 2, mixing.OPEN + 3, 40):
        p = mixing.flight(np.full(n, 0.4), np.arange(n) * 7.0, rng, hold=True)
        settled = n - ((p > 0) & (p < 1)).sum()
        assert settled == 0 if n <= mixing.OPEN + 2 else settled >= 1


def test_landing_law_keeps_probabilities():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9, 14):
        p, size = rng.random(n) * 0.98 + 0.01, rng.integers(0, 500, n).astype(float)
        subsets, law = mixing.landing_law(p, size, 1.0, 1e9)
        assert law.sum() == pytest.approx(1) and law @ subsets == pytest.approx(p, abs=1e-9) and (law >= 0).all()
    near, law = mixing.landing_law(np.full(3, 0.5), np.array([10.0, 10, 20]), 20.0)
    assert law @ np.abs(near @ [10, 10, 20] - 20) == pytest.approx(0) and law @ near == pytest.approx(np.full(3, 0.5))


def test_mixing_documents_rerun(spark):
    """Rows equal in id, source and text are told apart by their other columns, so reruns agree; null and tied ids too."""
    rows = [(i % 3 or None, "w " * (5 + i % 4), "ab"[i % 2], str(i), i) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, copies int")
    once, again = (sorted(map(str, mixing.mix_documents(x).collect())) for x in (df, df.repartition(6, "lang")))
    assert once == again
    assert len(once) == sum(r.copies for r in mixing.mix_sources(df).collect())


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    q = mixing.flight(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-3


def test_mixing_awkward(spark):
    out = mixing.mix_sources(edge.table(spark)).collect()
    assert len(out) == len(edge.ROWS)
    mixed = mixing.mix_documents(edge.table(spark))
    assert mixed.columns == edge.table(spark).columns
    assert mixed.count() == sum(r.copies for r in out)
    assert mixing.mix_sources(edge.empty(spark)).count() == 0


@pytest.fixture(scope="module")
def vocab():
    return unigram.Vocabulary.from_file(token_counts.PIECES)


def segmentations(word, vocab):
    """All segmentations of a pre-token with their log-probabilities."""
    known = {vocab.bytes[i].decode("utf-8", "replace").replace(" ", unigram.SPACE): (int(i), vocab.logp[i]) for i in vocab.ids}
    out = [((), 0.0)] if not word else []
    for k in range(1, len(word) + 1):
        piece = word[:k]
        if piece in known:
            head, lp = (known[piece][0],), known[piece][1]
        elif k == 1:
            raw = piece.encode()
            head, lp = tuple(int(vocab.byte_ids[b]) for b in raw), len(raw) * vocab.byte_logp
        else:
            continue
        out += [(head + ids, lp + rest) for ids, rest in segmentations(word[k:], vocab)]
    return out


def test_sampling_is_exact(vocab):
    text, n, k = "is a", 4000, 3
    words = unigram.pretokens(text)
    whole = [((), 0.0)]
    for w in words:
        whole = [(a + b, x + y) for a, x in whole for b, y in segmentations(w, vocab)]
    total = math.log(sum(math.exp(x) for _, x in whole))
    p = {ids: x - total for ids, x in whole}
    found = collections.defaultdict(list)
    for r, _, ids, lp, g, inc in sp_sampling.sample_texts([text] * n, sp_sampling.row_keys(range(n), 3), vocab, k):
        assert lp == pytest.approx(p[tuple(ids.tolist())], abs=1e-9)
        found[r].append((tuple(ids.tolist()), g, inc))
    first = collections.Counter(v[0][0] for v in found.values())
    for v in found.values():
        assert len({x[0] for x in v}) == min(k, len(p)) == len(v) and [x[1] for x in v] == sorted((x[1] for x in v), reverse=True)
    for ids, x in p.items():
        assert abs(first[ids] / n - math.exp(x)) < 5 * math.sqrt(math.exp(x) / n) + 1e-3


def test_sampling_all_segmentations(vocab):
    every = {ids for ids, _ in segmentations("▁the", vocab)}
    got = list(sp_sampling.sample_texts(["the"], sp_sampling.row_keys([1], 1), vocab, len(every) + 5))
    assert {tuple(x[2].tolist()) for x in got} == every and all(x[5] == 1.0 for x in got)


def test_sampling_round_trip_and_awkward(spark):
    out = sp_sampling.sample_encode(edge.table(spark), samples=2)
    back = sp_sampling.decode(out).collect()
    texts = collections.defaultdict(set)
    for i, t, *_ in edge.ROWS:
        texts[i].add(t or "")
    assert back and all(r.decoded_text in texts[r.doc_id] for r in back)
    again = sp_sampling.sample_encode(edge.table(spark).repartition(5), samples=2)
    key = lambda r: (str(r.doc_id), r.sample, tuple(r.ids))
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))
    assert all(r.decoded for r in sp_sampling.sample_digest(edge.table(spark)).collect())
    assert sp_sampling.sample_encode(edge.empty(spark)).count() == 0


def words_of(text):
    """Pre-tokens, written down anew: a space begins one, a newline is one."""
    return re.findall("\n|▁[^▁\n]*|[^▁\n]+", "▁" + text.replace("▁", unigram.HELD).replace(" ", "▁")) if text else []


def known_pieces(vocab):
    return {vocab.bytes[i].decode("utf-8", "replace").replace(" ", unigram.SPACE): vocab.logp[i] for i in vocab.ids}


def edges(word, i, known, vocab):
    """(begin, log-probability, tokens) of the pieces that end at place i of a whole pre-token."""
    for j in range(max(0, i - 40), i):
        piece = word[j:i]
        if piece in known:
            yield j, known[piece], 1
        elif len(piece) == 1:
            size = len(piece.replace(unigram.HELD, unigram.SPACE).encode())
            yield j, size * vocab.byte_logp, size


def long_words():
    """Pre-tokens of 65 to 5,000 code points: addresses, encoded bytes, repeats, text without spaces."""
    rng = random.Random(64)
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    out = ["international" * 8, "a" * 65, "the" * 700, "日本語テキスト" * 150, "x" * 63 + "é😀" * 40]
    out += ["https://example.org/" + "".join(rng.choice(mixed) for _ in range(n)) for n in (45, 46, 200, 5000)]
    return out + ["internationalisation" * 60 + " " + "-" * 300 + "\n" + "=" * 129]


def test_token_counts(spark, vocab):
    known = known_pieces(vocab)

    def best(word):
        table = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            score, n = max((table[j][0] + lp, table[j][1] - k) for j, lp, k in edges(word, i, known, vocab))
            table.append((score, n))
        return -table[-1][1]

    texts = [None, "", " ", "  two  spaces ", "a" * 150, "▁ ▁x", "日本語😀 foo\n\n bar\t", "The quick brown fox", *long_words()]
    n, k = token_counts.count_texts(texts, vocab)
    assert n.tolist() == [sum(map(best, words_of(t))) for t in texts]
    assert k.tolist() == [len(words_of(t)) for t in texts]
    assert [x.tolist() for x in token_counts.count_texts(texts, vocab, most=100)] == [n.tolist(), k.tolist()]
    out = token_counts.token_counts(edge.table(spark)).collect()
    assert len(out) == len(edge.ROWS) and {(r.doc_id, r.n_tokens) for r in out} >= {(1, 0), (2, 0)}
    assert token_counts.token_counts(edge.empty(spark)).count() == 0


def test_sampling_long_words(vocab):
    """Whole pre-tokens: distinct decodable samples, whose probabilities are over the sum of all segmentations."""
    known, texts = known_pieces(vocab), long_words()

    def total(word):
        table = [0.0]
        for i in range(1, len(word) + 1):
            x = [table[j] + lp for j, lp, _ in edges(word, i, known, vocab)]
            table.append(max(x) + math.log(sum(math.exp(v - max(x)) for v in x)))
        return table[-1]

    def logp(i):
        return vocab.logp[i] if i not in set(vocab.byte_ids.tolist()) else vocab.byte_logp

    found, likely = collections.defaultdict(list), collections.Counter()
    for r, _, ids, lp, _, _ in sp_sampling.sample_texts(texts, sp_sampling.row_keys(range(len(texts)), 3), vocab, 3, at_once=2000):
        assert vocab.decode(ids.tolist()) == texts[r]
        assert lp == pytest.approx(sum(map(logp, ids.tolist())) - sum(map(total, words_of(texts[r]))), abs=1e-6)
        found[r].append(tuple(ids.tolist()))
    assert all(len(set(x)) == len(x) for x in found.values()) and len(found) == len(texts)
    n = 3000  # a piece across the 64th code point occurs as often as its probability says
    word = "▁" + "international" * 6
    back = [0.0]
    for i in range(1, len(word) + 1):
        x = [back[j] + lp for j, lp, _ in edges(word, i, known, vocab)]
        back.append(max(x) + math.log(sum(math.exp(v - max(x)) for v in x)))
    ahead = {len(word): 0.0}
    for j in range(len(word) - 1, -1, -1):
        x = [ahead[i] + lp for i in range(j + 1, min(len(word), j + 40) + 1) for b, lp, _ in edges(word, i, known, vocab) if b == j]
        ahead[j] = max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    across = sum(math.exp(back[j] + known[word[j:i]] + ahead[i] - back[-1]) for j in range(40, 64) for i in range(65, len(word) + 1) if word[j:i] in known)
    assert 0.01 < across < 0.9999
    for _, _, ids, *_ in sp_sampling.sample_texts([word[1:]] * n, sp_sampling.row_keys(range(n), 5), vocab, 1):
        ends = np.cumsum([len(vocab.bytes[i]) for i in ids.tolist()])
        likely[bool(64 not in ends)] += 1
    assert abs(likely[True] / n - across) < 5 * math.sqrt(across * (1 - across) / n) + 1e-3


def test_kneser_ney_probabilities(spark):
    counts = collections.Counter()
    text = "aababbabaaabbabababbbaabcabbaacbb"
    for i in range(len(text) - 3):
        counts[text[i : i + 4]] += 1
    grams = [(a + b + c + d, counts[a + b + c + d]) for a in "abc" for b in "abc" for c in "abc" for d in "abc"]
    got = {r.gram: math.exp(r.logp) for r in kn_quality.probabilities(spark.createDataFrame(grams, "gram string, c long")).collect()}

    def tables(c):
        while True:
            yield c
            lower = collections.Counter()
            for g, n in c.items():
                if n > 0:
                    lower[g[1:]] += 1
            c = lower

    def discounts(c):
        n = collections.Counter(v for v in c.values() if v > 0)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y else 0.5 for k in (1, 2, 3)]
        return [0.0] + [min(max(d, 0.05), float(k)) for k, d in enumerate(raw, 1)]

    source = tables(counts)
    by_order = {n: next(source) for n in (4, 3, 2, 1)}

    def p(g):
        if not g:
            return 1 / 4
        c = by_order[len(g)]
        d = discounts(c)
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1] and v > 0}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        own = c[g] if c[g] > 0 else 0
        return max(own - d[min(own, 3)], 0) / total + sum(d[min(v, 3)] for v in same.values()) / total * p(g[1:])

    for g, x in got.items():
        assert x == pytest.approx(p(g), rel=1e-9)


def kn_tables(train, every):
    """Character n-gram probabilities, written down anew: p(gram) for the n-grams of `every` by the counts in `train`."""
    pad = lambda t: "\x02\x02\x02" + t + "\x03"
    by_order = {4: collections.Counter(g for t in train for g in map("".join, zip(*(pad(t)[k:] for k in range(4)))))}
    for n in (3, 2, 1):
        by_order[n] = collections.Counter(g[1:] for g in by_order[n + 1])
    chars = {pad(t)[k] for t in every for k in range(3, len(t) + 4)}
    d, sums = {}, {}
    for n, c in by_order.items():
        m = collections.Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0.0
        d[n] = [0.0] + [min(max(k - (k + 1) * y * m[k + 1] / m[k] if m[k] and y else 0.5, 0.05), float(k)) for k in (1, 2, 3)]
        sums[n] = collections.defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            sums[n][g[:-1]][0] += v
            sums[n][g[:-1]][1] += d[n][min(v, 3)]

    def p(g):
        if not g:
            return 1 / (len(chars) + 1)
        n = len(g)
        if g[:-1] not in sums[n]:
            return p(g[1:])
        total, taken = sums[n][g[:-1]]
        v = by_order[n][g]
        return max(v - d[n][min(v, 3)], 0) / total + taken / total * p(g[1:])

    return lambda t: [p(pad(t)[k : k + 4]) for k in range(len(t) + 1)]


def test_kn_quality_against_brute_force(spark):
    """Perplexity, shrinkage, thresholds and verdicts of whole documents, with ties, repeats and clashing columns."""
    rng = random.Random(8)
    common = ["the cat sat on the mat", "a dog ran in the park", "die katze sitzt da", "der hund lief weg"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(1, 6))), ["en", "de", None][i % 3]) for i in range(120)]
    rows += [(200 + i, "".join(rng.choice("xqzjk#") for _ in range(30)), "en") for i in range(12)]
    rows += [(300 + i, "the cat sat on the mat", "en") for i in range(10)] + [(400, None, "en"), (401, "", "de"), (0, rows[0][1], "en"), (None, "a dog", "fr")]
    good = [(i, 1) for i, *_ in rows if i is not None and (i < 120 and i % 2 == 0 or 300 <= i < 310)]
    labels = [*good, (1, 0), (2, 0), (200, 0), (None, 1), (400, 1)]
    df = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, text string, lang string, grp string, held boolean, z int")
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(5)) == 0
    held = {r.doc_id: r.h for r in df.select("doc_id", fold.alias("h")).collect()}
    trusted = {i for i, q in labels if q == 1} - {i for i, q in labels if q != 1} - {None}
    train = [t for i, t, _ in rows if i in trusted and not held[i] and t]
    logs = kn_tables(train, [t or "" for _, t, _ in rows])
    loss = [(-sum(map(math.log, logs(t))) / (len(t) + 1), len(t) + 1) if t else None for _, t, _ in rows]
    own = [k for k, (i, t, _) in enumerate(rows) if i in trusted and held[i] and t]
    mean = sum(loss[k][0] * loss[k][1] for k in own) / sum(loss[k][1] for k in own)
    score = [x and (x[0] * x[1] + mean * kn_quality.PRIOR) / (x[1] + kn_quality.PRIOR) for x in loss]
    by = collections.defaultdict(list)
    for k in own:
        by[rows[k][2]].append(score[k])

    def at(x):
        return sorted(x)[math.ceil(0.99 * len(x)) - 1]

    overall = at([v for x in by.values() for v in x])
    limit = {g: (at(x) * len(x) + overall * kn_quality.PRIOR_HELD) / (len(x) + kn_quality.PRIOR_HELD) for g, x in by.items()}
    assert len(by) == 3 and own
    want = []
    for (i, _, g), x, s in zip(rows, loss, score):
        edge_of = limit.get(g, overall)
        want.append((str(i), x and math.exp(x[0]), s and math.exp(s), math.exp(edge_of), bool(x) and s <= edge_of + 1e-12))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    got = kn_quality.kn_quality(df, labelled).select("doc_id", "perplexity", "shrunk_perplexity", "threshold", "kept").collect()
    key = lambda r: (r[0], round(r[1] or 0, 6))
    want, got = sorted(want, key=key), sorted(((str(r[0]), *r[1:]) for r in got), key=key)
    assert len(got) == len(want) and any(not r[4] for r in want) and any(r[4] for r in want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[4] == w[4] and g[3] == pytest.approx(w[3], rel=1e-6), (g, w)
        assert (g[1] is None) == (w[1] is None) and (w[1] is None or (g[1], g[2]) == pytest.approx((w[1], w[2]), rel=1e-6))


def test_kn_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd, even = labels.where("doc_id % 2 = 1"), labels.where("doc_id % 2 = 0")
    got = kn_quality.kn_quality(d, odd).join(even, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r.quality: r.k for r in got}
    assert rate[1] >= 0.9 and rate[0] <= 0.2


def test_kn_threshold_of_rare_languages(spark):
    """Each language's own quantile counts at every number of held-out documents, few or many."""
    folder = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(5)) == 0
    out = kn_quality.kn_quality(d, labels).join(d.select("doc_id", "lang"), "doc_id")
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = 1 and b = 1").select("doc_id")
    rows = out.join(trusted.withColumn("t", held), "doc_id", "left").select("lang", "t", "shrunk_perplexity", "threshold").collect()
    scores, found = collections.defaultdict(list), {}
    for r in rows:
        found[r.lang] = math.log(r.threshold)
        if r.t and r.shrunk_perplexity:
            scores[r.lang].append(math.log(r.shrunk_perplexity))

    def at(x):
        return sorted(x)[math.ceil(0.99 * len(x)) - 1]

    overall = at([v for x in scores.values() for v in x])
    assert min(len(x) for x in scores.values()) < 50
    for lang, x in scores.items():
        assert found[lang] == pytest.approx((at(x) * len(x) + overall * kn_quality.PRIOR_HELD) / (len(x) + kn_quality.PRIOR_HELD), abs=1e-6)


def test_kn_awkward(spark):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (3, 1, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = kn_quality.kn_quality(edge.table(spark), labels).collect()
    assert len(out) == len(edge.ROWS)
    assert {(r.doc_id, r.kept) for r in out} >= {(1, False), (2, False)}
    assert kn_quality.kn_quality(edge.empty(spark), labels).count() == 0
