"""Phrase collocations, main text of pages and alignment of two tokenizers against plain models, and on awkward rows."""

import bisect
import collections
import random
import re
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import alignment, collocations
from strandline.llm.html_extract import extract_pages, main_text, smoothed, threshold
from strandline.llm.queries import OP12_SQL
from tests.llm import edge

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Phrases.


def plain_phrases(rows, longest, min_count, cover, top):
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            around = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= cover * a for b in around):
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "x y", "a-b", "ÄÖ", "w1", "w2", "w3", "<|nl|>"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? ", "\x0b"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "", "und"]), rng.choice([text, text, text, None, ""])))
    return rows + rows[:10]


@pytest.mark.parametrize("longest,cover,top", [(2, 50, 2000), (3, 50, 2000), (3, 90, 7), (4, 50, 2000)])
def test_collocations(spark, longest, cover, top):
    rows = some_texts(longest + cover)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, f int").repartition(3)
    got = collocations.collocations(df, longest=longest, min_count=3, cover=cover, top=top, batch_bytes=700)
    want = plain_phrases(rows, longest, 3, cover, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 15


def test_collocations_edges(spark):
    assert collocations.collocations(edge.empty(spark)).count() == 0
    rows = [(r[2], r[1]) for r in edge.ROWS]
    got = collocations.collocations(edge.table(spark), min_count=2, batch_bytes=50_000)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 3, 2, 50, 2000)


def test_languages_stay_apart(spark):
    """Languages whose names begin alike have counts of their own."""
    rows = [("language-one", "a b")] * 6 + [("language-two", "a b")] * 7
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=7)
    assert [(r.lang, r.phrase, r.a) for r in got.collect()] == [("language-two", "a b", 7)]


def test_ranks_from_salted_parts(spark):
    df = spark.range(400_000).select(F.lit("x").alias("lang"), (F.col("id") % 1000).alias("score"), (F.col("id") % 7).alias("a"), F.format_string("p%06d", "id").alias("phrase"))
    got = [(r.rank, r.phrase) for r in collocations._best(df, 50).orderBy("rank").collect()]
    want = sorted((-(i % 1000), -(i % 7), f"p{i:06d}") for i in range(400_000))[:50]
    assert got == [(k + 1, p) for k, (_, _, p) in enumerate(want)]


def test_automaton_counts():
    rng = np.random.default_rng(4)
    codes, first = rng.integers(0, 4, 500), rng.random(500) < 0.2
    first[0] = True
    tree = collocations.SuffixAutomaton(codes, first, 4)
    tree.deepen()
    keep = np.arange(len(tree.levels[1]["word"])) % 3 > 0
    tree.prune(keep)
    tree.deepen()
    one, two, three = tree.end_counts()
    assert one.tolist() == np.bincount(codes, minlength=4).tolist()
    pairs, triples = collections.Counter(), collections.Counter()
    alive = {(int(tree.levels[1]["source"][k]), int(tree.levels[1]["word"][k])) for k in np.flatnonzero(keep)}
    for i in range(1, 500):
        if not first[i]:
            pair = (int(codes[i - 1]), int(codes[i]))
            pairs[pair] += pair in alive
            if i > 1 and not first[i - 1] and pair in alive and (int(codes[i - 2]), pair[0]) in alive:
                triples[int(codes[i - 2]), *pair] += 1
    level = tree.levels[1]
    assert {(int(a), int(b)): int(n) for a, b, n in zip(level["source"], level["word"], two)} == dict(pairs)
    for k, n in enumerate(three):
        pair, last, link = tree.levels[2]["source"][k], tree.levels[2]["word"][k], tree.levels[2]["link"][k]
        assert triples[int(level["source"][pair]), int(level["word"][pair]), int(last)] == n
        assert (level["source"][link], level["word"][link]) == (level["word"][pair], last)
    assert len(three) == len(triples)


def test_places():
    known_h, known_c = np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 3, 1])
    h, c = np.array([5, 5, 5, 5, 1, 9, 9, 11], np.uint64), np.array([3, 1, 2, 4, 1, 1, 2, 1])
    assert collocations._places(h, c, known_h, known_c).tolist() == [3, 1, 2, -1, -1, 4, -1, -1]


# Pages.

LONG = "<p>" + "Many plain words in a row, as an article has them. " * 4 + "</p>"
LINE = ("Many plain words in a row, as an article has them. " * 4).strip()
PAGES = {
    "marked": (
        "<header><h1>Site</h1></header><nav><ul><li>Home<li>More</ul></nav><article><header><h1>Own title</h1><p>By X</p></header><p>a<b>b</b>c<br>d &eacute;&nbsp;&#x41; x</p>"
        f"<aside>Side</aside><form><p>Sign up</p></form><section class='comments'><article><p>reader</p>{LONG}</article></section><ul><li>one<li>two</ul><footer>foot</footer></article><aside>{LONG}</aside>",
        "Own title\nabc d é A x\none\ntwo",
    ),
    "inline parts outside": ('<article><script>var t="</p>";</script><p>x<style>p{}</style>y <span class="ad">buy <span>z</span> now</span>w</p><!-- c --><p>&amp;am &quo; &copy</p></article>', "xy w\n&am &quo; ©"),
    "short blocks and a long advert": (f'<div class="ad">{LONG}</div><article><h1>T</h1><p>Yes.<p><b>No.<br><p>Ok</article><footer>f</footer>', "T\nYes.\nNo.\nOk"),
    "no marks": (
        f'<div class="top header"><h1>Site</h1></div><div id="menu"><a>Home</a> <a>About</a></div><div class="col"><div class="content"><h2>Title &amp; more</h2>{LONG}<p>Short.</p>{LONG}</div>'
        f'<div class="sidebar">{LONG}</div></div><div id="comments"><p>First!</p>{LONG}</div><div>Made with love</div>',
        f"Title & more\n{LINE}\nShort.\n{LINE}",
    ),
    "two articles": (f"<article>{LONG}</article><article>{LONG}</article>", f"{LINE}\n{LINE}"),
    "main": (f'<main><h1>H</h1>{LONG}<div class="cookie-notice">We use cookies</div></main><div role="complementary">{LONG}</div>', f"H\n{LINE}"),
    "never closed advert": (f'<div class="ad">Buy<article><h1>T</h1>{LONG}</article>', f"T\n{LINE}"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", "a\nb\nc\nx y"),
    "only text": ("just  text\n", "just text"),
    "nothing": ("<html><body><nav>x</nav><form>y</form></body>", ""),
    "broken": ("<article><p>a</p></div></p><p>b<</p>c &#0; &#x110000; <p", "a\nb<\nc � �"),
    "ends in a comment": ("<article><p>a</p><!-- never <p>closed</p>", "a"),
    "ends in a tag": ('<article><p>a &lt; b</p><p class="x', "a < b"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert main_text(PAGES[name][0]) == PAGES[name][1]


def test_extract_pages(spark):
    rows = [(k if k % 5 else None, f"u{k}" if k % 4 else None, html, "x") for k, (html, _) in enumerate(PAGES.values())] * 2
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(r[0], r[1], t, len(t)) for r, (_, t) in zip(rows, [*PAGES.values()] * 2)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_page():
    assert main_text("<article>" + "<p>word</p>" * 50_000 + "</article>") == "\n".join(["word"] * 50_000)
    assert len(main_text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_smoothing_and_clusters():
    assert smoothed([0, 0, 9, 0, 0], 1.0)[2] > smoothed([0, 0, 9, 0, 0], 1.0)[1] > smoothed([0, 0, 9, 0, 0], 1.0)[0] > 0
    assert smoothed([5.0] * 4, 2.0) == pytest.approx([5.0] * 4)
    assert 2 < threshold([1, 1, 2, 50, 60]) < 50 and threshold([10, 11, 12]) == 10


def test_page_sql_reads_the_article():
    assert "<article>" in OP12_SQL  # and test_queries holds the query against it


# Alignment.


@pytest.fixture(scope="module")
def aligner():
    with open(alignment.BPE, "rb") as a, open(alignment.PIECES, "rb") as b:
        return alignment.Aligner(alignment.ByteBpe(a.read()), alignment.Pieces(b.read()))


AWKWARD = [
    "plain text, it's here", " two  spaces   three ", "a\n b\n\n  c\t d", "x  y  z　 w\u0085 v", "日本語 です。 العربية 한국어", "<|endoftext|> <s></s> <unk> [MASK]", "tail \n", "▁ held", "a▁b c",
    "“quoted” — it’s 100% é̂ ñ", "\x00\x1c \x1d nul", "emoji 😀👍🏽 end", "w" * 3000, "don't  'll  we've", "1234567 8.9e10", "   ", "\n", "ﬁ ligature ½",
]


def test_units_change_no_tokens(aligner):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(alignment.BPE)
    bpe.encode_special_tokens = True
    rng = random.Random(3)
    marks = [*" \t\n\r  　\u0085abc'é.1日x\x1c", "  ", " the", "'s", "😀"]
    texts = AWKWARD + ["".join(rng.choice(marks) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    codes, counts, a, b = aligner.batch([t.encode() for t in texts])
    spelt = ["".join(map(aligner.b.model.id_to_piece, aligner.b.model.encode(t))) for t in texts]
    at = np.r_[0, np.cumsum(counts)]
    for k, t in enumerate(texts):
        mine = codes[at[k] : at[k + 1]]
        whole_a, whole_b = bpe.encode(" " + t, add_special_tokens=False).ids, aligner.b.model.encode(t)
        if b"".join(aligner.b.bytes[i] for i in whole_b) != (" " + t).encode():
            whole_a = whole_b = []
        assert [i for u in mine for i in a[u]] == whole_a and [i for u in mine for i in b[u]] == whole_b, (t, spelt[k])


def plain_alignment(aligner, rows):
    each, count, top, out = [], collections.Counter(), collections.Counter(), []
    for key, text in rows:
        x = " " + (text or "")
        a, b = (aligner.a.encode([x])[0], aligner.b.encode([x])[0]) if text else ([], [])
        if b"".join(aligner.a.bytes[i] for i in a) != x.encode() or b"".join(aligner.b.bytes[i] for i in b) != x.encode():
            a = b = []
        a_end, b_end = list(accumulate(len(aligner.a.bytes[i]) for i in a)), list(accumulate(len(aligner.b.bytes[i]) for i in b))
        cuts = sorted(set(a_end) & set(b_end))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, a_end), (1, b, b_end)):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = [(i, j) for i, e in zip(a, a_end) for j, o in zip(b, b_end) if e - len(aligner.a.bytes[i]) < o and o - len(aligner.b.bytes[j]) < e]
        count.update(set(links))
        each.append((key, len(a), len(b), links, ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)))
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for key, n_a, n_b, links, groups in each:
        out.append((key, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), groups))
    return collections.Counter(out)


@pytest.mark.parametrize("size", [60, 10_000])
def test_alignment(spark, aligner, size):
    rng = random.Random(size)
    words = ["the", "antidisestablishment", "of", "naïveté", "x9", "日本", "it's", "😀", "▁"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(AWKWARD)] + [(None, "the end"), (None, "the end"), (7, "again 7"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    got = alignment.align_tokens(df, batch_bytes=size)
    assert collections.Counter(map(tuple, got.collect())) == plain_alignment(aligner, rows)


def test_alignment_scores_few_shards_at_once(spark, aligner):
    rows = [(k, f"{k} antidisestablishment of it's " * 3) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = alignment.align_tokens(df, batch_bytes=60)
    assert collections.Counter(map(tuple, got.collect())) == plain_alignment(aligner, rows)
    assert got.rdd.getNumPartitions() >= 120 // alignment.SHARDS_TOGETHER


def test_alignment_of_unit_slices(aligner):
    texts = [" the antidisestablishment".encode(), " naïveté".encode(), "".encode(), " of 日本 it's".encode()]
    (a_ids, n_a), (b_ids, n_b) = map(alignment._flat, aligner.encode(texts)[:2])
    whole = aligner.align(a_ids, n_a, b_ids, n_b, named=True)
    slices = list(aligner.align_slices(a_ids, n_a, b_ids, n_b, named=True, size=3))
    assert len(slices) > 1 and [g for x in slices for g in x["groups"]] == whole["groups"]
    for c in ("links", "n_groups", "n_links"):
        assert [v for x in slices for v in x[c].tolist()] == whole[c].tolist()


def test_alignment_edges(spark, aligner):
    got = alignment.align_tokens(edge.table(spark)).collect()
    short = [(r[0], r[1]) for r in edge.ROWS if r[0] != 5]
    want = plain_alignment(aligner, short)
    assert len(got) == len(edge.ROWS) and {r[:4] for r in map(tuple, got) if r[0] != 5} == {r[:4] for r in want}
    assert alignment.align_tokens(edge.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, alignment.align_tokens(nothing).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
