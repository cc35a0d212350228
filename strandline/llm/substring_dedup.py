"""Substring de-duplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of `window // 2` words, the anchors. A window of `window` words
always holds a whole block, so two equal windows share a block that starts at an anchor in one of them. All rolling
windows of block length probe the anchor index; hits are extended to the windows of full length around them, and each
of these finds the earliest place of its word sequence. Windows that follow each other and whose earliest places do too
are joined into a maximal exact repeat, with its length and its source.

Word sequences are compared by 96 bits of two hashes of the whole sequence: among 1e13 windows, six pairs in ten
thousand such corpora would be taken for equal wrongly.

Data move in packed form: a group of about a thousand documents sends one row to each hash bucket, with each distinct
hash of the group once. So a passage that a third of all documents hold is one entry for each group, not one for each
document, and its windows lie in different buckets.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import doc_groups, encode_all, mix64, planes, unplanes, window_hashes, window_starts, word_hashes, words_col
from strandline.session import ship

PACKED = "bucket int, grp int, docs binary, ords binary, counts binary, pos binary, hashes binary, tops binary"
TOLD = "grp int, docs binary, ords binary, counts binary, pos binary"
SOURCES = TOLD + ", from_docs binary, from_pos binary"
REPEATS = "array<struct<start:int,length:int,source:bigint,source_start:int>>"
KEPT = f"doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long, longest_repeat long, kept_text string, repeats {REPEATS}"
SECOND = np.uint64(0x8E9D5AFC1D3B7A61)


def _ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """doc_id, ordinal among the rows of that doc_id, and text, in the order that decides which window is earlier."""
    ids, raw = pdf["doc_id"].to_numpy(np.int64), encode_all(pdf["text"])
    by = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
    ids = ids[by]
    new = np.r_[True, ids[1:] != ids[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return ids, (np.arange(len(ids)) - first).astype(np.int32), [raw[i] for i in by]


def _second(h: np.ndarray, n: int) -> np.ndarray:
    """Other hashes of the windows, 32 bits."""
    return (window_hashes(mix64(h ^ SECOND), n) >> np.uint64(32)).astype(np.uint32)


def _pack(grp, buckets, ids, ords, doc, pos, h, second=None) -> pd.DataFrame:
    """One row for each bucket: its documents, how many windows each has, and delta-coded positions and hashes."""
    bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((pos, doc, bucket))
    bucket, doc, pos, h = bucket[by], doc[by], pos[by].astype(np.int64), h[by]
    tops = (h >> np.uint64(32)).astype(np.uint32)
    tops = tops if second is None else np.c_[tops, second[by]]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(by) else np.empty(0, np.int64)
    rows = []
    for s, e in zip(cuts, np.r_[cuts[1:], len(by)]):
        d, p = doc[s:e], pos[s:e]
        head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        delta = np.diff(p, prepend=0)
        delta[head] = p[head]
        rows.append(
            (
                int(bucket[s]),
                grp,
                planes(ids[d[head]]),
                planes(ords[d[head]]),
                planes(np.diff(np.r_[head, e - s]).astype(np.uint32)),
                planes(delta.astype(np.uint32)),
                (h[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                tops[s:e].tobytes(),
            )
        )
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, ords, n = unplanes(row.docs, np.int64), unplanes(row.ords, np.int32), unplanes(row.counts, np.uint32)
    delta = unplanes(row.pos, np.uint32).astype(np.int64)
    total = np.cumsum(delta)
    head = np.cumsum(n) - n
    base = total[head] - delta[head]
    return np.repeat(ids, n), np.repeat(ords, n), total - np.repeat(base, n)


def _tell(grp_of_row, ids, ords, pos, *sources) -> pd.DataFrame:
    """One row for each group of documents with the windows it is told of, and their sources if given."""
    by = np.lexsort((pos, ords, ids, grp_of_row))
    sources = [x[by] for x in sources]
    g, ids, ords, pos = grp_of_row[by], ids[by], ords[by], pos[by]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(by) else np.empty(0, np.int64)
    rows = []
    for s, e in zip(cuts, np.r_[cuts[1:], len(by)]):
        d, o, p = ids[s:e], ords[s:e], pos[s:e]
        head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1])])
        delta = np.diff(p, prepend=0)
        delta[head] = p[head]
        counts = np.diff(np.r_[head, e - s]).astype(np.uint32)
        own = planes(d[head]), planes(o[head]), planes(counts), planes(delta.astype(np.uint32))
        rows.append((int(g[s]), *own, *(planes(x[s:e]) for x in sources)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in (SOURCES if sources else TOLD).split(", ")])


def _firsts(h: np.ndarray, prefer: np.ndarray | None = None) -> np.ndarray:
    """Index of one entry for each distinct hash: the first, or the first that is preferred where there is one."""
    by = np.lexsort((~prefer, h)) if prefer is not None else np.argsort(h, kind="stable")
    s = h[by]
    return by[np.r_[True, s[1:] != s[:-1]]] if len(by) else by


def _first_of(h: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each entry the index of the first one that equals it."""
    by = np.argsort(h, kind="stable")
    new = np.r_[True, h[by][1:] != h[by][:-1]][: len(by)]
    out = np.empty(len(h), np.int64)
    out[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    odd = np.flatnonzero(second[out] != second)  # equal in 64 bits, yet different
    for i in odd.tolist():
        out[i] = next(j for j in odd.tolist() if h[j] == h[i] and second[j] == second[i])
    return out


def _repeated(h: np.ndarray) -> np.ndarray:
    """True where the hash occurs more than once."""
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def probes(block: int, buckets: int):
    def run(key, pdf):
        ids, ords, texts = _ordered(pdf)
        h, counts = word_hashes(texts)
        flat, doc, pos = window_starts(counts, block)
        wh = window_hashes(h, block)[flat] if len(flat) else np.empty(0, np.uint64)
        one = _firsts(wh, pos % block == 0)
        return _pack(key[0], buckets, ids, np.zeros_like(ords), doc[one], pos[one], wh[one]).drop(columns="tops")

    return run


def match_anchors(block: int):
    """Of a bucket: the probes whose hash is an anchor's and occurs more than once."""

    def run(pdf):
        if not len(pdf):
            return pd.DataFrame({c.split()[0]: [] for c in TOLD.split(", ")})
        got = [_unpack(r) for r in pdf.itertuples()]
        ids, ords, pos = (np.concatenate([g[k] for g in got]) for k in range(3))
        grp = np.repeat(pdf["grp"].to_numpy(), [len(g[0]) for g in got])
        h = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["hashes"]])
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        anchored = np.bincount(inverse, weights=pos % block == 0, minlength=len(n)) > 0
        hit = ((n > 1) & anchored)[inverse]
        return _tell(grp[hit], ids[hit], ords[hit], pos[hit])

    return run


def _marks(told: pd.DataFrame, ids: np.ndarray, ords: np.ndarray, offset: np.ndarray, total: int, any_ord: bool) -> np.ndarray:
    """Flat word positions that the packed rows name."""
    mark = np.zeros(total + 1, dtype=bool)
    if not len(told):
        return mark
    key = ids if any_ord else None
    for r in told.itertuples():
        d, o, p = _unpack(r)
        at = np.searchsorted(ids, d)  # the first row of each doc_id
        if not any_ord:
            mark[offset[at + o] + p] = True
            continue
        k = 0
        while True:  # each row of that doc_id; nearly always one
            row = np.minimum(at + k, len(ids) - 1)
            same = (at + k < len(ids)) & (key[row] == d)
            if not same.any():
                break
            where = offset[row[same]] + p[same]
            mark[np.minimum(where, total)] = True
            k += 1
    return mark


def extend(window: int, block: int, buckets: int):
    """Of a group: all windows of full length around hits, each distinct one once, by its first occurrence."""

    def run(key, pdf, told):
        ids, ords, texts = _ordered(pdf)
        h, counts = word_hashes(texts)
        offset = np.cumsum(counts) - counts
        hit = _marks(told, ids, ords, offset, len(h), True)[: len(h)]
        flat, doc, pos = window_starts(counts, block)
        if len(flat):  # repeats inside the group
            wh = window_hashes(h, block)[flat]
            hit[flat[_repeated(wh)]] = True
        seen = np.r_[0, np.cumsum(hit)]
        flat, doc, pos = window_starts(counts, window)
        near = seen[flat + window - block + 1] > seen[flat]
        flat, doc, pos = flat[near], doc[near], pos[near]
        if not len(flat):
            return _pack(key[0], buckets, ids, ords, doc, pos, np.empty(0, np.uint64))
        wh, second = window_hashes(h, window)[flat], _second(h, window)[flat]
        one = np.flatnonzero(_first_of(wh, second) == np.arange(len(wh)))
        return _pack(key[0], buckets, ids, ords, doc[one], pos[one], wh[one], second[one])

    return run


def later_ones(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: every entry but the earliest of its word sequence, with that one's place."""
    if not len(pdf):
        return pd.DataFrame({c.split()[0]: [] for c in SOURCES.split(", ")})
    got = [_unpack(r) for r in pdf.itertuples()]
    ids, ords, pos = (np.concatenate([g[k] for g in got]) for k in range(3))
    grp = np.repeat(pdf["grp"].to_numpy(), [len(g[0]) for g in got])
    h = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["hashes"]]).astype(np.uint64)
    tops = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["tops"]]).reshape(-1, 2)
    h |= tops[:, 0].astype(np.uint64) << np.uint64(32)
    second = tops[:, 1]
    by = np.lexsort((pos, ords, ids, second, h))
    s, t = h[by], second[by]
    new = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    late, first = by[~new], first[~new]
    return _tell(grp[late], ids[late], ords[late], pos[late], ids[first], pos[first].astype(np.uint32))


def _sources(told: pd.DataFrame, ids: np.ndarray, offset: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each flat word position: the number of the told window that starts there or -1; and all told sources."""
    at, docs, pos, n = np.full(total, -1, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.uint32)], 0
    for r in told.itertuples():
        d, o, p = _unpack(r)
        at[offset[np.searchsorted(ids, d) + o] + p] = n + np.arange(len(d))
        docs.append(unplanes(r.from_docs, np.int64))
        pos.append(unplanes(r.from_pos, np.uint32))
        n += len(d)
    return at, np.concatenate(docs), np.concatenate(pos).astype(np.int64)


def _maximal(flat, doc, pos, from_doc, from_pos, late, window: int) -> tuple[np.ndarray, ...]:
    """The late windows joined into repeats: number of the row, start, length, source and its start."""
    w = np.flatnonzero(late)
    f, d, a, b = flat[w], doc[w], from_doc[w], from_pos[w]
    on = (f[1:] == f[:-1] + 1) & (d[1:] == d[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1] + 1)
    begin = np.flatnonzero(np.r_[True, ~on])[: len(w)]
    length = np.diff(np.r_[begin, len(w)])[: len(begin)] + window - 1
    return d[begin], pos[w][begin], length, a[begin], b[begin]


def remove(window: int, want_text: bool):
    def run(key, pdf, told):
        ids, ords, texts = _ordered(pdf)
        h, counts = word_hashes(texts)
        offset = np.cumsum(counts) - counts
        flat, doc, pos = window_starts(counts, window)
        owner = start = length = source = source_start = np.empty(0, np.int64)
        gone = np.zeros(len(h), bool)
        if len(flat):
            at, told_doc, told_pos = _sources(told, ids, offset, len(h))
            first = _first_of(window_hashes(h, window)[flat], _second(h, window)[flat])
            which = at[flat[first]]  # the window's sequence is known elsewhere before this group, or not
            late = (first != np.arange(len(first))) | (which >= 0)
            from_doc, from_pos = ids[doc[first]], pos[first]
            known = which >= 0
            from_doc[known], from_pos[known] = told_doc[which[known]], told_pos[which[known]]
            owner, start, length, source, source_start = _maximal(flat, doc, pos, from_doc, from_pos, late, window)
            change = np.zeros(len(h) + 1, dtype=np.int32)
            np.add.at(change, offset[owner] + start, 1)
            np.add.at(change, offset[owner] + start + length, -1)
            gone = np.cumsum(change)[: len(h)] > 0
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows = []
        for i, t in enumerate(texts):
            g = gone[offset[i] : offset[i] + counts[i]]
            words = t.split()
            n, a, b = int(g.sum()), cuts[i], cuts[i + 1]
            kept = b" ".join(compress(words, ~g) if n else words)
            digest = hashlib.sha256(kept).hexdigest()
            text, runs = None, None
            if want_text:
                text = kept.decode("utf-8", "surrogatepass")
                every = (x[a:b].tolist() for x in (start, length, source, source_start))
                runs = [dict(zip(("start", "length", "source", "source_start"), r)) for r in zip(*every)]
            rows.append((int(ids[i]), len(words), n, digest, int(b - a), int(length[a:b].max(initial=0)), text, runs))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats", "longest_repeat", "kept_text", "repeats"]
        return pd.DataFrame(rows, columns=names)

    return run


def substring_dedup(docs: DataFrame, window: int = 20, want_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of `window` words whose sequence also starts earlier.

    Returns doc_id, n_words, n_removed, kept_sha256, n_repeats and longest_repeat (of the maximal exact repeats, in words),
    kept_text (kept words joined by one space) and repeats: start, length, and the document and place where the same
    words start first; the last two are null unless `want_text`. Earlier: smaller doc_id, or an earlier start in the same
    document. A repeat goes on as long as its windows' earliest places follow each other, so repeats of different sources
    may overlap.

    Null and empty texts have no words, none removed, and the digest of the empty string. Rows that share a doc_id
    count as separate documents, ordered by text. A row without doc_id has no place in the order: it removes nothing
    and keeps all its words. Further columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    block = max(1, window // 2)
    grouped, n = doc_groups(docs)
    buckets = max(32, -(-n // 2048))
    sent = grouped.groupBy("grp").applyInPandas(probes(block, buckets), ", ".join(PACKED.split(", ")[:-1]))
    told = sent.groupBy("bucket").applyInPandas(match_anchors(block), TOLD)
    full = grouped.groupBy("grp").cogroup(told.groupBy("grp")).applyInPandas(extend(window, block, buckets), PACKED)
    late = full.groupBy("bucket").applyInPandas(later_ones, SOURCES)
    out = grouped.groupBy("grp").cogroup(late.groupBy("grp")).applyInPandas(remove(window, want_text), KEPT)
    lone = docs.where(F.col("doc_id").isNull()).select(F.lit(0).alias("grp"), "doc_id", F.col("text").cast("string").alias("text"))
    return out.unionByName(_untouched(lone, want_text))


def _untouched(docs: DataFrame, want_text: bool) -> DataFrame:
    words = words_col(F.col("text"))
    kept = F.array_join(words, " ")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(words).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
        F.lit(0).cast("long").alias("n_repeats"),
        F.lit(0).cast("long").alias("longest_repeat"),
        (kept if want_text else F.lit(None).cast("string")).alias("kept_text"),
        (F.array().cast(REPEATS) if want_text else F.lit(None).cast(REPEATS)).alias("repeats"),
    )
