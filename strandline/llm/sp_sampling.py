"""SentencePiece encoding with distinct sampled segmentations, and decoding.

Gumbel top-k without replacement: each segmentation of a text has its log-probability plus Gumbel noise, and the k
largest are a sample without replacement. They are found by best-first (A*) search over the lattice. A search region is
a path's prefix with some edges of the next node excluded; its bound is the maximum of the perturbed scores in it, a
Gumbel variable at the log of the region's whole probability, truncated at the bound it was split from. The best region
is popped, one segmentation is drawn in it, and the rest is split at each step of the new path. So after k pops the
result is exact, and the largest bound left is the threshold that gives each sample's inclusion probability.

A path runs over the pre-tokens in order and inside each from its end to its start. Uniform numbers are hashes of seed,
row key, sample, pre-token and step, so a row's samples do not depend on partitions or retries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import mix64
from strandline.llm.token_counts import PIECES, batches, distinct_bound, split_batch
from strandline.llm.unigram import HELD, SPACE, Lattice, Vocabulary
from strandline.session import ship

SAMPLES = "doc_id string, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
CHECKED = "doc_id string, sample int, n_pieces long, log_prob double, inclusion double, ids_sha256 string, decoded boolean"


def _uniform(key, token, step, sample: int, what: int) -> np.ndarray:
    x = np.asarray(key, np.uint64) + np.asarray(token, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = mix64(x + np.asarray(step, np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((sample * 8 + what) * 0x2545F4914F6CDD1D % 2**64))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel_below(log_mass, limit, u) -> np.ndarray:
    """A Gumbel variable at `log_mass`, given that it is at most `limit`."""
    return limit - np.logaddexp(0.0, limit - log_mass + np.log(-np.log(u)))


class _Path:
    """One segmentation of each of some texts, flattened; `first` cuts it by text."""

    def __init__(self, text, token, step, node, edge, lattice):
        self.text, self.token, self.step, self.node, self.edge = text, token, step, node, edge
        self.cond = lattice.cond[edge]
        self.first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][: len(text)])
        self.rows = text[self.first]
        self.end = np.r_[self.first[1:], len(text)]
        sums = np.r_[0.0, np.cumsum(self.cond)]
        self.before = sums[:-1] - np.repeat(sums[self.first], self.end - self.first)
        self.log_prob = sums[self.end] - sums[self.first]


def _walk(lattice, key, text, token, node, step, sample):
    """Draw the rest of each pre-token from `node` on; arrays of (text, token, step, node, edge), in path order."""
    got, at, turn, steps = [], np.arange(len(node)), 0, np.zeros(len(node), np.int64)
    while len(at):
        e = lattice.ptr[node]
        free = np.flatnonzero(lattice.several[node])
        e[free] = lattice.draw(node[free], _uniform(key[at[free]], token[at[free]], step[free], sample, 0))
        got.append((at, step, node, e))
        steps[at] = turn = turn + 1
        node, step = lattice.target[e], step + 1
        live = np.flatnonzero(node)
        at, node, step = at[live], node[live], step[live]
    if not got:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    first = np.cumsum(steps) - steps
    out = np.empty((3, int(steps.sum())), np.int64)
    for k, (at, *cols) in enumerate(got):
        for row, col in zip(out, cols):
            row[first[at] + k] = col
    return np.repeat(text, steps), np.repeat(token, steps), *out


def sample_texts(texts: list[str | None], keys: np.ndarray, vocab: Vocabulary, samples: int, at_once: int = 500_000):
    """Yields (text number, sample number, ids, log-probability, perturbed score, inclusion), texts without pieces too.
    One lattice serves all texts, or halves of them where their distinct pre-tokens are over twice `at_once` characters;
    about `at_once` characters are searched together."""
    words, flat, sizes, _ = split_batch(texts, vocab)
    if distinct_bound(texts, words, 2 * at_once):
        half = len(texts) // 2
        for a, b in ((0, half), (half, len(texts))):
            for r, *rest in sample_texts(texts[a:b], keys[a:b], vocab, samples, at_once):
                yield a + r, *rest
        return
    lattice = Lattice(words, vocab)
    lattice.sum_scores()
    ends = np.cumsum(sizes)
    for a, b in batches(texts, at_once):
        part = flat[ends[a] - sizes[a] : ends[b - 1]]
        for r, *rest in _search(lattice, part, sizes[a:b], keys[a:b], vocab, samples):
            yield a + r, *rest


def _search(lattice: Lattice, flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, vocab: Vocabulary, samples: int):
    """The samples of some texts; `flat` numbers their pre-tokens, `sizes` says how many each has."""
    n = len(sizes)
    owner_text = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)
    token = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    node = lattice.terminal[flat]
    zero = np.zeros(len(flat), np.int64)
    path = _Path(*_walk(lattice, keys[owner_text], owner_text, token, node, zero, 0), lattice)
    perturbed = np.full((samples + 1, n), -np.inf)
    logp = np.zeros((samples, n))
    full = np.flatnonzero(sizes)
    perturbed[0] = -np.log(-np.log(_uniform(keys, np.zeros(1), 0, 0, 1)))  # the whole probability is 1
    paths, bounds, splits = [], [], []
    split_at = split_mask = None

    for k in range(samples):
        if len(path.rows):
            logp[k, path.rows] = path.log_prob
        rest = lattice.rest[path.edge]
        if k:  # before the split there is nothing new; at the split some edges were excluded before
            rest[split_at] = _left(lattice, path.node[split_at], split_mask | _bit(lattice, path.node[split_at], path.edge[split_at]))
            rest[np.arange(len(rest)) < np.repeat(split_at, path.end - path.first)] = 0.0
        some = np.flatnonzero(rest > 0)
        text = path.text[some]
        u = _uniform(keys[text], path.token[some], path.step[some], k, 2)
        bound = np.full(len(rest), -np.inf)
        bound[some] = _gumbel_below(path.before[some] + np.log(rest[some]), perturbed[k][text], u)
        paths.append(path)
        bounds.append(bound)
        splits.append((split_at, split_mask))
        # The best region of each text over all paths so far.
        best, where, whose = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1)
        for q, (p, b) in enumerate(zip(paths, bounds)):
            if not len(p.rows):
                continue
            top = np.maximum.reduceat(b, p.first)
            hit = np.flatnonzero(b == np.repeat(top, p.end - p.first))
            spot = hit[np.searchsorted(hit, p.first)]
            better = top > best[p.rows]
            r = p.rows[better]
            best[r], where[r], whose[r] = top[better], spot[better], q
        perturbed[k + 1] = best
        if k + 1 == samples:
            break
        path, split_at, split_mask = _next_path(lattice, keys, paths, bounds, splits, where, whose, sizes, ends, flat, k + 1)

    for k, p in enumerate(paths):
        ids, cuts = _piece_ids(lattice, p, vocab)
        gaps = logp[k, p.rows] - perturbed[samples, p.rows]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(gaps))
        for i, r in enumerate(p.rows.tolist()):
            yield r, k, ids[cuts[i] : cuts[i + 1]], float(logp[k, r]), float(perturbed[k, r]), float(inclusion[i])
    for r in set(range(n)) - set(full.tolist()):
        yield r, 0, np.empty(0, np.int64), 0.0, float(perturbed[0, r]), 1.0


def _bit(lattice, node, edge):
    return np.left_shift(np.int64(1), edge - lattice.ptr[node])


def _left(lattice, node, mask):
    """Probability of a node's edges that are not in the mask."""
    first, count = lattice.ptr[node], lattice.ptr[node + 1] - lattice.ptr[node]
    own = np.arange(int(count.max(initial=0)))
    edge = np.minimum(first[:, None] + own, len(lattice.owner) - 1)
    free = (own < count[:, None]) & ((mask[:, None] >> own) & 1 == 0)
    return np.where(free, np.exp(lattice.cond[edge]), 0.0).sum(1)


def _next_path(lattice, keys, paths, bounds, splits, where, whose, sizes, ends, flat, sample):
    """Draw a path in the popped region of each text that still has one, and close that region."""
    parts, place, mask_at = [], {}, {}
    for q, p in enumerate(paths):
        rows = p.rows[whose[p.rows] == q]
        if not len(rows):
            continue
        at = where[rows]
        index = np.searchsorted(p.rows, rows)
        bounds[q][at] = -np.inf
        node, token, step = p.node[at], p.token[at], p.step[at]
        mask = _bit(lattice, node, p.edge[at])
        if splits[q][0] is not None:  # a region at its path's own split excludes what was excluded there
            mask |= np.where(splits[q][0][index] == at, splits[q][1][index], 0)
        # The edge at the split, among those not excluded.
        count = lattice.ptr[node + 1] - lattice.ptr[node]
        own = np.arange(int(count.max()))
        edges = np.minimum(lattice.ptr[node][:, None] + own, len(lattice.owner) - 1)
        free = (own < count[:, None]) & ((mask[:, None] >> own) & 1 == 0)
        weight = np.cumsum(np.where(free, np.exp(lattice.cond[edges]), 0.0), axis=1)
        u = _uniform(keys[rows], token, step, sample, 0) * weight[:, -1]
        pick = np.minimum((weight <= u[:, None]).sum(1), (np.where(free, own, -1)).max(1))
        edge = lattice.ptr[node] + pick
        # Prefix, split, the rest of that pre-token, and all later pre-tokens.
        lengths = at - p.first[index]
        pre = np.repeat(p.first[index] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        parts.append((p.text[pre], p.token[pre], p.step[pre], p.node[pre], p.edge[pre]))
        parts.append((rows, token, step, node, edge))
        later = sizes[rows] - token - 1
        t_text = np.repeat(rows, later)
        offset = np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)
        t_token = np.repeat(token + 1, later) + offset
        t_node = lattice.terminal[flat[(ends - sizes)[t_text] + t_token]]
        half = np.flatnonzero(lattice.target[edge])
        w_text = np.r_[rows[half], t_text]
        w_token = np.r_[token[half], t_token]
        w_node = np.r_[lattice.target[edge][half], t_node]
        w_step = np.r_[step[half] + 1, np.zeros(len(t_text), np.int64)]
        parts.append(_walk(lattice, keys[w_text], w_text, w_token, w_node, w_step, sample))
        place |= dict(zip(rows.tolist(), lengths.tolist()))
        mask_at |= dict(zip(rows.tolist(), mask.tolist()))
    none = np.empty(0, np.int64)
    cols = [np.concatenate([none, *x]) for x in zip(*parts)] if parts else [none] * 5
    by = _in_order(*cols[:3])
    path = _Path(*(c[by] for c in cols), lattice)
    rows = path.rows.tolist()
    at = path.first + np.array([place[r] for r in rows], np.int64)
    return path, at, np.array([mask_at[r] for r in rows], np.int64)


def _in_order(text: np.ndarray, token: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Places by text, pre-token and step, sorted by one packed number where the three fit into it."""
    bits = [int(x.max(initial=0)).bit_length() for x in (text, token, step)]
    if sum(bits) > 62:
        return np.lexsort((step, token, text))
    return np.argsort((text << (bits[1] + bits[2])) | (token << bits[2]) | step, kind="stable")


def _piece_ids(lattice, path: _Path, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts of a path in text order, and where each text's ids begin and end. Inside a pre-token the
    path runs backwards; a character without a piece becomes its byte pieces."""
    n = len(path.text)
    new = np.flatnonzero(path.step[1:] <= path.step[:-1]) + 1 if n else np.empty(0, np.int64)
    first = np.r_[0, new][: min(n, 1) + len(new)]
    size = np.diff(np.r_[first, n]) if n else first
    turned = np.repeat(2 * first + size - 1, size) - np.arange(n)
    edge = path.edge[turned]
    ids, times = lattice.piece[edge], lattice.tokens[edge]
    total = np.r_[0, np.cumsum(times)]
    cuts = total[np.r_[path.first, n]] if n else np.zeros(1, np.int64)
    ids = np.repeat(ids, times)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        cp, place = -1 - ids[odd], odd - np.repeat(total[:-1], times)[odd]
        cp = np.where(cp == ord(HELD), ord(SPACE), cp)
        length = np.repeat(times, times)[odd]
        shift = 6 * (length - 1 - place)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[length]
        head = np.where(length == 1, cp, lead | (cp >> shift))
        ids[odd] = vocab.byte_ids[np.where(place == 0, head, 0x80 | ((cp >> shift) & 0x3F))]
    return ids, cuts


def row_keys(doc_ids, seed: int) -> np.ndarray:
    raw = [hashlib.blake2b(f"{seed}:{d}".encode(), digest_size=8).digest() for d in doc_ids]
    return np.frombuffer(b"".join(raw), np.uint64)


def _each(pdf: pd.DataFrame, vocab, samples, seed, chars):
    texts, keys = pdf["text"].tolist(), row_keys(pdf["doc_id"].tolist(), seed)
    for a, b in batches(texts, chars):
        for r, *rest in sample_texts(texts[a:b], keys[a:b], vocab, samples):
            yield pdf["doc_id"].iat[a + r], texts[a + r], *rest


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sample_encode(docs: DataFrame, samples: int = 2, seed: int = 17, vocabulary: str = PIECES, batch_chars: int = 2_000_000) -> DataFrame:
    """Up to `samples` distinct segmentations of each row's whole text: doc_id, sample (from 0, best perturbed score
    first), ids, log_prob (under the unigram model, given the text), perturbed score and inclusion probability.

    A text with fewer segmentations gives fewer rows, each with inclusion 1. Null and empty texts give one row with no
    ids. Repeated rows give repeated results; a null doc_id is a key like any other. Other columns are ignored. No
    shuffle; a task holds one batch of about `batch_chars` characters, or one longer text.
    """
    ship(docs.sparkSession)
    vocab = Vocabulary.from_file(vocabulary)

    def run(frames):
        for pdf in frames:
            rows = []
            for d, _, k, ids, lp, g, inc in _each(pdf, vocab, samples, seed, batch_chars):
                rows.append((d, k, ids, lp, g, inc))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLES.split(", ")])
                    rows = []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLES.split(", ")])

    out = _source(docs).mapInPandas(run, SAMPLES)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def sample_digest(docs: DataFrame, samples: int = 2, seed: int = 17, vocabulary: str = PIECES, batch_chars: int = 2_000_000) -> DataFrame:
    """As `sample_encode`, with a digest of the ids (as little-endian 32-bit numbers) and whether they decode to the text."""
    ship(docs.sparkSession)
    vocab = Vocabulary.from_file(vocabulary)

    def run(frames):
        for pdf in frames:
            rows = []
            for d, text, k, ids, lp, _, inc in _each(pdf, vocab, samples, seed, batch_chars):
                digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                rows.append((d, k, len(ids), lp, inc, digest, vocab.decode(ids.tolist()) == (text or "")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHECKED.split(", ")])

    out = _source(docs).mapInPandas(run, CHECKED)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode(encoded: DataFrame, vocabulary: str = PIECES, ids: str = "ids") -> DataFrame:
    """Adds decoded_text to the rows; null ids give null."""
    ship(encoded.sparkSession)
    vocab = Vocabulary.from_file(vocabulary)

    @F.pandas_udf("string")
    def text_of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else vocab.decode(list(v)))

    return encoded.withColumn("decoded_text", text_of(F.col(ids)))
