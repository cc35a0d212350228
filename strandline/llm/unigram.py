"""A unigram lattice over a public piece vocabulary, with the prefixes of all pre-tokens of a batch shared in a trie.

The vocabulary file gives pieces in order of rank; their probabilities follow Zipf's law over the rank (nothing is
trained). A character without a piece of its own is spelled in byte pieces, so every text has a segmentation and
decoding gives the text back exactly.

Pre-tokens: each space begins a new one and is its first character, each newline is one of its own. Segmentations never
cross pre-tokens, of any length. A pre-token over `LONG` code points (an address, encoded bytes, text without spaces) is
searched in the parts between its seams, the places that no piece crosses: every segmentation is cut there, so the parts
are independent, and the best segmentation, the sums and the samples are those of the whole pre-token.
"""

from __future__ import annotations

import numpy as np

from strandline.llm.common import mix64

SPACE = "▁"
HELD = "\udc81"  # stands for a genuine U+2581 inside the lattice; no valid text holds it
LONG = 64  # pre-tokens over this length are looked through for seams; it changes no result
ZIPF_SHIFT = 2.7
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Vocabulary:
    """Pieces with log-probabilities, made on the driver and sent to tasks; at most some ten thousand pieces."""

    def __init__(self, pieces: list[tuple[str, int, int]], byte_ids: list[int]):
        """pieces: (text, id, rank); byte_ids: the ids of the 256 byte pieces."""
        lowest = max((r for _, _, r in pieces), default=0) + 1
        weights = {i: 1.0 / (r + ZIPF_SHIFT) for _, i, r in pieces} | {i: 1.0 / (lowest + ZIPF_SHIFT) for i in byte_ids}
        total = sum(weights.values())
        size = max(weights) + 1
        self.logp = np.full(size, -np.inf)
        self.logp[list(weights)] = np.log(np.array(list(weights.values())) / total)
        self.byte_ids = np.array(byte_ids, dtype=np.int64)
        self.byte_logp = float(np.log(1.0 / (lowest + ZIPF_SHIFT) / total))
        self.bytes = [b""] * size
        for t, i, _ in pieces:
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        texts = [t for t, _, _ in pieces]
        self.longest = max(map(len, texts), default=1)
        if self.longest > 62:
            raise ValueError("a piece of over 62 code points; edge sets are 64-bit masks")
        h = _Codes(texts).whole() if texts else np.empty(0, np.uint64)
        self.ids = np.array([i for _, i, _ in pieces], dtype=np.int32)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces have one hash")
        bits = 18
        self.mask = np.uint64((1 << bits) - 1)
        # Open addressing by sorted slots: hashes of a slot lie together, found by its start.
        slot = (h & self.mask).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        self.table, self.table_ids = h[by], self.ids[by]
        self.start = np.searchsorted(slot[by], np.arange((1 << bits) + 1)).astype(np.int32)
        self.most = int(np.max(np.diff(self.start), initial=0))

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file; pieces without a rank (a score under -1e8) come last."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        byte_ids = [i for i in n if m.is_byte(i)]
        usable = (i for i in n if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
        pieces = [(m.id_to_piece(i), i, -m.get_score(i)) for i in usable]
        last = max((r for _, _, r in pieces if r < 1e8), default=0) + 1
        return cls([(t, i, min(r, last)) for t, i, r in pieces], byte_ids)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, or -1."""
        slot = (h & self.mask).astype(np.int64)
        at, end = self.start[slot].astype(np.int64), self.start[slot + 1]
        out = np.full(len(h), -1, dtype=np.int32)
        for _ in range(self.most):
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            same = live[self.table[at[live]] == h[live]]
            out[same] = self.table_ids[at[same]]
            at += 1
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of piece ids."""
        b = b"".join(map(self.bytes.__getitem__, ids))
        return b[1:].decode("utf-8", "surrogatepass") if b else ""


class _Codes:
    """Code points of many strings with hashes of their substrings."""

    def __init__(self, texts: list[str]):
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        n = len(self.cp)
        power, inverse = np.full(n + 1, _M, np.uint64), np.full(n + 1, _M_INV, np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(self.cp.astype(np.uint64) + np.uint64(0x1234567)) * power[:n], out=self.sums[1:])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.inverse[a]
        return mix64(h + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def whole(self) -> np.ndarray:
        return self.between(self.end - self.size, self.end)


def pretokens(text: str | None) -> list[str]:
    """The pre-tokens of a text; concatenated they are the text with a space in front, spaces written as U+2581."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, HELD)
    return list(filter(None, spaced(text).split(" ")))


def spaced(text: str) -> str:
    """The pre-tokens of a text, between spaces."""
    return (SPACE + text).replace(" ", " " + SPACE).replace("\n", " \n ")


def seam_parts(words: list[str], vocab: Vocabulary) -> list[list[str]]:
    """Each word cut wherever no piece of the vocabulary, found in the word, crosses."""
    codes = _Codes(words)
    first = np.repeat(codes.end - codes.size, codes.size)
    change = np.zeros(len(codes.cp) + 1, np.int64)  # of the number of pieces across the place before each character
    at = np.arange(len(codes.cp))
    for k in range(2, vocab.longest + 1):
        last = at[at - first + 1 >= k]
        begin = last[vocab.find(codes.between(last + 1 - k, last + 1)) >= 0] + 1 - k
        np.add.at(change, begin + 1, 1)
        np.add.at(change, begin + k, -1)
    seam = np.flatnonzero((np.cumsum(change)[:-1] == 0) & (at > first))
    cuts = np.searchsorted(seam, np.r_[codes.end - codes.size, codes.end])
    out = []
    for w, start, a, b in zip(words, codes.end - codes.size, cuts[: len(words)], cuts[len(words) :]):
        edges = [0, *(seam[a:b] - start).tolist(), len(w)]
        out.append([w[x:y] for x, y in zip(edges, edges[1:])])
    return out


class Lattice:
    """The trie of distinct pre-tokens. Node 0 is the root; nodes are numbered by depth. The edges of a node are the
    pieces its prefix can end in, each leading back to a shorter prefix; `ptr` cuts the edge arrays by node."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        codes = _Codes(words)
        n = len(codes.cp)
        first = np.repeat(codes.end - codes.size, codes.size)
        at = np.arange(n)
        depth = at - first + 1
        _, rep, node = np.unique(codes.between(first, at + 1), return_index=True, return_inverse=True)
        by = np.argsort(depth[rep], kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(1, len(by) + 1)
        node = number[node]  # of each character position
        rep = rep[by]  # a position for each node, from node 1 on
        self.depth = np.r_[0, depth[rep]]
        self.terminal = node[codes.end - 1] if len(words) else np.empty(0, np.int64)
        owners, targets, pieces, logps, tokens = [], [], [], [], []
        for k in range(1, min(vocab.longest, int(self.depth.max(initial=0))) + 1):
            live = np.flatnonzero(self.depth[1:] >= k)
            pos = rep[live]
            piece = vocab.find(codes.between(pos + 1 - k, pos + 1))
            target = np.where(depth[pos] == k, 0, node[pos - k])
            found = piece >= 0
            logp, count = vocab.logp[piece], np.ones(len(piece), np.int64)
            if k == 1:  # a character without a piece: its bytes
                cp = codes.cp[pos]
                size = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
                logp, count = np.where(found, logp, size * vocab.byte_logp), np.where(found, 1, size)
                piece = np.where(found, piece, -1 - cp.astype(np.int64))
                found = np.ones(len(piece), bool)
            owners.append(live[found] + 1)
            targets.append(target[found])
            pieces.append(piece[found].astype(np.int64))
            logps.append(logp[found])
            tokens.append(count[found])
        if owners:
            owner = np.concatenate(owners)
            by = np.argsort(owner, kind="stable")
            self.owner = owner[by]
            self.target, self.piece, self.logp, self.tokens = (np.concatenate(x)[by] for x in (targets, pieces, logps, tokens))
        else:
            self.owner = self.target = self.piece = self.tokens = np.empty(0, np.int64)
            self.logp = np.empty(0)
        self.ptr = np.searchsorted(self.owner, np.arange(len(self.depth) + 1))
        self.levels = np.searchsorted(self.depth, np.arange(1, int(self.depth.max(initial=0)) + 2))

    def _each_level(self):
        for a, b in zip(self.levels[:-1], self.levels[1:]):
            s, e = self.ptr[a], self.ptr[b]
            yield a, b, s, e, self.ptr[a:b] - s

    def best_counts(self) -> np.ndarray:
        """Of each node: the number of tokens of its prefix's best segmentation; ties go to fewer tokens."""
        score, count = np.zeros(len(self.depth)), np.zeros(len(self.depth), np.int64)
        for a, b, s, e, cuts in self._each_level():
            value = score[self.target[s:e]] + self.logp[s:e]
            score[a:b] = np.maximum.reduceat(value, cuts)
            n = count[self.target[s:e]] + self.tokens[s:e]
            count[a:b] = np.minimum.reduceat(np.where(value == score[self.owner[s:e]], n, 1 << 60), cuts)
        return count

    def sum_scores(self) -> None:
        """Sets `total` (log of the summed probability of each prefix), and for each edge `cond` (its log-probability
        among the edges of its node), `rest` (the probability of the other edges) and `tail` (of it and those after it)."""
        total = np.zeros(len(self.depth))
        self.cond, self.rest, self.tail = (np.zeros(len(self.owner)) for _ in range(3))
        for a, b, s, e, cuts in self._each_level():
            value = total[self.target[s:e]] + self.logp[s:e]
            group = self.owner[s:e] - a
            top = np.maximum.reduceat(value, cuts)
            w = np.exp(value - top[group])
            mass = np.add.reduceat(w, cuts)
            total[a:b] = top + np.log(mass)
            p = w / mass[group]
            single = np.diff(np.r_[cuts, e - s]) == 1
            self.cond[s:e] = np.where(single[group], 0.0, np.log(p))
            others = np.add.reduceat(np.where(p > 0.5, 0.0, p), cuts)[group]  # only one edge can be over a half
            self.rest[s:e] = np.where(p > 0.5, others, np.where(single[group], 0.0, 1.0 - p))
            c = np.cumsum(p)
            self.tail[s:e] = c[np.r_[cuts[1:], e - s] - 1][group] - c + p
            self.tail[s + cuts] = 2.0
        self.total = total
        self.several = np.diff(self.ptr) > 1

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by inverse probability cumulated from its last edge."""
        e = self.ptr[node + 1] - 1  # the longest piece, mostly the likeliest
        live = np.flatnonzero(u >= self.tail[e])
        while len(live):
            e[live] -= 1
            live = live[u[live] >= self.tail[e[live]]]
        return e
