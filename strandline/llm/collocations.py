"""Phrase collocations from suffix automata.

The texts of a language in a batch form a shard. Its generalised suffix automaton, bounded in depth, is built level by
level with array operations: a node of level d is a sequence of d words, found from the node of its first d - 1 words by
its last word, and its suffix link is the node of its last d - 1 words. End positions are counted at the deepest node of
each place and added up along the links. A node whose link has as many end positions is in one state with it, so a shard
gives only the longest phrase of each state.

Shards are reduced in Spark. The nodes of each level but the last are summed over all shards by 80 bits of hash before
the next level is built: a phrase cannot be more frequent than its parts, so a shard goes on from frequent nodes alone,
and the first shard of each frequent phrase spells it. The last level is summed by its phrases. Two phrases of one hash
would be counted together: among 1e13 distinct ones this changes one of 100,000 reported numbers with probability 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import cut, mix64, one_row, parts, planes, text_chunks, unplanes, word_hashes, written
from strandline.session import ship

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Characters that end a piece become newlines, a tab becomes a space.
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _LOWER + b"\n" * 9 + b" ")


def coded_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, the number of each word in order, and whether it is the first of its piece."""
    a = np.frombuffer(b"\n" + b"\n".join(texts).translate(_FOLD) + b"\n", np.uint8)
    end = a == 10
    gap = end | (a == 32)
    starts, stops = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    offsets = np.r_[0, np.cumsum(stops - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[~gap])])
    coded = words.dictionary_encode()
    piece = np.cumsum(end)[starts]
    first = np.r_[True, piece[1:] != piece[:-1]][: len(starts)]
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), first


class SuffixAutomaton:
    """Nodes by level: `source` and `word` (the transition that leads to a node), `link` (its suffix link) and `at` (the
    node that ends at each place, -1 if none)."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, n_words: int):
        self.codes, self.n_words = codes, n_words
        self.inner = ~first
        none = np.full(n_words, -1)
        self.levels = [{"source": none, "word": np.arange(n_words), "link": none, "at": codes.copy()}]

    def deepen(self) -> None:
        """Another level: what two overlapping nodes of the deepest one spell together."""
        at = self.levels[-1]["at"]
        ends = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0) & self.inner[1:]) + 1
        key, one, node = np.unique(at[ends - 1] * self.n_words + self.codes[ends], return_index=True, return_inverse=True)
        here = np.full(len(at), -1)
        here[ends] = node
        self.levels.append({"source": key // self.n_words, "word": key % self.n_words, "link": at[ends[one]], "at": here})

    def prune(self, keep: np.ndarray) -> None:
        """Take nodes of the deepest level off all places, unless `keep` has them."""
        at = self.levels[-1]["at"]
        held = np.flatnonzero(at >= 0)
        at[held[~keep[at[held]]]] = -1

    def end_counts(self) -> list[np.ndarray]:
        """End positions of the nodes of each level: places where a node is the deepest, and those of the nodes that
        link to it."""
        out, deeper = [], None
        for level in reversed(self.levels):
            at = level["at"]
            own = at[at >= 0] if deeper is None else at[(at >= 0) & (deeper["at"] < 0)]
            count = np.bincount(own, minlength=len(level["word"]))
            if deeper is not None:
                count += np.bincount(deeper["link"], out[-1], len(count)).astype(np.int64)
            out.append(count)
            deeper = level
        return out[::-1]

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Of the nodes of the deepest level, from the hashes of the words."""
        h = words
        for level in self.levels[1:]:
            h = mix64(h[level["source"]] * np.uint64(0x9FB21C651E98DF25) + words[level["word"]] + np.uint64(1))
        return h

    def phrases(self, words: pa.Array, depth: int, nodes: np.ndarray) -> pa.Array:
        """The words of nodes of a level, joined by spaces."""
        out = []
        for level in self.levels[depth - 1 :: -1]:
            out.append(words.take(pa.array(level["word"][nodes])))
            nodes = level["source"][nodes]
        return pc.binary_join_element_wise(*out[::-1], " ")

SHARD = "shard long, lang string, n_words long, words binary, codes binary"
_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())])


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def make_shards(size: int):
    """Arrow batches of (lang, text) to one row for each language of each batch of about `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for langs, texts in text_chunks(batches, size):
            by_lang: dict[str, list] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, mine in by_lang.items():
                words, codes, first = coded_words([t or b"" for t in mine])
                order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # small numbers for frequent words
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words))
                row = {
                    "shard": number,
                    "lang": lang,
                    "n_words": len(codes),
                    "words": _packed(b" ".join(words.take(pa.array(order)).cast(pa.large_binary()).to_pylist())),
                    "codes": _packed(planes((place[codes] * 2 + first).astype(np.uint32))),
                }
                number += 1
                yield one_row(_SHARD, row)

    return run


def _words_and_codes(shard: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    return _unpacked(shard.column("words")[0].as_py()), unplanes(_unpacked(shard.column("codes")[0].as_py()), np.uint32).astype(np.int64)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards to (lang, phrase, n) of their words."""
    for shard in _each(batches):
        words, codes = _words_and_codes(shard)
        if not len(codes):
            continue
        words, n = pa.array(words.decode().split(" ")), np.bincount(codes >> 1)
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.repeat(shard.column("lang")[0], len(part)), part, pa.array(n[i : i + 100_000])], names=["lang", "phrase", "n"])


def _automaton(shard: pa.RecordBatch, depth: int) -> tuple[SuffixAutomaton, bytes, tuple, list]:
    """The automaton of a shard to a depth, its words, their two hashes, and for each level but the last the corpus
    counts of the nodes that this shard spells (0 for others). Those levels are pruned to the nodes that the row names:
    those it spells in `mine`, others in `alive` by the upper half of their hash, which lets a few in a million more
    through."""
    words, packed = _words_and_codes(shard)
    tree = SuffixAutomaton(packed >> 1, (packed & 1).astype(bool), max(words.count(b" ") + 1, 1))
    hashes = _word_hashes(words, shard.column("lang")[0].as_py())
    spelt, alive, mine = [], np.empty(0, np.uint32), (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if "mine" in shard.schema.names:
        if shard.column("alive")[0].is_valid:
            alive = np.unique(shard.column("alive")[0].values.to_numpy().view(np.uint32))
        if shard.column("mine")[0].is_valid:
            told = shard.column("mine")[0].values
            h, c, f = (told.field(k).to_numpy() for k in ("h", "c", "f"))
            order = np.argsort(h.view(np.uint64))
            mine = h.view(np.uint64)[order], c[order].astype(np.int64), f[order]
    for d in range(2, depth + 1):
        tree.deepen()
        if d < depth:
            h = tree.hashes(hashes[0])
            at = _places(h, _check(tree.hashes(hashes[1])), *mine[:2])
            upper = (h >> np.uint64(32)).astype(np.uint32)
            tree.prune((at >= 0) | (np.append(alive, np.uint32(0))[np.searchsorted(alive, upper)] == upper) & (np.searchsorted(alive, upper) < len(alive)))
            spelt.append(np.where(at >= 0, np.append(mine[2], 0)[at], 0))
    return tree, words, hashes, spelt


def _word_hashes(words: bytes, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of a language; the second reads the words backwards."""
    seed = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=16).digest(), np.uint64)
    return mix64(word_hashes([words])[0] + seed[0]), mix64(word_hashes([words[::-1]])[0][::-1] + seed[1])


def _places(h: np.ndarray, c: np.ndarray, known_h: np.ndarray, known_c: np.ndarray) -> np.ndarray:
    """Where each pair lies among the known ones, ordered by h; -1 if it is none of them."""
    if not len(known_h):
        return np.full(len(h), -1)
    at = np.searchsorted(known_h, h)
    while True:
        here = np.minimum(at, len(known_h) - 1)
        same = (at < len(known_h)) & (known_h[here] == h)
        other = same & (known_c[here] != c)
        if not other.any():
            return np.where(same, here, -1)
        at = at + other


def _check(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def node_hashes(depth: int):
    """Shards to (shard, h, m): their nodes of a level by hash, and in m how often each ends and 16 more bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _each(batches):
            tree, _, hashes, _ = _automaton(shard, depth)
            h, c = tree.hashes(hashes[0]).view(np.int64), _check(tree.hashes(hashes[1]))
            m = tree.end_counts()[-1].astype(np.int64) << 16 | c
            number = np.full(len(h), shard.column("shard")[0].as_py())
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (number, h, m)], names=["shard", "h", "m"])

    return run


def spelt_phrases(shortest: int, depth: int):
    """Shards to (lang, phrase, size, n): the phrases of the last level with their counts in the shard, and those of the
    levels before it that this shard spells, with their counts in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _each(batches):
            tree, joined, _, spelt = _automaton(shard, depth)
            words = pa.array(joined.decode().split(" "))
            lang = shard.column("lang")[0].as_py()
            for size, n in enumerate([*spelt, tree.end_counts()[-1]], 2):
                nodes = np.flatnonzero(n) if size >= shortest else []
                for i in range(0, len(nodes), 100_000):
                    part = nodes[i : i + 100_000]
                    phrase = tree.phrases(words, size, part)
                    cells = [pa.repeat(pa.scalar(lang, pa.string()), len(part)), phrase, pa.repeat(pa.scalar(size, pa.int32()), len(part)), pa.array(n[part].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cells, names=["lang", "phrase", "size", "n"])

    return run


def _joined(words, start, n):
    return F.array_join(F.slice(words, start, n), " ")


def phrase_counts(docs: DataFrame, shortest: int, longest: int, min_count: int, batch_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n_words), (lang, phrase, f) of the words, and (lang, phrase, size, f) of the phrases that occur
    `min_count` times or more."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    shards = written(source.mapInArrow(make_shards(batch_bytes), SHARD))
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    word = shards.select("lang", "words", "codes").mapInArrow(word_counts, "lang string, phrase string, n long")
    words = word.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)

    rows, alive = shards.select("shard", "lang", "words", "codes"), None
    with_alive = rows
    for depth in range(2, longest):
        nodes = with_alive.mapInArrow(node_hashes(depth), "shard long, h long, m long").repartition(parts(spark), "h")
        nodes = nodes.select("shard", "h", F.col("m").bitwiseAND(0xFFFF).cast("int").alias("c"), F.shiftright("m", 16).alias("n"))
        whole = Window.partitionBy("h", "c")
        often = nodes.withColumns({"f": F.sum("n").over(whole), "first": F.min("shard").over(whole)}).where(F.col("f") >= min_count)
        own = F.col("shard") == F.col("first")
        upper = F.when(~own, F.shiftright("h", 32).cast("int"))
        often = often.select("shard", upper.alias("upper"), F.when(own, F.struct("h", "c", "f")).alias("own"))
        if longest > 3:  # read again for each further level
            often = cut(often)
        alive = often if alive is None else alive.unionByName(often)
        told = alive.groupBy("shard").agg(F.collect_list("upper").alias("alive"), F.collect_list("own").alias("mine"))
        with_alive = rows.join(told, "shard", "left")
    found = with_alive.mapInArrow(spelt_phrases(shortest, longest), "lang string, phrase string, size int, n long")
    phrases = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return totals, words, cut(phrases)


def _best(df: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank. Rows are ranked in salted parts, of which eight at a time
    meet again, so no task ranks all rows of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = -(-df.count() // 10_000)
    df = df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(max(salts, 1))))
    while True:
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        df = df.withColumn("rank", place).where(F.col("rank") <= top)
        if salts <= 1:
            return df.drop("salt")
        salts = -(-salts // 8)
        df = df.withColumn("salt", F.floor(F.col("salt") / 8))


def collocations(
    docs: DataFrame, shortest: int = 2, longest: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000, batch_bytes: int = 12_000_000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases of (lang, text).

    Texts lose their capitals A-Z and are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and at spaces and tabs into words.
    Candidates are the phrases of `shortest` to `longest` words that occur a >= min_count times inside pieces. A cut into
    parts of l and r occurrences scores floor(1000000 * a * a / (l * r)); the lowest cut counts, the shortest first part
    among equals. A candidate goes if a candidate one word longer that holds it has at least `cover` percent of its
    occurrences; longer ones hold such a one. Rows are ranked by score, a, and the phrase's bytes. n counts the
    language's words.

    A null lang is `und`; null and empty texts have no words; each row counts, repeated rows included; other columns are
    ignored; an empty table gives an empty one. Counts up to 1e15 are exact. A task holds one batch of about
    `batch_bytes` bytes, or one longer text.
    """
    ship(docs.sparkSession)
    totals, words, phrases = phrase_counts(docs, shortest, longest, min_count, batch_bytes)
    known = words.unionByName(phrases.select("lang", "phrase", "f"))
    split = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("w", F.lit(1), F.col("k")).alias("head"), _joined("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    cuts = cuts.withColumns({f"d{c}": x for c, x in exact.items()}).withColumn("score", F.expr("(1000000 * (da * da)) div (dl * dr)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))

    longer = phrases.where(F.col("size") > shortest).select("lang", F.col("f").alias("longer"), "size", split.alias("w"))
    inner = F.col("size") - 1
    covers = longer.select("lang", "longer", F.explode(F.array(_joined("w", F.lit(2), inner), _joined("w", F.lit(1), inner))).alias("phrase"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    kept = cut(kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    out = _best(kept, top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
