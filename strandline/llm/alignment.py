"""Alignment of two tokenizers over the same bytes.

Texts are cut into units that both tokenizers keep apart (a space behind a character that is not white space begins a
unit), so a batch encodes and aligns each distinct unit once. Over the bytes of those units the B tokens form a static
interval index, sorted by start and end; two bisections for each A token list the B tokens that it overlaps. Places that
no token spans, where an A and a B token both end, cut the tokens into groups.

How many documents link a pair of ids is summed over the corpus in Spark: a batch gives each of its pairs once, and gets
their sums back to score its documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import one_row, parts, planes, text_chunks, unplanes, written
from strandline.session import ship

BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies cut a text before they merge.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's format; special tokens' strings are plain text.

    The ids are merge ranks, and no two merges spell one token, so the ranks alone determine the result; a rank encoder
    gives it in a fifth of the time."""

    def __init__(self, model: bytes):
        import tiktoken

        spec = json.loads(model)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or [vocab[t] for t in made] != sorted({vocab[t] for t in made}):
            raise ValueError("not a plain byte-level vocabulary in merge order")
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.model = tiktoken.Encoding("vocabulary", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.model.encode_ordinary, texts))


class Pieces:
    """A SentencePiece vocabulary, which puts a space before each text itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        n = range(self.model.get_piece_size())
        pieces = map(self.model.id_to_piece, n)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(n, pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@lru_cache(2)
def _loaded(a: bytes, b: bytes) -> Aligner:
    return Aligner(ByteBpe(a), Pieces(b))


def unit_starts(a: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte: at a space behind a character that is surely not white space. A character
    whose first byte some white space shares does not count as sure, so fewer cuts are made than could be."""
    sure = (a > 32) & (a < 127) | (a >= 0x80)
    sure[1:] &= ~((a[1:] >= 0x80) & (a[:-1] == 0xC2))
    sure[2:] &= ~((a[2:] >= 0x80) & (a[:-2] >= 0xE1) & (a[:-2] <= 0xE3))
    out = a == 32
    out[1:] &= sure[:-1]
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them), for each i in turn."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligner:
    """Both vocabularies, with what does not depend on a batch."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.a_len = np.fromiter(map(len, a.bytes), np.int64, len(a.bytes))
        self.b_len = np.fromiter(map(len, b.bytes), np.int64, len(b.bytes))
        marks = ((a, b","), (a, b"|"), (b, b","), (b, b";"))  # A and B ids inside a group, and the last of them
        self.named = [b"%d%s" % (i, mark) for side, mark in marks for i in range(len(side.bytes))]
        self.named_at = list(accumulate((len(side.bytes) for side, _ in marks), initial=0))

    def encode(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """A and B ids of each unit, and whether both spell its bytes; ids of those that don't are empty."""
        texts = [u.decode("utf-8", "surrogatepass") for u in units]
        a, b = self.a.encode(texts), self.b.encode(texts)
        good = np.ones(len(units), bool)
        for side, ids in ((self.a, a), (self.b, b)):
            spelt = side.bytes.__getitem__
            if b"".join(map(spelt, chain.from_iterable(ids))) != b"".join(units):
                good &= [b"".join(map(spelt, x)) == u for x, u in zip(ids, units)]
        for i in np.flatnonzero(~good):
            a[i] = b[i] = []
        return a, b, good

    def align(self, a_ids: np.ndarray, n_a: np.ndarray, b_ids: np.ndarray, n_b: np.ndarray, named: bool = False) -> dict:
        """Of the units' A and B ids in order, and how many each unit has: for each unit the numbers of groups and links,
        all links in order as pair keys (A id in the upper half), and if `named` the groups' text."""
        a_end, b_end = np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids])
        a_start, b_start = a_end - self.a_len[a_ids], b_end - self.b_len[b_ids]
        first = np.searchsorted(b_end, a_start, "right")
        n = np.searchsorted(b_start, a_end, "left") - first
        links = np.repeat(a_ids, n) << 32 | b_ids[_ranges(first, n)]
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end, "left"), np.searchsorted(cuts, b_end, "left")
        a_unit = np.repeat(np.arange(len(n_a)), n_a)
        last_a, last_b = np.isin(a_end, cuts, assume_unique=True), np.isin(b_end, cuts, assume_unique=True)
        out = {"links": links, "n_groups": np.bincount(a_unit[last_a], minlength=len(n_a)), "n_links": np.bincount(a_unit, n, len(n_a)).astype(np.int64)}
        if named:
            at = self.named_at
            name = np.r_[a_ids + np.where(last_a, at[1], at[0]), b_ids + np.where(last_b, at[3], at[2])]
            order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
            names = list(map(self.named.__getitem__, name[order].tolist()))
            ends = np.cumsum(n_a + n_b).tolist()
            out["groups"] = [b"".join(names[i:j]) for i, j in zip([0, *ends], ends)]
        return out

    def align_slices(self, a_ids: np.ndarray, n_a: np.ndarray, b_ids: np.ndarray, n_b: np.ndarray, named: bool = False, size: int = 100_000) -> Iterator[dict]:
        """`align` for some units after the other, of about `size` tokens or one longer unit, so that what it needs for a
        moment does not grow with the batch."""
        ends, a_end, b_end = np.cumsum(n_a + n_b), np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        i = 0
        while i < len(n_a):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
            yield self.align(a_ids[a_end[i] : a_end[j]], n_a[i:j], b_ids[b_end[i] : b_end[j]], n_b[i:j], named)
            i = j

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[int]]]:
        """The units of each text, as numbers in order and how many; and the A and B ids of the distinct units. Texts
        that a tokenizer does not spell have none."""
        whole = [b" " + t if t else b"" for t in texts]
        joined = b"".join(whole)
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        begin = np.cumsum(sizes) - sizes
        cut = unit_starts(np.frombuffer(joined, np.uint8)) if joined else np.empty(0, bool)
        cut[begin[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.r_[starts, len(joined)].astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
        units, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        counts = np.searchsorted(starts, begin + sizes) - np.searchsorted(starts, begin)
        a, b, good = self.encode(units)
        if not good.all():  # such texts are one unit each
            doc = np.repeat(np.arange(len(texts)), counts)
            odd = np.unique(doc[~good[codes]])
            more_a, more_b, fine = self.encode([whole[i] for i in odd])
            a, b, new = a + more_a, b + more_b, np.zeros(len(texts), np.int64)
            new[odd] = len(units) + np.arange(len(odd))
            counts[odd] = 0
            held = np.repeat(counts > 0, np.bincount(doc, minlength=len(texts)))
            codes, counts = codes[held], counts
            counts[odd[fine]] = 1
            place = np.cumsum(counts) - counts
            codes = np.insert(codes, place[odd[fine]] - np.arange(int(fine.sum())), new[odd[fine]])
        return codes, counts, a, b


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in two or four bytes each, behind that width."""
    kind = np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + planes(x.astype(kind))


def _wide(b: bytes) -> np.ndarray:
    return unplanes(b[1:], np.uint16 if b[0] == 2 else np.uint32).astype(np.int64)


#: Packed rows, of about 2 MB each, that a partition gets on average when they are scored.
SHARDS_TOGETHER = 4

PACKED = "shard long, doc_id array<string>, units array<int>, codes binary, a binary, n_a binary, b binary, n_b binary, pairs array<long>, pair_docs array<int>"
_PACKED = pa.schema(
    [("shard", pa.int64()), ("doc_id", pa.list_(pa.string())), ("units", pa.list_(pa.int32()))]
    + [(k, pa.binary()) for k in ("codes", "a", "n_a", "b", "n_b")]
    + [("pairs", pa.list_(pa.int64())), ("pair_docs", pa.list_(pa.int32()))]
)


def _pair_docs(codes: np.ndarray, counts: np.ndarray, n_links: np.ndarray, link_pair: np.ndarray, n_pairs: int) -> np.ndarray:
    """How many texts link each pair."""
    doc = np.repeat(np.arange(len(counts)), counts)
    once = _distinct(doc * len(n_links) + codes)
    doc, unit = once // len(n_links), once % len(n_links)
    n = n_links[unit]
    linked = link_pair[_ranges((np.cumsum(n_links) - n_links)[unit], n)]
    return np.bincount(_distinct(np.repeat(doc, n) * n_pairs + linked) % n_pairs, minlength=n_pairs)


def encode_batches(a, b, size: int):
    """Arrow batches of (doc_id, text) to one packed row for each batch of about `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = _loaded(a.value, b.value), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(text_chunks(batches, size)):
            codes, counts, a_lists, b_lists = aligner.batch([t or b"" for t in texts])
            (a_ids, n_a), (b_ids, n_b) = _flat(a_lists), _flat(b_lists)
            found = [(x["links"], x["n_links"]) for x in aligner.align_slices(a_ids, n_a, b_ids, n_b)] or [(a_ids, n_a)]
            links, n_links = map(np.concatenate, zip(*found))
            pairs, link_pair = np.unique(links, return_inverse=True)
            docs = _pair_docs(codes, counts, n_links, link_pair, len(pairs)) if len(pairs) else pairs
            packed = {k: _narrow(v) for k, v in (("codes", codes), ("a", a_ids), ("n_a", n_a), ("b", b_ids), ("n_b", n_b))}
            yield one_row(_PACKED, packed | {"shard": part << 32 | k, "doc_id": ids, "units": counts.astype(np.int32), "pairs": pairs, "pair_docs": docs.astype(np.int32)})

    return run


_SCORED = pa.schema(
    [("doc_id", pa.string())] + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.string())]
)


def score_batches(a, b):
    """Packed rows with their pairs' sums to one row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _loaded(a.value, b.value)
        for packed in chain.from_iterable((batch.slice(i, 1) for i in range(batch.num_rows)) for batch in batches):
            row = {c: packed.column(c)[0] for c in packed.schema.names}
            sizes = row["units"].values.to_numpy().astype(np.int64)
            codes, a_ids, n_a, b_ids, n_b = (_wide(row[c].as_py()) for c in ("codes", "a", "n_a", "b", "n_b"))
            pairs = row["pairs"].values.to_numpy()
            count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if len(pairs):
                at = row["told"].values.field("i").to_numpy()
                count[at] = row["told"].values.field("docs").to_numpy()
                best[at] = row["told"].values.field("best").to_numpy(zero_copy_only=False)
            unit, names = {c: [] for c in ("n_groups", "n_links", "n_best", "count_sum")}, []
            for x in aligner.align_slices(a_ids, n_a, b_ids, n_b, named=True):
                pair, stops = np.searchsorted(pairs, x["links"]), np.cumsum(x["n_links"])
                for c, of_pair in (("n_best", best), ("count_sum", count)):
                    sums = np.r_[0, np.cumsum(of_pair[pair])]
                    unit[c].append(sums[stops] - sums[stops - x["n_links"]])
                unit["n_groups"].append(x["n_groups"])
                unit["n_links"].append(x["n_links"])
                names += x["groups"]
            unit = {"n_a": n_a, "n_b": n_b} | {c: np.concatenate(v) if v else n_a for c, v in unit.items()}
            ends, listed = np.cumsum(sizes), codes.tolist()
            cols = []
            for c in _SCORED.names[1:-1]:
                sums = np.r_[0, np.cumsum(unit[c][codes])]
                cols.append(pa.array(sums[ends] - sums[ends - sizes], pa.int64()))
            for lo in range(0, len(sizes), 256):  # a few texts' groups at a time
                hi = min(lo + 256, len(sizes))
                span = zip(sizes[lo:hi].tolist(), ends[lo:hi].tolist())
                groups = [b"".join(map(names.__getitem__, listed[e - n : e]))[:-1].decode() for n, e in span]
                cells = [row["doc_id"].values.slice(lo, hi - lo), *(c.slice(lo, hi - lo) for c in cols), pa.array(groups, pa.string())]
                yield pa.RecordBatch.from_arrays(cells, schema=_SCORED)

    return run


def align_tokens(docs: DataFrame, a_model: str = BPE, b_model: str = PIECES, batch_bytes: int = 1_500_000) -> DataFrame:
    """For each row of (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    A encodes a space and the text by the byte-level BPE, B the text by the SentencePiece model, both whole and without
    special tokens. `groups` lists the ids of each group, `a1,a2|b1;a3|b2,b3`. Links are the pairs of an A and a B token
    whose bytes overlap; a pair of ids counts the rows that hold it linked. n_best are the links whose count is the
    highest of their A id over all rows, ties included; count_sum is the sum of the links' counts.

    Texts that are null, empty or not spelt byte for byte by both sides have no tokens: zeros and an empty `groups`.
    Each input row gives one row and counts as a document of its own, repeated rows and null doc_ids included; other
    columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(a_model, "rb") as a, open(b_model, "rb") as b:  # vocabularies, a few MB
        models = [spark.sparkContext.broadcast(x.read()) for x in (a, b)]
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    packed = written(source.mapInArrow(encode_batches(*models, batch_bytes), PACKED))

    pair = F.explode(F.arrays_zip(F.transform("pairs", lambda p, i: i.cast("int")).alias("i"), F.col("pairs").alias("pair"), F.col("pair_docs").alias("n")))
    held = packed.select("shard", pair.alias("x")).select("shard", "x.i", "x.pair", "x.n")
    docs_of = held.groupBy("pair").agg(F.sum("n").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    most = docs_of.groupBy("a").agg(F.max("docs").alias("most"))
    sums = docs_of.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    told = held.join(sums, "pair").groupBy("shard").agg(F.collect_list(F.struct("i", "docs", "best")).alias("told"))
    # Spark hands Python up to 64 MB of a partition at once, so a partition holds few packed rows, however many there are.
    n = max(parts(spark), -(-packed.count() // SHARDS_TOGETHER))
    out = packed.drop("pair_docs").repartition(n, "shard").join(told.repartition(n, "shard"), "shard", "left").mapInArrow(
        score_batches(*models), "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
