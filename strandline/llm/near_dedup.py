"""Near-duplicate detection with b-bit MinHash.

A document's set is its distinct word shingles. Equal sets form a class, represented by its smallest doc_id. Of each
class 128 minima are taken; four in a row hash to a band key, and the low 4 bits of each are packed into a signature of
512 bits. Classes that share a band are candidates; equal bits, corrected for chance collisions, estimate the
similarity, and what may reach the threshold is confirmed on the full sets.

With 32 bands of 4 minima a pair at similarity 0.8 shares no band with a probability of 5e-8, and the estimate is
refused only 6 standard deviations below the threshold.

Only components are wanted, so no stage makes the pairs of a group. The members of a band are dealt into blocks; a task
walks a block's graph of estimates breadth first and returns a spanning forest. The components of all forests join most
of what belongs together, as the blocks of different bands cut a group differently. In a band of several blocks every
pair of two components is then still open, so the members outside the band's largest component, and only these, are
compared with all members of the band. The components after that are clusters that hold every pair that may be linked.
A cluster's texts are linked in the same way, by confirmed links, in a few blockings of the cluster and then between
what these leave apart. So each pair that shares a band meets in some task, unless its ends are already joined, and a
group of near copies is read a few times, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, encode_all, mix64, window_hashes, window_starts, word_hashes
from strandline.llm.token_counts import batches
from strandline.operators.graph import components
from strandline.operators.ordering import broadcast_if_small
from strandline.session import ship

MINIMA, BANDS, BITS = 128, 32, 4
ROWS = MINIMA // BANDS
_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(1, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
MARGIN = 0.25  # the estimate may be this far below the threshold
BLOCK = 2048  # members of a band in a block
TEXT_BLOCK, SHINGLE_BLOCK = 256, 1_000_000  # texts of a cluster in a block, and about the shingles in these
BLOCKINGS = 3  # ways of dealing a cluster's texts into blocks before what is left apart is compared
SIGNED = "doc_id long, n long, k1 long, k2 long, sig array<long>, bands array<long>"


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; A-Z is lower-cased. A text with fewer words has one."""
    h, counts = word_hashes([t.lower() for t in texts])
    flat, doc, _ = window_starts(counts, words)
    wh = window_hashes(h, words)[flat] if len(flat) else np.empty(0, np.uint64)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    offset = np.cumsum(counts) - counts
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= words:
            out.append(np.unique(wh[cuts[i] : cuts[i + 1]]))
        else:
            out.append(window_hashes(h[offset[i] : offset[i] + n], n) if n else np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(29)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 2048):
        np.minimum(out, (x[s : s + 2048] * _A + _B).min(axis=1), out=out)
    return out


def signatures(texts: list[bytes], words: int):
    """n, two set hashes, packed signature (n x 8) and band keys (n x BANDS) of each text."""
    sets = shingle_sets(texts, words)
    n = np.array([len(s) for s in sets], np.int64)
    k1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    k2 = np.array([np.bitwise_xor.reduce(mix64(s * np.uint64(0x9FB21C651E98DF25))) if len(s) else 0 for s in sets], np.uint64)
    m = np.array([minima(s) for s in sets], np.uint64).reshape(len(sets), MINIMA)
    place = np.arange(MINIMA, dtype=np.uint64)
    low = mix64(m + place * np.uint64(0xD1342543DE82EF95)) & np.uint64(15)
    per = 64 // BITS
    shifts = (np.arange(per) * BITS).astype(np.uint64)
    sig = (low.reshape(len(sets), -1, per) << shifts).sum(axis=2, dtype=np.uint64)
    band = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        band = mix64(band * np.uint64(0x9FB21C651E98DF25) + m[:, r::ROWS])
    band = mix64(band + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return n, k1, k2, sig, band


def _sign(words: int, chars: int = 4_000_000):
    def run(stream):
        for batch in stream:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts, chars):
                n, k1, k2, sig, band = signatures(encode_all(texts[a:b]), words)
                lists = [
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel())
                    )
                    for x in (sig, band)
                ]
                cols = [ids.slice(a, b - a), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "k1", "k2", "sig", "bands"])

    return run


def _least_matches(threshold: float) -> int:
    chance = 2.0**-BITS
    return int(MINIMA * (max(threshold - MARGIN, 0.0) * (1 - chance) + chance))


def _pack_text(frames):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for pdf in frames:
        raw = encode_all(pdf["text"])
        yield pdf[["node", "cluster"]].assign(n=[len(x) // 4 for x in raw], t=[pack(x) for x in raw])


def _forest(n: int, linked) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of a graph on 0..n-1. linked(x, rest): which of `rest` are x's neighbours."""
    rest, a_out, b_out = np.arange(n), [], []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = linked(x, rest)
            found = rest[hit]
            if len(found):
                a_out.append(np.full(len(found), x))
                b_out.append(found)
                rest = rest[~hit]
                queue.extend(found.tolist())
    return a_out, b_out


def _groups(pdf: pd.DataFrame, keys: list[str]):
    """The frame in order of the keys, and where each group begins and ends."""
    pdf = pdf.sort_values([*keys, "node"]).reset_index(drop=True)
    if not len(pdf):
        return pdf, []
    change = np.zeros(len(pdf) - 1, bool)
    for k in keys:
        v = pdf[k].to_numpy(np.int64)
        change |= v[1:] != v[:-1]
    cuts = np.flatnonzero(np.r_[True, change]).tolist()
    return pdf, list(zip(cuts, [*cuts[1:], len(pdf)]))


def _edges(a_out: list, b_out: list) -> pd.DataFrame:
    none = np.empty(0, np.int64)
    return pd.DataFrame({"a": np.concatenate([none, *a_out]), "b": np.concatenate([none, *b_out])})


def _walks(prepare, keys: list[str]):
    """Spanning forests of the blocks of a frame. prepare(frame) gives graph(start, end), and that linked(x, rest)."""

    def run(pdf):
        pdf, groups = _groups(pdf, keys)
        node, graph, a_out, b_out = pdf["node"].to_numpy(np.int64), prepare(pdf), [], []
        for s, e in groups:
            a, b = _forest(e - s, graph(s, e))
            a_out += [node[s + x] for x in a]
            b_out += [node[s + x] for x in b]
        return _edges(a_out, b_out)

    return run


def _meetings(prepare, keys: list[str]):
    """Links of the rows of a frame that are `open` with rows of other components: one for each of these that it finds."""

    def run(pdf):
        pdf, groups = _groups(pdf, keys)
        node, graph, a_out, b_out = pdf["node"].to_numpy(np.int64), prepare(pdf), [], []
        comp, is_open = pdf["comp"].to_numpy(np.int64), pdf["open"].to_numpy(bool)
        for s, e in groups:
            linked, place = graph(s, e), np.arange(e - s)
            for x in np.flatnonzero(is_open[s:e]).tolist():
                rest = place[comp[s:e] != comp[s + x]]
                found = rest[linked(x, rest)] if len(rest) else rest
                if len(found):
                    _, first = np.unique(comp[s + found], return_index=True)
                    a_out.append(np.full(len(first), node[s + x]))
                    b_out.append(node[s + found[first]])
        return _edges(a_out, b_out)

    return run


def _estimates(least: int):
    """The graph of estimates of the rows' signatures."""

    def prepare(pdf):
        sig = np.stack(pdf["sig"].to_list()).astype(np.int64).view(np.uint64) if len(pdf) else None

        def graph(s, e):
            def linked(x, rest):
                z = sig[s + rest] ^ sig[s + x]
                z |= z >> np.uint64(1)
                z = (z | (z >> np.uint64(2))) & np.uint64(0x1111111111111111)
                return MINIMA - np.bitwise_count(z).sum(axis=1, dtype=np.int64) >= least

            return linked

        return graph

    return prepare


def _confirmations(percent: int, words: int):
    """The graph of confirmed links of the rows' texts."""

    def prepare(pdf):
        import zstandard

        unpack, sets = zstandard.ZstdDecompressor().decompress, []
        for s in range(0, len(pdf), 256):
            sets += shingle_sets([unpack(t) for t in pdf["t"].iloc[s : s + 256]], words)

        def graph(s, e):
            own = sets[s:e]
            size = np.array([len(x) for x in own])
            values, owner = np.concatenate(own), np.repeat(np.arange(e - s), size)
            by = np.argsort(values, kind="stable")
            values, owner = values[by], owner[by]

            def linked(x, rest):
                low, high = np.searchsorted(values, own[x], "left"), np.searchsorted(values, own[x], "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[at], minlength=e - s)[rest]
                return (both > 0) & (100 * both >= percent * (size[x] + size[rest] - both))

            return linked

        return graph

    return prepare


def _joined(rows: DataFrame, key: str, most: int, weight: int, blockings: int, prepare, groups) -> DataFrame:
    """components() of the graphs on the rows (node, n, and what `prepare` reads) of each key, in blocks of about `most`
    rows and a sum of n of about `weight`. `groups`: into how many tasks to deal the blocks."""
    sizes = rows.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n") / weight)).cast("int").alias("blocks"))
    large = cut(sizes.where("blocks > 1"))
    rows = rows.join(broadcast_if_small(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    def block_of(way, blocks):
        return F.pmod(F.xxhash64("node", key, way), blocks).cast("int")

    way = F.explode(F.sequence(F.lit(1), F.when(F.col("blocks") > 1, blockings).otherwise(1)))
    blocks = rows.withColumn("way", way).withColumn("block", block_of(F.col("way"), F.col("blocks")))
    blocks = blocks.withColumn("grp", F.pmod(F.xxhash64(key, "way", "block"), groups))
    keys = [key, "way", "block"]
    forests = components(blocks.groupBy("grp").applyInPandas(_walks(prepare, keys), "a long, b long"))

    if large.isEmpty():
        return forests
    # Between the components that a key's blocks have left apart.
    comp = rows.where("blocks > 1").join(forests, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    shares = comp.groupBy(key, "comp").agg(F.count("*").alias("k"))
    major = shares.groupBy(key).agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all")).where("m.k < all")
    major = major.select(key, F.col("m.comp").alias("major"), (F.col("all") - F.col("m.k")).alias("n_open"))
    apart = comp.join(major, key).withColumn("open", F.col("comp") != F.col("major"))
    open_blocks = F.ceil(F.col("n_open") * F.col("blocks") / (F.col("n_open") + F.lit(most))).cast("int")
    apart = apart.withColumn("open_blocks", F.greatest(F.lit(1), F.least(open_blocks, F.col("blocks"))))
    # Each open row meets each block of the band's rows once: blocks of open rows by blocks of all rows.
    rest = apart.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1))).withColumn("block", block_of(F.lit(0), F.col("blocks"))).withColumn("open", F.lit(False))
    opened = apart.where("open").withColumn("way", block_of(F.lit(-1), F.col("open_blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = rest.unionByName(opened).withColumn("grp", F.pmod(F.xxhash64(key, "way", "block"), groups))
    found = met.groupBy("grp").applyInPandas(_meetings(prepare, keys), "a long, b long")
    return components(found.unionByName(forests.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_components(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row: documents whose sets of `words`-word shingles have
    100 * intersection >= `percent` * union are linked, and a component is known by its smallest doc_id, the one kept.

    A text with fewer words has its whole sequence as its one shingle; null and empty texts have none and are linked
    with nothing. Rows that share a doc_id are one document and belong to one component, whatever their texts. A row
    without doc_id is linked with nothing: its component_id is null and it is kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    least = _least_matches(percent / 100)
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(source.mapInArrow(_sign(words), SIGNED))
    groups = F.lit(max(16, signed.count() // 2048))
    key = ["k1", "k2", "n"]
    classes = signed.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes)

    # Bands that several classes share, and the clusters of what may be similar in them.
    members = classes.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band")
    members = members.join(shared, "band").join(classes.select("node", "sig"), "node").withColumn("n", F.lit(0))
    clusters = _joined(members, "band", BLOCK, 1, 1, _estimates(least), groups)
    heads = clusters.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct()
    clusters = clusters.withColumnRenamed("component", "cluster").unionByName(heads)

    # The links among a cluster's texts.
    texts = clusters.join(source.withColumnRenamed("doc_id", "node"), "node")
    texts = cut(texts.mapInPandas(_pack_text, "node long, cluster long, n long, t binary"))
    confirmed = _joined(texts, "cluster", TEXT_BLOCK, SHINGLE_BLOCK, BLOCKINGS, _confirmations(percent, words), groups)
    confirmed = confirmed.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = signed.where("n > 0").select("doc_id", *key).join(classes.select(*key, "node"), key)
    twice = links.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b").select("doc_id")
    same_id = links.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    comps = components(confirmed.unionByName(same_id))

    named = classes.select(*key, "node").join(comps, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", *key).join(named, key, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    lone = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lone = lone.mapInArrow(_sign(words), SIGNED).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The input rows, with their own columns, of the documents kept: one of each group. Of rows that share a doc_id,
    all stay or go together."""
    gone = near_components(docs, percent, words).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
