"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source has the same expected number of copies, target over source size. The whole part is taken as
it is; the fraction is an inclusion probability. The flight phase moves probabilities along the null-space of the two
balance constraints (words and documents) until one is 0 or 1, so both totals stay exact. The largest documents are
decided first, each against all others that are undecided, as no two or three could make up for them; the others go
three at a time. The flight runs over chunks of a source, then over what the chunks leave undecided, then over what
those leave; each chunk keeps a few documents open. The landing decides the last ones of a source together: a linear
program gives the distribution over their subsets that has their inclusion probabilities and the least expected error
in words, then in documents, and one subset is drawn from it. (Where a source has so few documents that its words cannot
come near their target so, the program weighs the one against the other.)

All random numbers come from the seed and the chunk, documents go by size, then by a hash: reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import cut, n_words_col
from strandline.operators.ordering import numbered
from strandline.session import ship

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK, FAN_IN = 8192, 1024
LARGE = 256  # documents of a chunk that fly against all others
OPEN = 12  # documents that a chunk leaves open, spread over the smaller ones: their subsets have sums of many sizes
STRAY = 0.01  # share of a source's target that the landing misses rather than stray from an inclusion probability by 1
SALTS = 32


def source_key(source):
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source_size, n_docs, target) from rows with source_key and size. Sources go by code point, null
    last, and get the weights in turn; the sum of all sizes is shared by weight, but no source gets more than `most`
    times its size, and what is above is shared again by weight.

    The share for one unit of weight rises from round to round: sources that it fills are set aside, and the others share
    what is left by weight, until it fills nobody further. A round is one sum over the sources; the driver holds two
    numbers.
    """
    stats = docs.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    stats = numbered(stats, [F.col("source_key") == "n", F.col("source_key")], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int") + 1)
    stats = cut(stats.select("source_key", "source_size", "n_docs", weight.cast("long").alias("w"), (most * F.col("source_size")).alias("cap")))
    share, left = 0.0, None
    while True:
        full = F.col("cap") < share * F.col("w")
        sums = F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("w"))).alias("w")
        r = stats.agg(*sums).first()
        if r["w"] is None or r["w"] == left:
            break
        left = r["w"]
        share = (r["all"] - (r["caps"] or 0)) / left
    target = F.least(share * F.col("w"), F.col("cap").cast("double"))
    return stats.select("source_key", "source_size", "n_docs", target.alias("target"))


def _moved(rng: np.random.Generator, p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """p after a random step along d, forth or back, to where the first of them is 0 or 1; the expected p is p."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(d > 0, (1 - p) / d, np.where(d < 0, -p / d, np.inf))
        down = np.where(d > 0, p / d, np.where(d < 0, (p - 1) / d, np.inf))
    u, v = float(up.min()), float(down.min())
    forth = rng.random() * (u + v) < v
    x = p + (u if forth else -v) * d
    first = int(np.argmin(up if forth else down))
    x[first] = 1.0 if (d[first] > 0) == forth else 0.0
    return np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))


def _against_all(p: np.ndarray, size: np.ndarray, live: np.ndarray, rng: np.random.Generator) -> None:
    """Decide the first LARGE of `live` (p in place): each moves against the undecided ones, in proportion to what these
    can move, with the sums of p and p * size unchanged."""
    for a in live[:LARGE]:
        while 0 < p[a] < 1:
            rest = live[(p[live] > 0) & (p[live] < 1) & (live != a)]
            w, s = p[rest] * (1 - p[rest]), size[rest]
            sums = np.array([[w.sum(), w @ s], [w @ s, w @ (s * s)]])
            if len(rest) < 2 or np.linalg.det(sums) <= 1e-9 * sums[0, 0] * sums[1, 1]:
                break
            alpha, beta = np.linalg.solve(sums, np.array([1.0, size[a]]))
            at = np.r_[a, rest]
            p[at] = _moved(rng, p[at], np.r_[1.0, -w * (alpha + beta * s)])


def _by_three(p: np.ndarray, size: np.ndarray, live: np.ndarray, rng: np.random.Generator) -> None:
    """Decide all but two or fewer of `live` (p in place), three at a time."""
    u = rng.random(len(live) + 1).tolist()
    live, pi, s, k = live.tolist(), p.tolist(), size.tolist(), 0
    window, nxt = live[:3], 3
    while len(window) == 3:
        a, b, c = window
        d = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if d == (0.0, 0.0, 0.0):
            d = (1.0, -1.0, 0.0)
        up, down = np.inf, np.inf
        for i, v in zip(window, d):
            if v > 0:
                up, down = min(up, (1 - pi[i]) / v), min(down, pi[i] / v)
            elif v < 0:
                up, down = min(up, pi[i] / -v), min(down, (1 - pi[i]) / -v)
        step = up if u[k] * (up + down) < down else -down
        k += 1
        keep = []
        for i, v in zip(window, d):
            x = pi[i] + step * v
            pi[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            if 0 < pi[i] < 1:
                keep.append(i)
        if len(keep) == 3:  # rounding only; the nearest one lands
            i = min(keep, key=lambda j: min(pi[j], 1 - pi[j]))
            pi[i] = float(round(pi[i]))
            keep.remove(i)
        take = min(3 - len(keep), len(live) - nxt)
        window = keep + live[nxt : nxt + take]
        nxt += take
        if k >= len(u):
            u += rng.random(1024).tolist()
    p[live] = np.array(pi)[live]


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, hold: bool = False) -> np.ndarray:
    """Move probabilities to 0 or 1 with the sums of p and p * size unchanged, until two or fewer are between. Documents
    are given in order of size. With `hold`, OPEN of the smaller ones stay as they are, but for the three smallest."""
    p, size = p.astype(float).copy(), size.astype(float)
    live = np.flatnonzero((p > 0) & (p < 1))
    if hold and len(live) <= OPEN + 2:  # a small landing problem as it is
        return p
    # From the fourth smallest on: of the smaller half, or all the others where there are few.
    last = max(len(live) // 2 + 2, min(len(live) - 1, OPEN + 2))
    held = np.unique(np.linspace(3, last, OPEN).round().astype(int)) if hold else np.empty(0, int)
    held = held[held < len(live)]
    live = np.delete(live, held)[::-1]
    _against_all(p, size, live, rng)
    _by_three(p, size, live[(p[live] > 0) & (p[live] < 1)], rng)
    return p


def landing_law(p: np.ndarray, size: np.ndarray, target: float, stray: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Subsets (rows of 0 and 1) and their probabilities, of the law on the subsets of a few documents with the least
    expected distance from the expected words, as a share of `target`, and from their number, plus `stray` for each 1 by
    which the law misses the inclusion probabilities p. Where the words can be met at all, p is kept.

    A linear program with one row for each document and one for the sum, solved by the revised simplex method. It starts
    at the law that takes the documents of highest p first."""
    n, stray = len(p), STRAY if stray is None else stray
    subsets = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    words = np.abs(subsets @ size - p @ size) / max(target, 1.0)
    cost = words + 1e-6 * np.abs(subsets.sum(1) - p.sum())
    slack = np.c_[np.r_[np.eye(n), -np.eye(n)], np.zeros(2 * n)]
    rows, cost = np.r_[np.c_[subsets, np.ones(1 << n)], slack], np.r_[cost, np.full(2 * n, stray)]
    by = np.argsort(-p, kind="stable")
    base = np.r_[0, np.cumsum(1 << by)]  # none, the first, the first two, ...
    x, want = -np.diff(np.r_[1.0, p[by], 0.0]), np.r_[p, 1.0]
    for turn in range(200 * (n + 1)):
        inverse = np.linalg.inv(rows[base].T)
        reduced = cost - rows @ (cost[base] @ inverse)
        # The steepest column; late on the first one, which cannot go round in circles.
        new = int(np.argmin(reduced)) if turn < 100 * (n + 1) else int(np.argmax(reduced < -1e-12))
        if reduced[new] >= -1e-12:
            break
        step = inverse @ rows[new]
        able = np.flatnonzero(step > 1e-10)
        ratio = np.maximum(x[able], 0.0) / step[able]
        out = able[ratio <= ratio.min() + 1e-15]
        base[out[np.argmin(base[out])]] = new
        x = np.linalg.solve(rows[base].T, want)
    real = base < 1 << n
    x = np.maximum(x[real], 0.0)
    return subsets[base[real]], x / x.sum()


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, target: float) -> np.ndarray:
    """Decide the few that are left, by a draw from `landing_law`."""
    p, live = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(live):
        subsets, law = landing_law(p[live], size[live], target)
        p[live] = subsets[min(int(np.searchsorted(np.cumsum(law), rng.random(), "right")), len(law) - 1)]
    return p


def _level(last: bool, seed: int, level: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["size", "order", "id_text", "text_hash"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(pdf["chunk"].iat[0]), *key[0].encode()])
        size = pdf["size"].to_numpy(float)
        p = flight(pdf["p"].to_numpy(), size, rng, hold=True)
        pdf["p"] = landing(p, size, rng, float(pdf["target"].iat[0])) if last else p
        return pdf

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 29) -> DataFrame:
    """How often the mix takes each document: doc_id, source_key, text_hash, size (words), source_size, target (its
    source's), copies (0 to `most`) and taken (copies times size).

    The sources share 100 % of all words by weight; see `source_targets`. Null and empty texts have size 0. A null
    source is a source, last in order; a null doc_id is an ordinary value. Repeated rows are separate documents. An
    empty table gives an empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    base = docs.select(
        F.col("doc_id"),
        source_key(F.col("source")).alias("source_key"),
        n_words_col(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    base = cut(base)
    targets = source_targets(base, weights, most).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = base.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    df = df.withColumn("salt", F.pmod(F.col("order"), F.lit(SALTS)).cast("int"))
    df = df.join(targets, ["source_key", "salt"]).drop("salt")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    df = df.withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.col("whole"))
    df = df.withColumn("id_text", F.col("doc_id").cast("string"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", chunk long"
    columns = [*df.columns, "chunk"]
    chunks = F.ceil(F.col("n_docs") / CHUNK)
    spread = F.pmod(F.xxhash64("order", "size", "text_hash", F.lit(1)), chunks)
    done = []
    for level in range(3):
        last = level == 2
        chunk = spread if level == 0 else F.floor(F.col("chunk") / FAN_IN).cast("long") if not last else F.lit(0).cast("long")
        df = df.withColumn("chunk", chunk.cast("long")).select(*columns)
        df = cut(df.groupBy("source_key", "chunk").applyInPandas(_level(last, seed, level), schema))
        if not last:
            open_ = (F.col("p") > 0) & (F.col("p") < 1)
            done.append(df.where(~open_))
            df = df.where(open_)
    for d in done:
        df = df.unionByName(d)
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    out = df.select("doc_id", "source_key", "text_hash", "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each input row as often as `mix_sources` says, with the input's columns."""
    mix = mix_sources(docs, **options)
    keys = {"_k": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_s": F.col("source_key"), "_t": F.col("text_hash")}
    counts = mix.select(*(c.alias(n) for n, c in keys.items()), "copies")
    counts = counts.groupBy("_k", "_s", "_t").agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    names = docs.columns
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_k"),
        source_key(F.col("source")).alias("_s"),
        F.xxhash64(F.col("text").cast("string")).alias("_t"),
        F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names))).alias("_row"),
    )
    # Rows that are equal in all three get the counts of their group one each, in order of their other columns.
    others = [F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names) if n not in ("doc_id", "source", "text")]
    nth = Window.partitionBy("_k", "_s", "_t").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    joined = rows.join(counts, ["_k", "_s", "_t"]).withColumn("_n", F.row_number().over(nth))
    times = F.element_at("_copies", F.col("_n")).cast("int")
    out = joined.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return out.select(*(F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)))
