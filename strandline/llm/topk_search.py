"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks. In a block every dimension has its list of rows in order of value; the lists are built
once and kept. For a query the lists are read from the end that its sign favours; each row seen is scored in full, and
reading stops when the sum of the lists' current values, the bound on all rows not yet seen, cannot beat the k-th best.

A query first searches one block, its home. The k-th score found there is a floor for the k-th best of all, and goes
with the query to the other blocks: a block whose bound is below it is left unread, reading stops against it elsewhere,
and only rows that reach it come back. A task holds one block of vectors and one block of queries; the results are
merged by window rank, limited before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import cut
from strandline.session import ship

BLOCK, QUERY_BLOCK = 4096, 8192
LISTS = "dim int, block long, n int, width int, ids binary, x binary, places binary"
FOUND = "query_id long, vec_id long, score long"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
NONE = HIGHEST  # no row, among a vector's ids


def quantised(embedding, scale: int = 256):
    """floor(scale * x) for each component, as a double, which holds it exactly at every size; null where the vector
    takes no part. (A component whose multiple is over the largest double, 1.8e308, counts as that.)"""
    as_double = F.transform(embedding.cast("array<double>"), lambda x: x * scale)
    # Null fails no comparison below, so it is asked for by name.
    bad = F.exists(embedding.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.lit(1.7976931348623157e308)
    whole = F.transform(as_double, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, most), -most)))
    return F.when(embedding.isNotNull() & ~bad, whole)


def _integers(x: np.ndarray) -> np.ndarray:
    """Integers as int64, or as Python's where they are larger."""
    if x.dtype != np.float64:
        return x.astype(np.int64)
    if np.abs(x).max(initial=0.0) < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


class Lists:
    """The sorted per-dimension lists of a block; equal vectors are one row with their smallest ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        x, group = np.unique(x, axis=0, return_inverse=True)
        group = group.ravel()
        by = np.lexsort((ids, group))
        g, ids = group[by], ids[by]
        begins = np.r_[True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])] if len(g) else np.empty(0, bool)
        copy = np.arange(len(g)) - np.maximum.accumulate(np.where(begins, np.arange(len(g)), 0))
        g, ids = g[copy < k], ids[copy < k]  # more copies of a row cannot enter
        place = np.arange(len(g)) - np.searchsorted(g, g)
        some = place < 2 * k  # as k of them may be the query itself
        self.ids = np.full((len(x), place[some].max(initial=0) + 1), NONE)
        self.ids[g[some], place[some]] = ids[some]
        self.raw, self.order = x, np.argsort(x, axis=0, kind="stable").astype(np.uint16 if len(x) <= 1 << 16 else np.int64)
        self._open()

    def _open(self):
        self.x = _integers(self.raw)
        self.values = np.take_along_axis(self.x, self.order.astype(np.int64), axis=0)
        self.exact = self.raw.astype(float)
        self.largest = int(np.abs(self.x).max(initial=0))

    def packed(self) -> tuple:
        return len(self.raw), self.ids.shape[1], self.ids.tobytes(), self.raw.tobytes(), self.order.tobytes()

    @classmethod
    def unpacked(cls, row, kind) -> Lists:
        self = cls.__new__(cls)
        self.ids = np.frombuffer(row.ids, np.int64).reshape(row.n, row.width)
        self.raw = np.frombuffer(row.x, kind).reshape(row.n, row.dim)
        self.order = np.frombuffer(row.places, np.uint16 if row.n <= 1 << 16 else np.int64).reshape(row.n, row.dim)
        self._open()
        return self

    def _scores(self, rows: np.ndarray, q: np.ndarray, exactness: int) -> np.ndarray:
        if exactness == 0:
            return (self.exact[rows] @ q.astype(float)).astype(np.int64)
        if exactness == 1:
            return self.x[rows] @ q
        exact = self.x[rows].astype(object) @ q.astype(object) if len(q) else np.zeros(len(rows), object)
        return np.array([min(max(v, LOWEST), HIGHEST) for v in exact], np.int64)

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k rows other than `own` that reach `floor`, and how many rows were scored."""
        n = len(self.x)
        most = self.largest * int(np.abs(q).max(initial=0)) * len(q)
        exactness = 0 if most < 1 << 52 else 1 if most < 1 << 62 else 2
        lists, side = (self.values, q) if exactness < 2 else (self.values.astype(object), q.astype(object))
        rise, fall = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, scored = 0, 0
        while depth < n:
            # The bound on the rows not seen; at equality one of them could win by its id.
            bound = sum((lists[n - 1 - depth, rise] * side[rise]).tolist()) + sum((lists[depth, fall] * side[fall]).tolist())
            bound = min(max(int(bound), LOWEST), HIGHEST)
            if floor is not None and bound < floor or len(scores) == k and bound < scores[-1]:
                break
            upto = n if not len(rise) and not len(fall) else min(n, max(8, depth * 4))
            if upto == n:
                new = np.flatnonzero(~seen)
            else:
                touched = np.zeros(n, bool)
                touched[self.order[n - upto : n - depth, rise]] = True
                touched[self.order[depth:upto, fall]] = True
                new = np.flatnonzero(touched & ~seen)
            seen[new] = True
            scored += len(new)
            s = self._scores(new, q, exactness)
            least = floor if len(scores) < k else max(int(scores[-1]), floor if floor is not None else LOWEST)
            if least is not None:  # rows below the k-th best cannot enter
                new, s = new[s >= least], s[s >= least]
            more, again = self.ids[new].ravel(), np.repeat(s, self.ids.shape[1])
            real = (more != NONE) & (more != own)
            ids, scores = np.r_[ids, more[real]], np.r_[scores, again[real]]
            best = np.lexsort((ids, ~scores))[:k]  # ~ reverses the order without overflow
            ids, scores = ids[best], scores[best]
            depth = upto
        return ids, scores, scored


def _build(k: int, kind):
    def run(key, vectors):
        copies = np.minimum(vectors["copies"].to_numpy(np.int64), k)
        ids = np.repeat(vectors["vec_id"].to_numpy(np.int64), copies)
        x = np.stack(vectors["x"].to_list()).astype(kind).reshape(len(vectors), key[0])
        return pd.DataFrame([(*key, *Lists(ids, np.repeat(x, copies, axis=0), k).packed())], columns=[c.split()[0] for c in LISTS.split(", ")])

    return run


def _vectors(queries: pd.DataFrame, kind):
    for r in queries.itertuples():
        yield r, _integers(np.asarray(r.x, kind))


def _at_home(k: int, kind):
    """Each query's best in its home block, and the floor that follows."""

    def run(key, blocks, queries):
        out, lists = [], [Lists.unpacked(r, kind) for r in blocks.itertuples()]
        for r, q in _vectors(queries, kind):
            ids, scores, _ = lists[0].search(q, r.query_id, k) if lists else (np.empty(0, np.int64),) * 2 + (0,)
            out.append((r.dim, r.query_id, r.x, r.copies, key[1], scores[-1] if len(scores) == k else None, ids, scores))
        names = ["dim", "query_id", "x", "copies", "home", "floor", "vec_ids", "scores"]
        return pd.DataFrame(out, columns=names).astype({"floor": "Int64"})

    return run


def _elsewhere(k: int, kind):
    def run(key, blocks, queries):
        ids, vec_ids, scores = [], [], []
        for b in blocks.itertuples():
            lists = Lists.unpacked(b, kind)
            for r, q in _vectors(queries, kind):
                v, s, _ = lists.search(q, r.query_id, k, None if pd.isna(r.floor) else int(r.floor))
                for _ in range(int(r.copies)):
                    ids.append(np.full(len(v), r.query_id))
                    vec_ids.append(v)
                    scores.append(s)
        none = np.empty(0, np.int64)
        return pd.DataFrame({"query_id": np.concatenate([none, *ids]), "vec_id": np.concatenate([none, *vec_ids]), "score": np.concatenate([none, *scores])})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of `vectors` for each row of `queries` (both: vec_id, x: integers as array<long> or array<double>)
    by inner product, without rows of the query's own vec_id; ties go to the smaller vec_id. Returns query_id, rank
    (from 1), vec_id, score.

    Every finite component takes part; products are exact at every size, and a score beyond 64 bits is given, and ranked,
    as the largest or smallest long. Fewer than k candidates give fewer rows. Vectors of another length than the query's
    take no part for it. Rows with a null vec_id or vector take no part. Rows that repeat a vec_id are rows of their own,
    with a rank each, and rows of `queries` that share a vec_id put all their scores into one ranking, as in the SQL.
    Equal rows are counted before they are dealt out. Other columns are ignored; an empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    long = all("bigint" in f.schema["x"].dataType.simpleString() for f in (vectors, queries))
    kind, sql = (np.int64, "array<bigint>") if long else (np.float64, "array<double>")

    def rows(df):
        df = df.where("vec_id is not null and x is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast(sql).alias("x"))
        counted = df.groupBy("vec_id", "x").agg(F.count("*").alias("copies"))
        return cut(counted.select("*", F.size("x").alias("dim")))

    vectors, queries = rows(vectors), rows(queries)
    blocks = max(1, -(-vectors.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks).cast("long"))
    lists = cut(vectors.withColumn("block", block).groupBy("dim", "block").applyInPandas(_build(k, kind), LISTS))
    asked = queries.select("dim", F.col("vec_id").alias("query_id"), "x", F.least("copies", F.lit(k)).alias("copies"), block.alias("block"))
    home = lists.groupBy("dim", "block").cogroup(asked.groupBy("dim", "block"))
    home = cut(home.applyInPandas(_at_home(k, kind), f"dim int, query_id long, x {sql}, copies long, home long, floor long, vec_ids array<long>, scores array<long>"))
    query_block = F.pmod(F.xxhash64("query_id", "x", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block")
    asked = home.select(
        "dim", "query_id", "x", "copies", "floor", "home", query_block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    ).where("block <> home")
    keys = ["dim", "block", "query_block"]
    read = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    found = read.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_elsewhere(k, kind), FOUND)
    first = home.select("query_id", "copies", F.explode(F.arrays_zip("vec_ids", "scores")).alias("f"))
    first = first.select("query_id", "f", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    found = found.unionByName(first.select("query_id", F.col("f.vec_ids").alias("vec_id"), F.col("f.scores").alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
