"""The best passages of each claim by a score that adds up over shared tokens, without scoring every pair that shares one.

Passages lie in blocks of equal tags and marker and of like size, so all that a block adds to a claim's score without
tokens is known, and a shared token adds the same to a claim's score at most anywhere in the block. A first score for
each claim, from the shortest passages that hold one of its tokens, gives the score that its k-th best reaches at least.
Where even m shared tokens cannot lift a block's passage to it, a better passage shares more than m tokens, so one of all
but the claim's m most frequent ones: only these are looked up in the block's postings.

The number of blocks is bounded by the tags (128), the marker (2) and twice the binary logarithm of a passage's tokens.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import scores as S
from strandline.operators.graph import checkpointed
from strandline.operators.ordering import broadcast_if_small

#: The weights of the parts of a link's score.
PATH, SYMBOL, SEMANTIC, HINT, IDENTIFIER, MARKER = 0.20, 0.20, 0.20, 0.15, 0.20, 0.05
DIRECT_ROWS = 20_000_000  # up to so many rows of postings that meet a claim, all pairs are summed at once
GUESS = 1.4  # how far above the first floors the true ones are taken to be
_SLACK = 1e-8  # scores are rounded to nine digits
_BLOCK = ["tags", "marker", "size"]


def _semantic(tags: Column, c_tags: Column) -> Column:
    return S.ratio(F.bit_count(tags.bitwiseAND(c_tags)), F.bit_count(c_tags))


def _weighted(h: Column, p: Column, u: Column) -> Column:
    """The six-part score of a passage (n words, tags, marker) and a claim (c_n words, c_tags, c_marker) that share h words
    of the text, p of the path and u of both together."""
    def share(x):
        return S.ratio(x, F.col("c_n"))

    parts = PATH * share(p) + SYMBOL * share(h) + SEMANTIC * _semantic(F.col("tags"), F.col("c_tags")) + HINT * share(u)
    return F.round(parts + IDENTIFIER * S.ratio(h, F.col("n")) + MARKER * (F.col("marker") * F.col("c_marker")), 9)


def link_score() -> Column:
    """`_weighted` of the arrays ts, path and c_ts; ts and path need only hold words that some claim has."""
    h = F.size(F.array_intersect("ts", "c_ts"))
    return _weighted(h, F.size(F.array_intersect("path", "c_ts")), h + F.size(F.array_intersect(F.array_except("path", "ts"), "c_ts")))


def _without_tokens() -> Column:
    return SEMANTIC * _semantic(F.col("tags"), F.col("c_tags")) + MARKER * (F.col("marker") * F.col("c_marker"))


def _most_of(m: Column) -> Column:
    """The most that m shared tokens add in a block: two of them may stand in the path too."""
    return ((SYMBOL + HINT) * m + PATH * F.least(m, F.lit(2))) / F.col("c_n") + IDENTIFIER * F.least(F.lit(1.0), m / F.col("low"))


def postings(passages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, doc_id, tags, marker, size, n, in_path, new): the passages that hold each word of the vocabulary (word,
    token), once for the text and once for the path; new unless the text has the path's word."""
    size = F.floor(2 * F.log2(F.greatest(F.size("ts"), F.lit(1)))).cast("int")

    def cells(words, in_path, new):
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(in_path).alias("in_path"), new(w).alias("new")))

    word = F.explode(F.concat(cells("ts", False, lambda w: F.lit(True)), cells("path", True, lambda w: ~F.array_contains("ts", w)))).alias("x")
    every = passages.select("doc_id", "tags", "marker", F.size("ts").alias("n"), size.alias("size"), word).select("*", "x.*").drop("x")
    return every.join(broadcast_if_small(vocabulary), "word").drop("word")


def essential_tokens(index: DataFrame, claims: DataFrame, floor: DataFrame) -> DataFrame:
    """(item_id, token, tags, marker, size): the tokens that a claim must look up in each block. index: postings;
    floor: (item_id, floor), the score that a claim's k-th best reaches at least."""
    frequency = index.groupBy("token").agg(F.count("*").alias("df"))
    mine = claims.select("item_id", "c_tags", "c_marker", "c_n", F.explode("c_ts").alias("token")).join(frequency, "token")
    mine = mine.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "token")))
    mine = mine.withColumn("held", F.count("*").over(Window.partitionBy("item_id"))).join(floor, "item_id", "left")
    blocks = index.groupBy("token", *_BLOCK).agg(F.lit(1).alias("one")).join(index.groupBy(*_BLOCK).agg(F.greatest(F.min("n"), F.lit(1)).alias("low")), _BLOCK)
    need = F.coalesce("floor", F.lit(0.0)) - _without_tokens() - _SLACK
    few = F.filter(F.sequence(F.lit(0), F.col("held").cast("int")), lambda m: _most_of(m) < F.col("need"))
    found = broadcast_if_small(mine).join(blocks, "token").withColumn("need", need)
    # `few` are the counts of shared tokens that do not suffice; no token is left out if none at all suffices.
    return found.where(F.col("rank") <= F.col("held") - F.greatest(F.size(few) - 1, F.lit(0))).select("item_id", "token", *_BLOCK)


def _tagged_alike(passages: DataFrame, claims: DataFrame, floor: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id) of passages that reach a claim's floor without any shared token. Those of equal tags and marker
    have equal scores, so the k first and k last by doc_id stand for all."""
    by = Window.partitionBy("tags", "marker")
    alike = passages.select("doc_id", "tags", "marker").where("tags <> 0 OR marker <> 0")
    first = alike.withColumn("place", F.row_number().over(by.orderBy("doc_id"))).where(F.col("place") <= k)
    last = alike.withColumn("place", F.row_number().over(by.orderBy(F.desc("doc_id")))).where(F.col("place") <= k)
    ends = first.unionByName(last).drop("place")
    wanted = claims.select("item_id", "c_tags", "c_marker").join(floor, "item_id", "left")
    key = F.explode(F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(F.getbit("own", i) == 1, i)), lambda i: i.isNotNull()), F.when(F.col("mark") == 1, F.array(F.lit(7))).otherwise(F.array().cast("array<int>")))))
    ends = ends.withColumns({"own": F.col("tags"), "mark": F.col("marker")}).select("doc_id", "tags", "marker", key.alias("key"))
    wanted = wanted.withColumns({"own": F.col("c_tags"), "mark": F.col("c_marker")}).select("item_id", "c_tags", "c_marker", "floor", key.alias("key"))
    pairs = broadcast_if_small(wanted).join(ends, "key").where(_without_tokens() >= F.coalesce("floor", F.lit(0.0)) - _SLACK)
    return pairs.select("item_id", "doc_id").distinct()


class Passages:
    """Passages (doc_id, ts, path, tags, marker) with the postings of all words of the claims (item_id, ts, tags, marker)
    that will ask. Ids are unique; ts are distinct tokens, tags a bit set, marker 0 or 1."""

    def __init__(self, passages: DataFrame, claims: DataFrame):
        claims = checkpointed(claims)
        words = claims.select(F.explode("ts").alias("word")).distinct()
        vocabulary = checkpointed(words.withColumn("token", F.monotonically_increasing_id()))
        numbers = claims.select("item_id", F.explode("ts").alias("word")).join(vocabulary, "word").groupBy("item_id").agg(F.collect_list("token").alias("c_ts"))
        none = F.array().cast("array<bigint>")
        own = claims.select("item_id", F.col("tags").alias("c_tags"), F.col("marker").alias("c_marker")).join(numbers, "item_id", "left")
        own = own.withColumns({"c_ts": F.coalesce("c_ts", none), "c_n": F.coalesce(F.size("c_ts"), F.lit(0))})
        self.claims = checkpointed(own)
        passages = checkpointed(passages)
        self.index = checkpointed(postings(passages, vocabulary))
        self.plain = passages.select("doc_id", "tags", "marker", F.size("ts").alias("n"))
        held = self.claims.select(F.explode("c_ts").alias("token")).groupBy("token").agg(F.count("*").alias("claims"))
        frequency = self.index.groupBy("token").agg(F.count("*").alias("df"))
        self.rows = held.join(frequency, "token").agg(F.sum(F.col("claims") * F.col("df"))).first()[0] or 0

    @cached_property
    def passages(self) -> DataFrame:
        """The passages with the numbers of the claims' words that they hold."""
        none = F.array().cast("array<bigint>")
        own = F.col("in_path")
        told = self.index.groupBy("doc_id").agg(F.collect_list(F.when(~own, F.col("token"))).alias("ts"), F.collect_list(F.when(own, F.col("token"))).alias("path"))
        return checkpointed(self.plain.join(told, "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in ("ts", "path")}))

    def _every(self, claims: DataFrame, k: int) -> DataFrame:
        """The scores of all pairs that share a word, summed before the shuffle, and of the k first and last of others."""
        wanted = broadcast_if_small(claims.select("item_id", F.explode("c_ts").alias("token")))
        about = broadcast_if_small(claims.drop("c_ts"))
        sums = {"h": F.count_if(~F.col("in_path")), "p": F.count_if("in_path"), "u": F.count_if("new")}
        facts = [F.first(c).alias(c) for c in ("n", "tags", "marker")]
        shared = self.index.join(wanted, "token").groupBy("doc_id", "item_id").agg(*(v.alias(c) for c, v in sums.items()), *facts)
        shared = shared.join(about, "item_id").select("item_id", "doc_id", _weighted(F.col("h"), F.col("p"), F.col("u")).alias("score"))
        none = claims.select("item_id", F.lit(None).cast("double").alias("floor"))
        rest = _tagged_alike(self.plain, claims, none, k).join(self.plain, "doc_id").join(about, "item_id")
        rest = rest.select("item_id", "doc_id", F.round(_without_tokens(), 9).alias("score"))
        return shared.unionByName(rest.join(shared.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")).where("score > 0")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(item_id, doc_id, score) of pairs."""
        dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "item_id")
        both = dealt.join(self.passages, "doc_id").join(broadcast_if_small(self.claims, 20_000), "item_id")
        return both.select("item_id", "doc_id", link_score().alias("score"))

    def best(self, k: int, items: DataFrame | None = None) -> DataFrame:
        """(item_id, doc_id, score): at least all passages that are among a claim's k best, ties with the k-th included in
        whatever order they are taken, and only pairs with a score over 0. items: the claims (item_id) that ask, or all.

        Both ways are exact: while the postings that meet the claims are few, all pairs are scored; beyond, the bounds
        decide which."""
        claims = self.claims if items is None else checkpointed(self.claims.join(items.select("item_id"), "item_id", "left_semi"))
        if self.rows <= DIRECT_ROWS:
            return self._every(claims, k)
        found, floor = self._floor(claims, k)
        for guess in (GUESS, 1.0):  # most claims end with the first: their k-th best reaches the guess
            wanted = floor.withColumn("floor", F.col("floor") * guess)
            open_ = claims if guess > 1 else claims.join(floor.where("done"), "item_id", "left_anti")
            pairs = self._looked_up(open_, wanted).select("item_id", "doc_id")
            if guess == 1:
                pairs = pairs.unionByName(_tagged_alike(self.plain, claims, floor, k))
            rest = checkpointed(pairs.distinct().join(found, ["item_id", "doc_id"], "left_anti"))
            found = checkpointed(found.unionByName(self.scored(rest)))
            if guess > 1:
                floor = self._kth(found, k).join(wanted.withColumnRenamed("floor", "guess"), "item_id", "left")
                floor = checkpointed(floor.select("item_id", "floor", F.coalesce(F.col("floor") >= F.col("guess"), F.lit(False)).alias("done")))
        return found.where("score > 0")

    def looked_up_rows(self, k: int) -> int:
        """How many rows of the postings meet the claims' essential tokens, with the floors that `best` begins with."""
        return self._looked_up(self.claims, self._floor(self.claims, k)[1].withColumn("floor", F.col("floor") * GUESS)).count()

    def _looked_up(self, claims: DataFrame, floor: DataFrame) -> DataFrame:
        essential = checkpointed(essential_tokens(self.index, claims, floor))
        return self.index.join(broadcast_if_small(essential), ["token", *_BLOCK])

    def _kth(self, found: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
        return found.withColumn("place", place).where(F.col("place") == k).select("item_id", F.col("score").alias("floor"))

    def _floor(self, claims: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The scores of the shortest passages that hold a claim's token, and each claim's k-th of them."""
        short = self.index.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy("n", "doc_id"))).where(F.col("place") <= k)
        seeds = broadcast_if_small(claims.select("item_id", F.explode("c_ts").alias("token"))).join(short, "token").select("item_id", "doc_id").distinct()
        first = checkpointed(self.scored(seeds))
        return first, checkpointed(self._kth(first, k))


def best_matches(claims: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """`Passages.best` of all claims, asked once."""
    return Passages(passages, claims).best(k)
