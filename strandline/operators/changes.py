"""Changed files: which base file each belongs to, how they link, and the clusters they form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import text as T
from strandline.operators import diffs, ranking
from strandline.operators.graph import checkpointed, components
from strandline.operators.sequences import matched_in_order

GENERIC_LABELS = ("New implementation modules", "Core implementation changes", "Training changes", "Infrastructure changes")


def compare_snapshots(base: DataFrame, target: DataFrame) -> DataFrame:
    """JON-03, SET-03: files of two snapshots (path, text) by path: added, deleted, modified; equal ones are left out."""
    a = base.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("old"))
    b = target.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("new"))
    df = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return df.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("diff_type"), "old", "new")


def moved_files(compared: DataFrame) -> DataFrame:
    """JON-04: added files with the content of a deleted one; the n-th copy on one side goes with the n-th on the other."""
    def nth(df, h):
        return df.withColumn("n", F.row_number().over(Window.partitionBy(h).orderBy("path")))

    old = nth(compared.where("diff_type = 'deleted'"), "old").select(F.col("path").alias("source_path"), F.col("old").alias("h"), "n")
    new = nth(compared.where("diff_type = 'added'"), "new").select(F.col("path").alias("current_path"), F.col("new").alias("h"), "n")
    return new.join(old, ["h", "n"]).select("source_path", "current_path")


def path_bonus(old_path: Column, new_path: Column) -> Column:
    """MTH-13: what shared path words and an equal stem add to the similarity."""
    shared = F.size(F.array_intersect(T.identifier_words(old_path), T.identifier_words(new_path)))
    def stem(p):
        return F.lower(F.regexp_replace(F.regexp_extract(p, "([^/]+)$", 1), r"\.[^.]*$", ""))

    return F.least(PATH_WORD * shared, F.lit(PATH_WORDS_MOST)) + F.when(stem(old_path) == stem(new_path), EQUAL_STEM).otherwise(0.0)


def file_similarity(old_path: Column, old: Column, new_path: Column, new: Column) -> Column:
    """MTH-13: character ratio, and bonuses for shared path words and an equal stem; 1 at most."""
    return F.least(diffs.ratio(old, new) + path_bonus(old_path, new_path), F.lit(1.0))


LETTER_BUCKETS = 32
# What shared path words, together and each, and an equal stem add to a similarity.
PATH_WORDS_MOST, PATH_WORD, EQUAL_STEM = 0.2, 0.05, 0.12


@F.pandas_udf(ArrayType(IntegerType()))
def letter_counts(text: pd.Series) -> pd.Series:
    """How many characters of a text fall into each bucket of code points; null stays null."""
    def one(x):
        return None if x is None else np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTER_BUCKETS, minlength=LETTER_BUCKETS).astype(np.int32)

    return pd.Series([one(x) for x in text], dtype=object)


def _with_job(df: DataFrame) -> DataFrame:
    return df if "job" in df.columns else df.withColumn("job", F.lit(""))


def comparable_pairs(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """(job, source, target, bonus): the old and new files of one job and extension whose similarity may reach `least`.

    Files of one stem meet by it; others meet by bands of length, as the ratio is at most 2 min / sum of the lengths and
    path words add 0.2 at most. A pair goes on if the letters that both hold, 2 sum of the smaller counts over the sum of
    the lengths, allow the score. Only lengths and letter counts are shuffled, no text."""
    without = least - PATH_WORDS_MOST
    step = without / (2 - without) if without > 0 else 0.0  # the least ratio of lengths

    def side(df, name):
        ext = F.coalesce(T.extension(F.col("path")), F.lit(""))
        stem = F.lower(F.regexp_replace(F.regexp_extract(F.col("path"), "([^/]+)$", 1), r"\.[^.]*$", ""))
        n = F.length("text")
        band = F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / float(-np.log(step))) if step else F.lit(0).cast("long")
        cells = [c.alias(f"{name}_{k}") for k, c in (("n", n), ("letters", letter_counts("text")), ("stem", stem), ("band", band))]
        return _with_job(df).where("text is not null").select("job", F.col("path").alias(name), ext.alias("ext"), *cells)

    a, b = checkpointed(side(old, "source")), checkpointed(side(new, "target"))
    named = a.withColumn("stem", F.col("source_stem")).join(b.withColumn("stem", F.col("target_stem")), ["job", "ext", "stem"]).drop("stem")
    near = F.array(F.col("target_band") - 1, F.col("target_band"), F.col("target_band") + 1) if step else F.array("target_band")
    banded = a.withColumn("band", F.col("source_band")).join(b.withColumn("band", F.explode(near)), ["job", "ext", "band"]).drop("band")
    both = F.aggregate(F.zip_with("source_letters", "target_letters", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    total = F.col("source_n") + F.col("target_n")
    bonus = path_bonus(F.col("source"), F.col("target"))
    bound = F.when(total == 0, 1.0).otherwise(2.0 * both / total) + bonus
    found = named.unionByName(banded.where("source_stem <> target_stem")).where(bound >= least - 1e-9)
    return found.select("job", "source", "target", bonus.alias("bonus"))


def same_extension_pairs(old: DataFrame, new: DataFrame, least: float = 0.0) -> DataFrame:
    """MTH-13, JON-05: (job, source, target, score) of the old and new files ([job,] path, text) of one job and extension
    with a similarity of at least `least`. Texts come in only for pairs that `comparable_pairs` lets through, which are
    dealt out one by one; a null text has no similarity."""
    pairs = comparable_pairs(old, new, least)
    pairs = pairs.join(_with_job(old).select("job", F.col("path").alias("source"), F.col("text").alias("source_text")), ["job", "source"])
    pairs = pairs.join(_with_job(new).select("job", F.col("path").alias("target"), F.col("text").alias("target_text")), ["job", "target"])
    alike = diffs.ratio_from(F.col("source_text"), F.col("target_text"), F.lit(least) - F.col("bonus"))
    pairs = pairs.repartition("job", "source", "target").withColumn("alike", alike).where("alike is not null")
    score = F.least(F.col("alike") + F.col("bonus"), F.lit(1.0))
    return pairs.select("job", "source", "target", score.alias("score")).where(F.col("score") >= least)


def fuzzy_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """JON-05, WIN-06: each new file (path, text) against all old files of its extension; the best, the second and what
    they say."""
    pairs = same_extension_pairs(old, new).select(F.col("target").alias("new_path"), F.col("source").alias("old_path"), F.col("score").alias("sim"))
    w = Window.partitionBy("new_path").orderBy(F.desc("sim"), "old_path")
    df = pairs.select("new_path", "old_path", "sim").withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("new_path").agg(
        F.max(F.when(F.col("r") == 1, F.struct("sim", "old_path"))).alias("a"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("sim"))), F.lit(0.0)).alias("second")
    )
    return df.select("new_path", F.col("a.old_path").alias("old_path"), F.col("a.sim").alias("best"), "second", ranking.match_type(F.col("a.sim"), F.col("second"), 0.55, 0.40, 0.08).alias("match_type"))


def link_reasons(changed: DataFrame, block: int = 1024) -> DataFrame:
    """JON-07: pairs of changed files (id, change_type, tags, imports, label, dir) of one change type with the reasons
    that link them; each reason is a join key. Rows of one id are one file.

    The files that share a type and a reason are dealt into blocks of about `block`, and pairs of blocks meet, so a task
    holds one block of a key at a time. A pair is listed once, at the first type and reason that both files have, so no
    pair moves or waits for another. The joins are never broadcast: the size of the input says little about the reasons'."""
    def keys(kind, col):
        return F.transform(F.filter(col, lambda v: v.isNotNull()), lambda v: F.concat(F.lit(f"{kind}:"), v))

    none = F.array().cast("array<string>")
    kinds = ("tag", F.coalesce("tags", none)), ("import", F.coalesce("imports", none)), ("label", F.array("label")), ("dir", F.array("dir"))
    every = changed.where("id is not null AND change_type is not null").select("id", "change_type", F.concat(*(keys(*k) for k in kinds)).alias("reasons"))
    # Only ids of several types need all their types with them (links), to find the first one that two files share.
    of_type = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons")
    every = every.repartition("id").groupBy("id", "change_type").agg(of_type)
    typed = F.transform("reasons", lambda r: F.struct("change_type", r.alias("reason")))
    of_id = Window.partitionBy("id")
    links = F.when(F.count("*").over(of_id) > 1, F.array_sort(F.flatten(F.collect_list(typed).over(of_id))))
    side = every.withColumn("links", links).select("id", "change_type", "reasons", "links", F.posexplode("reasons").alias("n", "reason"))
    earlier, later = F.slice("reasons", 1, F.col("n")), F.slice("reasons", F.col("n") + 2, F.size("reasons"))
    side = side.select("id", "change_type", "reason", "links", earlier.alias("earlier"), later.alias("later"))

    def bits(col):
        return F.aggregate(col, F.lit(0).cast("long"), lambda x, r: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(r), F.lit(64)))))

    # Lists without a common bit have no common reason; only the others are compared.
    side = side.withColumn("earlier_bits", bits("earlier")).withColumn("later_bits", bits("later"))
    key = ["change_type", "reason"]
    blocks = side.groupBy(key).agg(F.ceil(F.count("*") / block).alias("blocks"))
    side = side.join(blocks.hint("merge"), key).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def dealt(x, own, other):
        cells = [F.col(c).alias(f"{c}_{x}") for c in ("links", "earlier", "later", "earlier_bits", "later_bits")]
        return side.select(*key, F.col("id").alias(x), *cells, F.col("own").alias(own), every_block.alias(other))

    pairs = dealt("a", "block_a", "block_b").join(dealt("b", "block_b", "block_a").hint("merge"), [*key, "block_a", "block_b"]).where("a < b")
    several = F.col("links_a").isNotNull() & F.col("links_b").isNotNull()
    shared = F.array_intersect("links_a", "links_b")
    apart, alone = (F.col(f"{x}_bits_a").bitwiseAND(F.col(f"{x}_bits_b")) == 0 for x in ("earlier", "later"))
    first = F.when(several, F.element_at(shared, 1) == F.struct(*key)).otherwise(apart | ~F.arrays_overlap("earlier_a", "earlier_b"))
    both = F.when(alone, F.array("reason")).otherwise(F.concat(F.array("reason"), F.array_intersect("later_a", "later_b")))
    return pairs.where(first).select("a", "b", F.when(several, F.array_sort(F.array_distinct(shared["reason"]))).otherwise(both).alias("reasons"))


def sharing_pairs(tagged: DataFrame, block: int = 1024) -> DataFrame:
    """JON-14: (a, b, shared): the pairs a < b of rows (id, tags) that share a tag, and how many tags they share.

    Rows with the same tags are a class; classes meet by tags, and the pairs of two classes are listed from blocks of up to
    `block` ids, so a task holds two blocks and no pair is shuffled."""
    sets = tagged.select("id", F.explode("tags").alias("tag")).where("tag is not null").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    sizes = sets.groupBy("tags").agg(F.count("*").alias("n"))
    dealt = sets.join(sizes, "tags").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)))
    blocks = checkpointed(dealt.groupBy("tags", "block").agg(F.collect_list("id").alias("ids")))
    met = blocks.select("tags").distinct()
    met = met.select("tags", F.explode("tags").alias("tag"))
    classes = met.withColumnRenamed("tags", "a_tags").join(met.withColumnRenamed("tags", "b_tags"), "tag")
    classes = classes.where("a_tags <= b_tags").groupBy("a_tags", "b_tags").agg(F.count("*").alias("shared"))
    a, b = (blocks.select(F.col("tags").alias(f"{x}_tags"), F.col("block").alias(f"{x}_block"), F.col("ids").alias(f"{x}_ids")) for x in "ab")
    places = a.drop("a_ids").join(classes, "a_tags").join(b.drop("b_ids"), "b_tags").where("a_tags < b_tags OR a_block <= b_block")
    places = places.join(a, ["a_tags", "a_block"]).join(b, ["b_tags", "b_block"])
    places = places.repartition("a_tags", "a_block", "b_tags", "b_block").withColumn("one", (F.col("a_tags") == F.col("b_tags")) & (F.col("a_block") == F.col("b_block")))
    pairs = places.select("one", "shared", "b_ids", F.explode("a_ids").alias("x")).select("one", "shared", "x", F.explode("b_ids").alias("y"))
    return pairs.where("x < y OR NOT one").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def clusters(changed: DataFrame) -> DataFrame:
    """GRF-01, GRF-02, AGG-06: clusters of linked files. Files are linked through nodes that stand for a reason, so a
    reason that many files share makes one edge for each."""
    reasons = F.flatten(F.array(F.transform("tags", lambda v: F.concat(F.lit("t:"), v)), F.transform("imports", lambda v: F.concat(F.lit("i:"), v)), F.array(F.concat(F.lit("l:"), "label"), F.concat(F.lit("d:"), "dir"))))
    edges = changed.select(F.col("id").cast("long").alias("b"), F.explode(reasons).alias("r"), "change_type")
    # Reason nodes lie above all ids, told apart by a hash.
    node = F.shiftrightunsigned(F.xxhash64("change_type", "r"), 2).bitwiseOR(F.lit(1 << 62))
    comps = components(edges.select(node.alias("a"), "b"))
    df = changed.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    label_counts = df.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (~F.col("label").isin(*GENERIC_LABELS)).alias("own"), "label")).alias("m")
    labels = label_counts.groupBy("cluster").agg(best).select("cluster", F.col("m.label").alias("label"))
    merged = df.groupBy("cluster").agg(
        F.min_by("change_type", "id").alias("change_type"), F.array_sort(F.collect_list("path")).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags")
    )
    return merged.join(labels, "cluster")


def related(clustered: DataFrame) -> DataFrame:
    """JON-14, GRF-03: clusters that share a tag."""
    t = clustered.select("cluster", F.explode("tags").alias("tag"))
    other = t.withColumnRenamed("cluster", "related")
    return t.join(other, "tag").where("cluster <> related").groupBy("cluster").agg(F.array_sort(F.collect_set("related")).alias("related"))


def anchors(pairs: DataFrame) -> DataFrame:
    """DIF-01, WIN-10, FLT-07, AGG-17, CTR-12: code anchors of file pairs (pair_id, path, base_path, old, new), those that
    can be compared marked: both windows say something, and not the same."""
    from strandline.functions.scores import comparable_anchor

    found = diffs.code_anchors(pairs)
    return found.withColumn("comparable", F.coalesce(comparable_anchor(F.col("original_snippet"), F.col("snippet")), F.lit(False)))


def path_names(path: Column) -> Column:
    """STR-35: each part of a path, and its stem, in normal form."""
    def plain(x):
        return F.btrim(F.regexp_replace(F.lower(x), r"(?U)[\W_]+", " "))

    stem = F.regexp_replace(F.regexp_extract(path, "([^/]+)/*$", 1), r"(?<=.)\.[^./]+$", "")
    return F.filter(F.array_distinct(F.transform(F.concat(F.split(path, "/"), F.array(stem)), plain)), lambda x: x != "")


def owners_of_ranges(hunks: DataFrame, anchors: DataFrame, members: DataFrame, bin_lines: int = 64) -> DataFrame:
    """JON-09: (hunk_id, cluster) of hunks (path, hunk_id, start, length): the clusters with an anchor (path, cluster,
    start_line, end_line) that overlaps the hunk, or else those that the file is a member (path, cluster) of.

    An interval join: both ranges are cut into bins of `bin_lines` lines, which are the join's key with the path, and the
    exact test follows. Lines begin at 1; a range that begins before never overlaps."""
    from strandline.functions.scores import ranges_overlap

    def bins(start, end):
        return F.explode(F.sequence(F.floor(start / bin_lines), F.floor(end / bin_lines))).alias("bin")

    a = anchors.where("start_line > 0 AND end_line >= start_line").select("path", "cluster", "start_line", "end_line", bins(F.col("start_line"), F.col("end_line")))
    end = F.col("start") + F.greatest(F.col("length") - 1, F.lit(0))
    h = hunks.where("start > 0").select("path", "hunk_id", "start", end.alias("end"), bins(F.col("start"), end))
    hit = ranges_overlap(F.col("start"), F.col("end"), F.col("start_line"), F.col("end_line"))
    anchored = h.join(a, ["path", "bin"]).where(hit).select("hunk_id", "cluster").distinct()
    rest = hunks.select("hunk_id", "path").join(anchored, "hunk_id", "left_anti")
    return anchored.unionByName(rest.join(members.select("path", "cluster").distinct(), "path").select("hunk_id", "cluster"))


def hunk_candidates(files: DataFrame, anchors: DataFrame, members: DataFrame, tags: DataFrame, primary=V.PRIMARY_LANGUAGES) -> DataFrame:
    """REV-03: what a claim can be linked to: the hunks of the files (file_id, path, diff) in a primary language, with
    path names, changed words, clusters and the words of the clusters' tags (cluster, tag)."""
    files = files.where(T.language(F.col("path")).isin(*primary))
    found = diffs.changed_hunks(files.select("file_id", "diff")).join(files.select("file_id", "path"), "file_id")
    places = found.select("path", "hunk_id", F.col("new_start").alias("start"), F.col("new_count").alias("length"))
    owned = owners_of_ranges(places, anchors, members)
    clusters = owned.groupBy("hunk_id").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    said = owned.join(tags.select("cluster", F.explode(T.identifier_words(F.col("tag"))).alias("word")), "cluster").groupBy("hunk_id").agg(F.array_sort(F.collect_set("word")).alias("tag_words"))
    none = F.array().cast("array<string>")
    out = found.join(clusters, "hunk_id", "left").join(said, "hunk_id", "left").withColumn("path_names", path_names(F.col("path")))
    return out.withColumns({"clusters": F.coalesce("clusters", none), "tag_words": F.coalesce("tag_words", none)})


def map_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """SEQ-01, REV-09: how the files of two trees ([job,] path, text) belong together, for each job by itself: [job,]
    source_path, current_path, diff_type, match_type, similarity, language. Files equal in path and content are left out.

    New files go in order of path. One whose path the old tree has is modified (exact_path). Any other takes an old file
    of equal content, else the best similar one of its extension, among those that no file before it took: an old file
    whose path the new tree has is free until that path's turn. What matches too faintly, or two files alike, is added."""
    jobs = "job" in old.columns
    old, new = _with_job(old), _with_job(new)

    def place(path="path"):
        return F.struct(F.col("job"), F.col(path).alias("path"))

    a = old.select(place().alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    b = new.select(place().alias("target"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    same_path = b.join(a.withColumnRenamed("source", "target").withColumnRenamed("h", "old_h"), "target")
    same_path = checkpointed(same_path.select("target", F.col("h").eqNullSafe(F.col("old_h")).alias("equal")))
    rest = b.join(same_path, "target", "left_anti")
    later = same_path.select(F.col("target").alias("source"), F.lit(True).alias("later"))

    def free(pairs):
        pairs = pairs.join(later, "source", "left")
        return pairs.where(F.col("later").isNull() | (F.col("source") > F.col("target"))).drop("later")

    same_job = F.col("source.job") == F.col("target.job")
    equal = rest.where("h is not null").withColumn("job", F.col("target.job")).join(a.withColumn("job", F.col("source.job")), ["job", "h"]).where(same_job)
    equal = equal.select("target", "source", F.lit(1.0).alias("score"), F.lit(True).alias("same"))
    without = rest.select("target.job", "target.path")
    alike = same_extension_pairs(old, new.join(without, ["job", "path"], "left_semi"), V.LOW_FLOOR)
    alike = alike.select(place("target").alias("target"), place("source").alias("source"), "score", F.lit(False).alias("same"))
    alike = alike.join(equal.select("target", "source"), ["target", "source"], "left_anti")
    found = matched_in_order(free(equal.unionByName(alike)), V.MOVED_FLOOR, V.LOW_FLOOR, V.AMBIGUOUS_MARGIN)

    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    columns = ["job", "source_path", "current_path", "diff_type", "match_type", "similarity"]

    def row(df, *values):
        return df.select(*(v.alias(c) for v, c in zip(values, columns)))

    source, target, kind = F.col("source.path"), F.col("target.path"), F.col("match_type")
    job = F.col("target.job")
    exact = row(same_path.where("not equal"), job, target, target, F.lit("modified"), F.lit("exact_path"), F.lit(1.0))
    matched = row(
        found, job, F.when(kind != "ambiguous", source), target, F.when(kind == "content_moved", "modified").otherwise("added"), kind, F.col("score")
    )
    added = row(rest.join(found, "target", "left_anti"), job, none, target, F.lit("added"), F.lit("added"), zero)
    used = same_path.select(F.col("target").alias("source")).unionByName(found.where("match_type = 'content_moved'").select("source"))
    deleted = row(a.join(used, "source", "left_anti"), F.col("source.job"), source, none, F.lit("deleted"), F.lit("deleted"), zero)
    out = exact.unionByName(matched).unionByName(added).unionByName(deleted)
    out = out.withColumn("language", T.language(F.coalesce("current_path", "source_path")))
    return out if jobs else out.drop("job")


def file_payloads(hunks: DataFrame) -> DataFrame:
    """DIF-05, AGG-02, ARR-07: one payload for each file: sums of its hunks, and the hunks in order with ids."""
    from strandline.functions.scores import stable_digest

    ids = stable_digest(24, file_id=F.col("file_id").cast("string"), new_start=F.col("new_start"), old_start=F.col("old_start"))
    row = F.struct("hunk", ids.alias("hunk_id"), "old_start", "old_count", "new_start", "new_count", "added", "removed")
    return hunks.groupBy("file_id").agg(
        F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum(F.col("added") + F.col("removed")).alias("changed"),
        F.count("*").alias("n_hunks"), F.array_sort(F.collect_list(row)).alias("hunks"),
    )
