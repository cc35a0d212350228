"""The review manifest: two trees of files and the claims about them, from the mapping of files to the queue of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.functions import unicode as U
from strandline.operators import changes, diffs, impact, ranking, reviews
from strandline.operators.graph import checkpointed

MARKER = r"(?i)\b(eq|fig|sec|tab)\b"
TAGS = [name for name, _ in V.SEMANTIC_TAGS]


def tag_bits(tags: Column) -> Column:
    """A set of semantic tags as bits."""
    known = F.filter(F.array_distinct(tags), lambda x: F.array_contains(F.array(*map(F.lit, TAGS)), x))
    return F.aggregate(known, F.lit(0).cast("long"), lambda s, x: s + F.pow(F.lit(2), F.array_position(F.array(*map(F.lit, TAGS)), x) - 1).cast("long"))


def plain_words(x: Column) -> Column:
    return F.filter(F.array_distinct(F.split(U.normalize_identifier(x), " ")), lambda w: w != "")


def file_diffs(pairs: DataFrame, old: DataFrame, new: DataFrame, cache_key: str) -> DataFrame:
    """DIF-03, HSH-09, REV-14, FLT-11: each pair of `map_files` with its diff, id, and whether the diff is too large."""
    df = pairs.join(old.select(F.col("path").alias("source_path"), F.col("text").alias("was")), "source_path", "left")
    df = df.join(new.select(F.col("path").alias("current_path"), F.col("text").alias("now")), "current_path", "left")
    both = F.col("source_path").isNotNull() & F.col("current_path").isNotNull()
    one = F.when(F.col("source_path").isNull(), diffs.whole_file(F.col("now"), "+")).otherwise(diffs.whole_file(F.col("was"), "-"))
    df = df.withColumn("diff", F.when(both, diffs.unified(F.when(both, F.col("was")), F.when(both, F.col("now")))).otherwise(one))
    gone = F.lit("/dev/null")
    ident = S.stable_digest(24, cache_key=F.lit(cache_key), source_rel_path=F.coalesce("source_path", gone), current_rel_path=F.coalesce("current_path", gone), diff_type=F.col("diff_type"))
    large = (F.size(F.split("diff", "\n", -1)) - 1 > V.LARGE_LINES) | (F.octet_length("diff") > V.LARGE_BYTES)
    return df.drop("was", "now").withColumns({"file_id": ident, "large": large, "path": F.coalesce("current_path", "source_path")})


def link_claims(claims: DataFrame, hunks: DataFrame, tags: DataFrame) -> DataFrame:
    """REV-04, JON-08, MTH-12, WIN-03: (item_id, hunk_id, score, rank, accepted): the five best hunks of each claim
    (item_id, text), of equals the greater path, and which reach the floors. tags: (cluster, tag)."""
    bits = hunks.select("hunk_id", F.explode("clusters").alias("cluster")).join(tags, "cluster").groupBy("hunk_id").agg(tag_bits(F.collect_set("tag")).alias("tags"))
    marker = F.col("changed_text").rlike(MARKER).cast("long")
    passages = hunks.join(bits, "hunk_id", "left").select(
        F.col("hunk_id").alias("doc_id"), F.col("words").alias("ts"), F.col("path_names").alias("path"), F.coalesce("tags", F.lit(0).cast("long")).alias("tags"), marker.alias("marker")
    )
    own = claims.select("item_id", plain_words(F.col("text")).alias("ts"), tag_bits(T.semantic_tags(F.lower("text"))).alias("tags"), F.col("text").rlike(MARKER).cast("long").alias("marker"))
    scores = impact.best_matches(own, passages, V.TOP_K).withColumnRenamed("doc_id", "hunk_id").join(hunks.select("hunk_id", F.col("path").alias("file_path")), "hunk_id")
    top = ranking.top_with_cutoff(scores, "item_id", "score", [F.desc("file_path"), F.desc("hunk_id")], V.TOP_K, V.MIN_SCORE, V.RELATIVE_FLOOR)
    return top.select("item_id", "hunk_id", "score", "rank", "accepted")


def build(old: DataFrame, new: DataFrame, claims: DataFrame, anchors: DataFrame, members: DataFrame, tags: DataFrame, cache_key: str = "") -> dict[str, DataFrame]:
    """REV-01: the tables of a manifest, by name: `files` (pairs with diffs), `hunks`, `links`, `entries`, `phases`.

    old, new: (path, text); claims: (item_id, text); anchors: (path, cluster, start_line, end_line); members: (path,
    cluster); tags: (cluster, tag). Files are mapped (`map_files`) and diffed, hunks of primary languages are linked to
    the claims, and each file becomes an entry with status, bucket and significance, numbered in the order of review."""
    files = checkpointed(file_diffs(changes.map_files(old, new), old, new, cache_key))
    counted = diffs.hunks(files.select("file_id", "diff"), "file_id", "diff")
    stats = counted.groupBy("file_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("n_hunks"))
    hunks = checkpointed(changes.hunk_candidates(files, anchors, members, tags))
    links = checkpointed(link_claims(claims, hunks, tags))
    linked = links.where("accepted").join(hunks.select("hunk_id", "file_id"), "hunk_id").groupBy("file_id").agg(F.count_distinct("item_id").alias("linked_claims"))
    zero = F.lit(0).cast("long")
    df = files.join(stats, "file_id", "left").join(linked, "file_id", "left")
    df = df.withColumns({c: F.coalesce(c, zero) for c in ("added", "removed", "n_hunks", "linked_claims")})
    status = reviews.semantic_status(F.col("diff_type"), F.col("match_type"), F.col("language"), F.col("large"))
    df = df.withColumns({"changed_lines": F.col("added") + F.col("removed"), "semantic_status": status})
    df = df.withColumn("bucket", reviews.bucket(F.col("diff_type"), F.col("match_type"), F.col("semantic_status"), F.col("language")))
    df = df.withColumns({"significance": S.significance(F.col("changed_lines"), F.col("linked_claims")), "job": F.col("bucket")})
    entries = reviews.queue(df).select(
        "file_id", "source_path", "current_path", "diff_type", "match_type", "semantic_status", "language", "bucket", "significance",
        "added", "removed", "n_hunks", "linked_claims", "place",
    )
    done = [("file_mapping", files), ("claim_extraction", claims), ("diff_generation", hunks), ("deterministic_linking", links.where("accepted")), ("fallback_render", files.where("large")), ("persisting", files)]
    phases = None
    for n, (phase, rows) in enumerate(done, 1):
        row = rows.agg(F.count("*").alias("done")).select(F.lit(n).alias("place"), F.lit(phase).alias("phase"), "done")
        phases = row if phases is None else phases.unionByName(row)
    return {"files": files, "hunks": hunks, "links": links, "entries": entries, "phases": phases}
