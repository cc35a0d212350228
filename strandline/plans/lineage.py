"""Queries that look for where texts come from: copies, overlaps, similar files and greedy assignment."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import changes, diffs, impact, ranking, sequences
from strandline.operators.graph import checkpointed
from strandline.plans.registry import Tables, query
from strandline.plans.texts import sql_tokens


@query(
    "content_hash_join",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY h HAVING count(*) > 1)
    SELECT h.doc_id, f.first_doc, f.copies FROM h JOIN f USING (h) WHERE h.doc_id <> f.first_doc""",
)
def content_hash_join(t: Tables):
    """HSH-04, JON-03, JON-04: each copy with the first document of its content."""
    h = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
    return h.join(first, "h").where("doc_id <> first_doc").select("doc_id", "first_doc", "copies")


def _source_tokens(t: Tables):
    """AGG-15: the distinct tokens of each source, one row each. (A plain explode would have the optimiser filter on the
    array's size first, and so tokenise each text twice.)"""
    return t.documents.select("source", F.explode_outer(T.tokens(F.col("text"))).alias("token")).where("token is not null").distinct()


SOURCE_TOKENS = f"SELECT DISTINCT source, unnest({sql_tokens('text')}) AS token FROM documents"


def _both_ways(pairs):
    """Each pair in both directions, from one row."""
    def way(a, b, na, nb):
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(na).alias("na"), F.col(nb).alias("nb"), "shared")

    return pairs.select(F.explode(F.array(way("a", "b", "na", "nb"), way("b", "a", "nb", "na"))).alias("p")).select("p.*")


def _pair_overlap(df, key: str, item: str):
    """MTH-01 for all pairs of keys that share an item: the item is the join key. The distinct rows are made once."""
    df = checkpointed(df)
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    a, b = (df.select(F.col(key).alias(k), item) for k in "ab")
    both = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return both.withColumn("overlap", S.ratio(F.col("shared"), F.least("na", "nb")))


@query(
    "overlap_coefficient",
    f"""WITH t AS ({SOURCE_TOKENS}), n AS (SELECT source, count(*) AS n FROM t GROUP BY source)
    SELECT p.a, p.b, p.shared, p.shared / least(na.n, nb.n) AS overlap FROM (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM t x JOIN t y ON x.token = y.token AND x.source < y.source GROUP BY ALL) p
    JOIN n na ON na.source = p.a JOIN n nb ON nb.source = p.b""",
)
def overlap_coefficient(t: Tables):
    """MTH-01, AGG-15, CND-13: token overlap of all pairs of sources."""
    return _pair_overlap(_source_tokens(t), "source", "token").select("a", "b", "shared", "overlap")


@query(
    "fingerprint_rank",
    f"""WITH t AS ({SOURCE_TOKENS}), n AS (SELECT source, count(*) AS n FROM t GROUP BY source),
    p AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM t x JOIN t y ON x.token = y.token AND x.source <> y.source GROUP BY ALL),
    s AS (SELECT p.a, p.b, 0.35e0 * (p.shared / least(na.n, nb.n)) + 0.65e0 * (p.shared / nb.n) AS score FROM p JOIN n na ON na.source = p.a JOIN n nb ON nb.source = p.b)
    SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE score >= 0.12) WHERE r <= 3""",
)
def fingerprint_rank(t: Tables):
    """MTH-03, WIN-01, CND-13: the three most alike sources of each, with weighted overlaps and a floor."""
    both = _both_ways(_pair_overlap(_source_tokens(t), "source", "token"))
    score = 0.35 * (F.col("shared") / F.least("na", "nb")) + 0.65 * (F.col("shared") / F.col("nb"))
    df = both.withColumn("score", score).where(F.col("score") >= V.FINGERPRINT_FLOOR)
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return df.withColumn("r", F.row_number().over(best)).where("r <= 3").select("a", "b", "score")


HOST_PARTS = """SELECT DISTINCT host, unnest(ps) AS part FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
  list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS ps FROM pages)"""


@query(
    "shape_similarity",
    f"""WITH t AS ({HOST_PARTS}), n AS (SELECT host, count(*) AS n FROM t GROUP BY host)
    SELECT p.a, p.b, 0.55e0 * (p.shared / least(na.n, nb.n)) + 0.45e0 * (p.shared / nb.n) AS score FROM (SELECT x.host AS a, y.host AS b, count(*) AS shared FROM t x JOIN t y ON x.part = y.part AND x.host < y.host GROUP BY ALL) p
    JOIN n na ON na.host = p.a JOIN n nb ON nb.host = p.b WHERE 0.55e0 * (p.shared / least(na.n, nb.n)) + 0.45e0 * (p.shared / nb.n) >= 0.2""",
)
def shape_similarity(t: Tables):
    """MTH-04, CND-14, AGG-15: pairs of hosts with like path parts."""
    parts = F.filter(F.split(T.url_path(F.col("url")), "/"), lambda p: p != "")
    df = t.pages.select(F.lower(T.url_host(F.col("url"))).alias("host"), F.explode(parts).alias("part")).distinct()
    score = 0.55 * (F.col("shared") / F.least("na", "nb")) + 0.45 * (F.col("shared") / F.col("nb"))
    return _pair_overlap(df, "host", "part").select("a", "b", score.alias("score")).where(F.col("score") >= V.SHAPE_FLOOR)


@query(
    "best_second_margin",
    f"""WITH t AS ({SOURCE_TOKENS}), n AS (SELECT source, count(*) AS n FROM t GROUP BY source),
    p AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM t x JOIN t y ON x.token = y.token AND x.source <> y.source GROUP BY ALL),
    s AS (SELECT p.a, p.b, p.shared / nb.n AS score FROM p JOIN n nb ON nb.source = p.b),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s),
    m AS (SELECT a, max(score) FILTER (WHERE r = 1) AS best, coalesce(max(score) FILTER (WHERE r = 2), 0) AS second FROM r WHERE r <= 2 GROUP BY a)
    SELECT a, best, second, CASE WHEN best >= 0.55 AND second >= 0.55 AND best - second < 0.08 THEN 'ambiguous' WHEN best >= 0.55 THEN 'moved' WHEN best >= 0.4 THEN 'low_confidence' ELSE 'added' END AS match_type FROM m""",
)
def best_second_margin(t: Tables):
    """WIN-06: how sure the best match of each source is."""
    both = _both_ways(_pair_overlap(_source_tokens(t), "source", "token"))
    df = both.withColumn("score", F.col("shared") / F.col("nb"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    df = df.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("a").agg(
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second")
    )
    return df.withColumn("match_type", ranking.match_type(F.col("best"), F.col("second"), V.MOVED_FLOOR, V.LOW_FLOOR, V.AMBIGUOUS_MARGIN))


def _near_pairs(t: Tables):
    """Neighbouring documents of a source with one first word."""
    first = F.get(T.sentences(F.col("text")), F.lit(0))
    df = t.documents.select("source", "doc_id", "text", F.substring(first, 1, 12).alias("head"))
    w = Window.partitionBy("source", "head").orderBy("doc_id")
    return df.select("doc_id", "text", F.lag("doc_id").over(w).alias("old_id"), F.lag("text").over(w).alias("old_text")).where("old_id is not null")


@query("char_ratio")
def char_ratio(t: Tables):
    """DIF-02, MTH-13: character similarity of neighbouring documents."""
    return _near_pairs(t).select("doc_id", "old_id", F.round(diffs.ratio(F.col("old_text"), F.col("text")), 6).alias("ratio"))


@query("line_opcodes")
def line_opcodes(t: Tables):
    """DIF-01, AGG-17, FLT-07: the code anchors between neighbouring documents."""
    path = F.concat(F.lit("d/"), "doc_id"), F.concat(F.lit("d/"), "old_id")
    pairs = _near_pairs(t).select(F.col("doc_id").alias("pair_id"), path[0].alias("path"), path[1].alias("base_path"), F.col("old_text").alias("old"), F.col("text").alias("new"))
    return changes.anchors(pairs)


@query(
    "code_anchors",
    """WITH d AS (SELECT doc_id, doc_id % 5 AS kind, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
    a AS (SELECT doc_id, kind, list_transform(ws, lambda w, i: i || ' ' || w) AS old, CAST(len(ws) // 3 AS INTEGER) AS k FROM d WHERE len(ws) > 0),
    n AS (SELECT *, CASE kind WHEN 0 THEN old[:k] || ['changed ' || doc_id] || old[k + 2:] WHEN 1 THEN old[:k] || ['added ' || doc_id] || old[k + 1:] WHEN 2 THEN old[:k] || old[k + 2:] WHEN 3 THEN old ELSE old[:k] || ['  '] || old[k + 1:] END AS new FROM a),
    w AS (SELECT *, greatest(k - 3, 0) AS s, k + CASE WHEN kind = 0 THEN 1 ELSE 0 END AS i2 FROM n WHERE kind IN (0, 1, 4)),
    b AS (SELECT doc_id, CASE kind WHEN 0 THEN 'replace' ELSE 'insert' END AS op, s + 1 AS a, least(k + 4, len(new)) AS e, least(i2 + 3, len(old)) AS oe, trim(array_to_string(new[s + 1:least(k + 4, len(new))], chr(10)), ' ' || chr(10)) AS snippet, trim(array_to_string(old[s + 1:least(i2 + 3, len(old))], chr(10)), ' ' || chr(10)) AS original FROM w),
    c AS (SELECT doc_id, 'context' AS op, 1 AS a, len(new[:8]) AS e, least(len(old), len(new[:8])) AS oe, array_to_string(new[:8], chr(10)) AS snippet, array_to_string(old[:8], chr(10)) AS original FROM n WHERE (kind IN (2, 3) OR doc_id NOT IN (SELECT doc_id FROM b WHERE snippet <> '' AND snippet <> original)) AND len(new) > 0),
    r AS (SELECT * FROM b WHERE snippet <> '' AND snippet <> original UNION ALL SELECT * FROM c)
    SELECT doc_id, CASE op WHEN 'replace' THEN 'modification' WHEN 'insert' THEN 'addition' ELSE op END AS anchor_kind, a AS start_line, CAST(e AS INTEGER) AS end_line, CASE WHEN op = 'context' OR original <> '' THEN a END AS original_start_line, CAST(CASE WHEN op = 'context' OR original <> '' THEN oe END AS INTEGER) AS original_end_line, md5(snippet) AS snippet, md5(nullif(original, '')) AS original_snippet,
      left(sha1('new/' || doc_id || '|old/' || doc_id || '|' || a || '|' || e || '|' || CASE WHEN op = 'context' OR original <> '' THEN a ELSE 0 END || '|' || CASE WHEN op = 'context' OR original <> '' THEN oe ELSE 0 END || '|' || snippet || '|' || original || '|' || op), 12) AS patch_id,
      trim(original, ' ' || chr(10)) <> '' AND trim(snippet, ' ' || chr(10)) <> trim(original, ' ' || chr(10)) AS comparable FROM r""".replace("\\\\", "\\"),
)
def code_anchors(t: Tables):
    """DIF-01, FLT-07, AGG-17, CTR-12, HSH-01: anchors of files whose lines are the numbered words of a document, against
    the same with one line replaced, added, dropped, kept or added blank."""
    n = F.col("doc_id")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    old = F.transform(words, lambda w, i: F.concat_ws(" ", (i + 1).cast("string"), w))
    df = t.documents.select("doc_id", old.alias("ls")).where(F.size("ls") > 0).withColumn("k", F.floor(F.size("ls") / 3).cast("int"))
    before, kind = F.slice("ls", 1, F.col("k")), n % 5
    rest, after = F.slice("ls", F.col("k") + 1, F.size("ls")), F.slice("ls", F.col("k") + 2, F.size("ls"))

    def one(x):
        return F.array(x)

    new = (
        F.when(kind == 0, F.concat(before, one(F.concat(F.lit("changed "), n)), after)).when(kind == 1, F.concat(before, one(F.concat(F.lit("added "), n)), rest))
        .when(kind == 2, F.concat(before, after)).when(kind == 3, F.col("ls")).otherwise(F.concat(before, one(F.lit("  ")), rest))
    )
    pairs = df.select(n.alias("pair_id"), F.concat(F.lit("new/"), n).alias("path"), F.concat(F.lit("old/"), n).alias("base_path"), F.array_join("ls", "\n").alias("old"), F.array_join(new, "\n").alias("new"))
    found = changes.anchors(pairs)
    whole = [F.md5(F.col(c).cast("binary")).alias(c) for c in ("snippet", "original_snippet")]
    return found.select(F.col("pair_id").alias("doc_id"), "anchor_kind", "start_line", "end_line", "original_start_line", "original_end_line", *whole, "patch_id", "comparable")


@query("unified_diff")
def unified_diff(t: Tables):
    """DIF-03, DIF-04, DIF-05, AGG-02: unified diffs of neighbouring documents, parsed into hunks with counts."""
    pairs = _near_pairs(t).select(F.col("doc_id").alias("pair_id"), F.col("old_text").alias("old"), F.col("text").alias("new"))
    return diffs.hunks(pairs.select("pair_id", diffs.unified(F.col("old"), F.col("new")).alias("diff")), "pair_id", "diff")


@query(
    "unified_diff_parse",
    """WITH d AS (SELECT doc_id, string_split('@@ -1,2 +1,3 @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '-') || chr(10) || '@@ -9 +9 @@' || chr(10) || ' same' || chr(10) || '+tail', chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS pos FROM d),
    h AS (SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS hunk FROM l)
    SELECT doc_id, CAST(hunk AS BIGINT) AS hunk, CAST(max(CASE WHEN starts_with(line, '@@') THEN regexp_extract(line, '\\+(\\d+)', 1) END) AS INTEGER) AS new_start,
      count(*) FILTER (WHERE starts_with(line, '+')) AS added, count(*) FILTER (WHERE starts_with(line, '-')) AS removed FROM h WHERE hunk > 0 GROUP BY doc_id, hunk""".replace("\\\\", "\\"),
)
def unified_diff_parse(t: Tables):
    """DIF-04, DIF-06, AGG-02: hunks of a diff text by a running count of their heads."""
    text = F.concat(F.lit("@@ -1,2 +1,3 @@\n+"), F.replace("text", F.lit("\n"), F.lit("\n-")), F.lit("\n@@ -9 +9 @@\n same\n+tail"))
    df = diffs.hunks(t.documents.select("doc_id", text.alias("diff")), "doc_id", "diff")
    return df.select("doc_id", "hunk", "new_start", "added", "removed")


def claim_lists(t: Tables):
    """best(k, targets) of `greedy_widened`: the k best documents of each benchmark item, of equals the first."""
    from strandline.plans.review import claim_parts

    claims, passages = claim_parts(t)
    index = impact.Passages(passages, claims)

    def best(k, targets):
        found = index.best(k, None if targets is None else targets.withColumnRenamed("target", "item_id"))
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        return found.withColumn("place", place).where(F.col("place") <= k).select(F.col("item_id").alias("target"), F.col("doc_id").alias("source"), "score")

    return best


@query("greedy_assignment")
def greedy_assignment(t: Tables):
    """SEQ-01, SEQ-02, JON-05: each benchmark item takes its best document that no earlier item took."""
    found = sequences.greedy_widened(claim_lists(t))
    return found.select(F.col("target").alias("item_id"), F.col("source").alias("doc_id"), F.round("score", 9).alias("score"))


EXTENSIONS = ("py", "md", "toml", "yaml", "sh", "cpp", "js", "txt")  # of the trees made of the benchmark's items


def item_trees(t: Tables):
    """Two trees of files made of all benchmark items: by item number some keep their path, and some move to a path
    without a common word, change, or go."""
    item, k = F.col("item_id"), F.pmod("item_id", F.lit(7))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.pmod(F.floor(item / 7), F.lit(len(EXTENSIONS))).cast("int") + 1)
    path = F.concat(F.lit("src/item"), item, F.lit("."), ext)
    old = t.benchmark.where(k != 6).select(path.alias("path"), "text")
    moved = F.concat(F.lit("lib/x"), F.md5(item.cast("string").cast("binary")), F.lit("."), ext)
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    body = F.when(k.isin(1, 4), F.concat("text", F.lit("\nmore"))).when(k == 5, half).otherwise(F.col("text"))
    new = t.benchmark.where(k != 2).select(F.when(k.isin(0, 1, 6), path).otherwise(moved).alias("path"), body.alias("text"))
    return old, new


@query("file_mapping")
def file_mapping(t: Tables):
    """REV-09, SEQ-01, JON-05, MTH-13, WIN-06: how the files of two trees made of the benchmark's items belong together."""
    return changes.map_files(*item_trees(t))


@query("leader_clustering")
def leader_clustering(t: Tables):
    """SEQ-03: the sentences of each conversation, clustered in order by shared tokens."""
    df = t.conversations.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    df = df.select("conv_id", (F.col("turn") * 100_000 + F.col("pos")).alias("ord"), T.tokens(F.col("s")).alias("tokens"))
    return sequences.leaders(df, "conv_id", least=2)
