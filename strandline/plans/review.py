"""Queries that link claims (benchmark items) to passages (documents), and what is rolled up from the links."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.functions import unicode as U
from strandline.operators import changes, impact, manifest, ranking
from strandline.plans.registry import Tables, query
from strandline.plans.texts import sql_any, sql_tokens


MARKER = r"(?i)\b(eq|fig|sec|tab)\b"
TAGS = [name for name, _ in V.SEMANTIC_TAGS]


def _parts(df, *keep):
    """Adds the lower-cased text's tokens (ts), semantic tags as bits, and whether it has a marker."""
    df = df.select(*keep, "text", F.lower("text").alias("low"))
    bits = F.aggregate(T.semantic_tags(F.col("low")), F.lit(0).cast("long"), lambda s, x: s + F.expr("1L") * F.pow(F.lit(2), F.array_position(F.array(*map(F.lit, TAGS)), x) - 1).cast("long"))
    kept = [k if isinstance(k, str) else "path" for k in keep]
    return df.select(*kept, T.tokens(F.col("text")).alias("ts"), bits.alias("tags"), F.col("text").rlike(MARKER).cast("long").alias("marker"))


def claim_parts(t: Tables):
    """The claims and passages as `impact.best_matches` takes them; the path of a passage is its source and language."""
    path = F.array_distinct(F.array_compact(F.array("source", "lang"))).alias("path")
    return _parts(t.benchmark, "item_id"), _parts(t.documents, "doc_id", path)


def claim_scores(t: Tables, keep: int = 5):
    """(item_id, doc_id, score): the six-part scores of each claim's `keep` best documents at least, none of score 0."""
    return impact.best_matches(*claim_parts(t), keep)


def _sql_recall(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b})) / len({b}) END"


def _sql_tags(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_any(x, ms)} THEN '{v}' END" for v, ms in V.SEMANTIC_TAGS) + "], lambda q: q IS NOT NULL)"


_SQL_MARKED = "regexp_matches({}, '(?i)\\b(eq|fig|sec|tab)\\b')"
SCORES = f"""SELECT * FROM (SELECT item_id, doc_id, round(0.20e0 * {_sql_recall("path", "c")} + 0.20e0 * {_sql_recall("h", "c")} + 0.20e0 * {_sql_recall("dg", "cg")}
    + 0.15e0 * {_sql_recall("list_distinct(list_concat(h, path))", "c")} + 0.20e0 * {_sql_recall("c", "h")} + 0.05e0 * CASE WHEN cm AND dm THEN 1e0 ELSE 0e0 END, 9) AS score
  FROM (SELECT item_id, {sql_tokens("text")} AS c, {_sql_tags("lower(text)")} AS cg, {_SQL_MARKED.format("text")} AS cm FROM benchmark)
  CROSS JOIN (SELECT doc_id, {sql_tokens("text")} AS h, {_sql_tags("lower(text)")} AS dg, {_SQL_MARKED.format("text")} AS dm, list_distinct([source, lang]) AS path FROM documents)) WHERE score > 0"""
TOP = f"""SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM ({SCORES})) WHERE rank <= 5"""
LINKS = f"SELECT item_id, doc_id, score FROM ({TOP}) WHERE score >= greatest(0.08e0, 0.6e0 * best)"


def _top(t: Tables):
    return ranking.top_with_cutoff(claim_scores(t), "item_id", "score", [F.desc("doc_id")], V.TOP_K, V.MIN_SCORE, V.RELATIVE_FLOOR)


def _links(t: Tables):
    return _top(t).where("accepted").select("item_id", "doc_id", "score")


@query("claim_hunk_topk", f"SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({TOP})")
def claim_hunk_topk(t: Tables):
    """JON-08, MTH-02, WIN-03: the five best passages of each claim by the six-part score."""
    return _top(t).select("item_id", "doc_id", "score", "rank")


@query("link_acceptance", LINKS)
def link_acceptance(t: Tables):
    """WIN-03: links that reach the floor and 0.6 of the claim's best."""
    return _links(t)


@query("claim_score_full", f"SELECT item_id, doc_id, score, score >= greatest(0.08e0, 0.6e0 * best) AS accepted FROM ({TOP})")
def claim_score_full(t: Tables):
    """MTH-12, STR-53, JON-08, REV-04: each claim's five best by the six-part score, and which are accepted."""
    return _top(t).select("item_id", "doc_id", "score", "accepted")


@query(
    "status_rollup",
    f"""WITH l AS ({LINKS}), s AS (SELECT b.item_id, b.item_id % 5 AS contribution, coalesce(bool_or(q.quality = 1), false) AS mapped FROM benchmark b LEFT JOIN l USING (item_id) LEFT JOIN labels q USING (doc_id) GROUP BY b.item_id)
    SELECT contribution, count(*) AS claims, count(*) FILTER (WHERE mapped) AS mapped, CASE WHEN bool_and(mapped) THEN 'mapped' WHEN bool_or(mapped) THEN 'partially_mapped' ELSE 'unmapped' END AS status FROM s GROUP BY contribution""",
)
def status_rollup(t: Tables):
    """AGG-07, REV-05: contribution status from the claims that good documents back."""
    backed = _links(t).join(t.labels, "doc_id").groupBy("item_id").agg(F.bool_or(F.col("quality") == 1).alias("m"))
    df = t.benchmark.select("item_id").join(backed, "item_id", "left").select((F.col("item_id") % 5).alias("contribution"), F.coalesce("m", F.lit(False)).alias("m"))
    status = F.when(F.bool_and("m"), "mapped").when(F.bool_or("m"), "partially_mapped").otherwise("unmapped")
    return df.groupBy("contribution").agg(F.count("*").alias("claims"), F.count_if("m").alias("mapped"), status.alias("status"))


@query(
    "group_projection",
    f"""WITH l AS ({LINKS})
    SELECT item_id % 5 AS contribution, source AS cluster, round(max(score), 9) AS best, count(DISTINCT item_id) AS claims, round(least(0.95e0, max(score) + 0.15e0), 9) AS confidence,
      CASE WHEN count(DISTINCT item_id) / 8e0 >= 0.75 THEN 'FULL' ELSE 'PARTIAL' END AS coverage
    FROM l JOIN documents USING (doc_id) GROUP BY ALL""",
)
def group_projection(t: Tables):
    """AGG-04, REV-06, SRT-10: the best link and the claims of each contribution and cluster."""
    df = _links(t).join(t.documents.select("doc_id", F.col("source").alias("cluster")), "doc_id").withColumn("contribution", F.col("item_id") % 5)
    claims = F.count_distinct("item_id")
    return df.groupBy("contribution", "cluster").agg(
        F.round(F.max("score"), 9).alias("best"), claims.alias("claims"), F.round(F.least(F.lit(0.95), F.max("score") + 0.15), 9).alias("confidence"),
        F.when(claims / 8.0 >= 0.75, "FULL").otherwise("PARTIAL").alias("coverage"),
    )


_TREES = """WITH d AS (SELECT doc_id, doc_id % 7 AS k, source, lang, text, text || chr(10) || '# ' || doc_id AS body, rtrim(replace(left(text, 200), chr(10), ' ')) AS more FROM documents),
    f AS (SELECT *, CASE WHEN k IN (0, 1, 5) THEN 'src/' || source || '/f' || doc_id || '.py' WHEN k = 2 THEN 'old/m.x' || doc_id WHEN k = 4 THEN 'src/d' || doc_id || '.rs' WHEN k = 6 THEN 'docs/' || doc_id || '.md' END AS source_path,
      CASE WHEN k IN (0, 1, 5) THEN 'src/' || source || '/f' || doc_id || '.py' WHEN k = 2 THEN 'new/m.x' || doc_id WHEN k = 3 THEN 'src/a' || doc_id || '.pyi' WHEN k = 6 THEN 'docs/' || doc_id || '.md' END AS current_path,
      CASE k WHEN 3 THEN 'added' WHEN 4 THEN 'deleted' ELSE 'modified' END AS diff_type, CASE k WHEN 2 THEN 'content_moved' WHEN 3 THEN 'added' WHEN 4 THEN 'deleted' ELSE 'exact_path' END AS match_type,
      CASE WHEN k = 2 THEN 'x' || doc_id WHEN k = 4 THEN 'rust' WHEN k = 6 THEN 'text' ELSE 'python' END AS language, CAST(len(string_split(body, chr(10))) AS BIGINT) AS n FROM d WHERE k <> 5),
    g AS (SELECT *, CASE WHEN k IN (0, 1, 6) THEN 1 WHEN k = 3 THEN n ELSE 0 END AS added, CASE WHEN k = 4 THEN n ELSE 0 END AS removed, CASE WHEN k = 2 THEN 0 ELSE 1 END AS n_hunks,
      CASE WHEN k = 3 THEN 1 ELSE greatest(n - 3, 0) + 1 END AS new_start, CASE WHEN k = 3 THEN n ELSE least(n, 3) + 1 END AS new_count,
      CASE WHEN k = 3 THEN regexp_replace(body, '[ \t]+(\n|$)', '\1', 'g') ELSE more END AS said FROM f)"""

_HUNKS = _TREES + r""", h AS (SELECT *, list_filter(list_distinct(string_split(trim(regexp_replace(lower(said), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')), lambda x: x <> '') AS ws,
      list_filter(list_distinct(list_transform(list_concat(string_split(current_path, '/'), [regexp_replace(string_split(current_path, '/')[-1], '\.[^.]*$', '')]), lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')))), lambda x: x <> '') AS path,
      doc_id % 3 = 0 AND CASE WHEN doc_id % 2 = 0 THEN new_start <= n + 1 AND n <= new_start + new_count - 1 ELSE new_start <= 1 END AS anchored FROM g WHERE k IN (0, 1, 3)),
    c AS (SELECT *, CASE WHEN anchored THEN 'lang:' || lang WHEN doc_id % 2 = 0 THEN source END AS cluster, CASE WHEN anchored THEN LANG_TAG WHEN doc_id % 2 = 0 THEN 'TAG4' END AS tag FROM h)""".replace(
    "LANG_TAG", "CASE lang " + " ".join(f"WHEN '{lang}' THEN '{V.SEMANTIC_TAGS[i][0]}'" for i, lang in enumerate(("en", "de", "fr", "es"))) + " END"
).replace("TAG4", V.SEMANTIC_TAGS[4][0])

_MANIFEST = _HUNKS + f""", b AS (SELECT item_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), lambda x: x <> '') AS c, {_sql_tags("lower(text)")} AS cg, {_SQL_MARKED.format("text")} AS cm FROM benchmark),
    p AS (SELECT item_id, doc_id, current_path, round(0.20e0 * {_sql_recall("path", "c")} + 0.20e0 * {_sql_recall("ws", "c")} + 0.20e0 * {_sql_recall("list_filter([tag], lambda q: q IS NOT NULL)", "cg")}
      + 0.15e0 * {_sql_recall("list_distinct(list_concat(ws, path))", "c")} + 0.20e0 * {_sql_recall("c", "ws")} + 0.05e0 * CASE WHEN cm AND {_SQL_MARKED.format("said")} THEN 1e0 ELSE 0e0 END, 9) AS score FROM b CROSS JOIN c),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, current_path DESC) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM p WHERE score > 0),
    l AS (SELECT * FROM r WHERE rank <= 5 AND score >= greatest(0.08e0, 0.6e0 * best))"""


def manifest_trees(t: Tables):
    """Two trees made of all documents: by number some files are changed, moved, added, deleted, kept or not code; with
    clusters by source and language, and anchors at the end or the start of some."""
    n, k = F.col("doc_id"), F.col("doc_id") % 7
    body = F.concat("text", F.lit("\n# "), n)

    def at(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    kept = at("src/", F.col("source"), "/f", n, ".py")
    old_path = F.when(k.isin(0, 1, 5), kept).when(k == 2, at("old/m.x", n)).when(k == 4, at("src/d", n, ".rs")).when(k == 6, at("docs/", n, ".md"))
    new_path = F.when(k.isin(0, 1, 5), kept).when(k == 2, at("new/m.x", n)).when(k == 3, at("src/a", n, ".pyi")).when(k == 6, at("docs/", n, ".md"))
    more = F.rtrim(F.replace(F.left("text", F.lit(200)), F.lit("\n"), F.lit(" ")))
    new_text = F.when(k.isin(0, 1, 6), at(body, "\n", more)).otherwise(body)
    old = t.documents.where(k != 3).select(old_path.alias("path"), body.alias("text"))
    new = t.documents.where(k != 4).select(new_path.alias("path"), new_text.alias("text"))
    lines = F.size(F.split(body, "\n", -1))
    own = t.documents.where(k.isin(0, 1, 3))
    start, end = F.when(n % 2 == 0, lines).otherwise(1), F.when(n % 2 == 0, lines + 1).otherwise(1)
    anchors = own.where(n % 3 == 0).select(new_path.alias("path"), at("lang:", F.col("lang")).alias("cluster"), start.alias("start_line"), end.alias("end_line"))
    members = own.where(n % 2 == 0).select(new_path.alias("path"), F.col("source").alias("cluster"))
    by_lang = F.when(F.col("lang") == "en", TAGS[0]).when(F.col("lang") == "de", TAGS[1]).when(F.col("lang") == "fr", TAGS[2]).when(F.col("lang") == "es", TAGS[3])
    tags = t.documents.select(at("lang:", F.col("lang")).alias("cluster"), by_lang.alias("tag")).unionByName(t.documents.select(F.col("source").alias("cluster"), F.lit(TAGS[4]).alias("tag"))).distinct()
    return old, new, t.benchmark.select("item_id", "text"), anchors, members, tags


@query(
    "hunk_candidates",
    _HUNKS + """ SELECT doc_id, CAST(new_start AS INTEGER) AS new_start, CAST(new_count AS INTEGER) AS new_count, coalesce(cluster, '') AS clusters, coalesce(tag, '') AS tag_words, array_to_string(list_sort(path), '|') AS path_names, md5(array_to_string(list_sort(ws), ' ')) AS words, md5(said) AS changed_text FROM c""",
)
def hunk_candidates(t: Tables):
    """REV-03, JON-09, STR-14, STR-35, FLT-11: the hunks between two trees that claims can be linked to, with the clusters
    whose anchors they overlap, or else the file's."""
    old, new, _, anchors, members, tags = manifest_trees(t)
    files = manifest.file_diffs(changes.map_files(old, new), old, new, "")
    found = changes.hunk_candidates(files, anchors, members, tags)
    doc = F.regexp_extract("path", r"(\d+)\.pyi?$", 1).cast("long")
    return found.select(
        doc.alias("doc_id"), "new_start", "new_count", F.array_join("clusters", ",").alias("clusters"), F.array_join("tag_words", ",").alias("tag_words"), F.array_join(F.array_sort("path_names"), "|").alias("path_names"),
        F.md5(F.array_join(F.array_sort("words"), " ").cast("binary")).alias("words"), F.md5(F.col("changed_text").cast("binary")).alias("changed_text"),
    )


@query(
    "review_manifest",
    _MANIFEST + """, k AS (SELECT doc_id, count(DISTINCT item_id) AS linked FROM l GROUP BY doc_id),
    e AS (SELECT source_path, current_path, diff_type, match_type, language, added, removed, n_hunks, coalesce(linked, 0) AS linked_claims, CASE k WHEN 3 THEN 'new_file' WHEN 4 THEN 'deleted_file' ELSE CASE WHEN language <> 'python' THEN 'unsupported_language' ELSE 'fallback_text' END END AS semantic_status,
      CASE WHEN k = 3 THEN 'added' WHEN k = 4 THEN 'deleted' WHEN language <> 'python' THEN 'other_languages' ELSE 'primary' END AS bucket, CASE WHEN coalesce(linked, 0) > 0 OR added + removed >= 50 THEN 'high' WHEN added + removed >= 10 THEN 'medium' ELSE 'low' END AS significance,
      left(sha256('{"cache_key":"","current_rel_path":"' || coalesce(current_path, '/dev/null') || '","diff_type":"' || diff_type || '","source_rel_path":"' || coalesce(source_path, '/dev/null') || '"}'), 24) AS file_id FROM g LEFT JOIN k USING (doc_id))
    SELECT file_id, source_path, current_path, diff_type, match_type, semantic_status, language, bucket, significance, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed, CAST(n_hunks AS BIGINT) AS n_hunks, linked_claims,
      CAST(row_number() OVER (PARTITION BY bucket ORDER BY linked_claims > 0 DESC, CASE significance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, added + removed DESC, coalesce(current_path, source_path)) AS INTEGER) AS place FROM e""",
)
def review_manifest(t: Tables):
    """REV-01, REV-03, REV-04, REV-07, REV-08, API-08: the manifest of the differences between two trees: files mapped and
    diffed, hunks linked to claims, and an entry for each changed file in the order of review."""
    return manifest.build(*manifest_trees(t))["entries"]


@query(
    "build_phases",
    _MANIFEST + """ SELECT * FROM (VALUES (1, 'file_mapping'), (2, 'claim_extraction'), (3, 'diff_generation'), (4, 'deterministic_linking'), (5, 'fallback_render'), (6, 'persisting')) AS v(place, phase),
    LATERAL (SELECT CASE place WHEN 2 THEN (SELECT count(*) FROM b) WHEN 3 THEN (SELECT count(*) FROM c) WHEN 4 THEN (SELECT count(*) FROM l) WHEN 5 THEN 0 ELSE (SELECT count(*) FROM g) END AS done)""",
)
def build_phases(t: Tables):
    """REV-01, REV-15: the phases of a build with the rows that each has done."""
    return manifest.build(*manifest_trees(t))["phases"]


@query("claim_index", r"""SELECT item_id, left(sha256('{"claim":' || item_id || ',"text":"' || s || '"}'), 20) AS claim_id, s AS claim_text, CAST(k AS INTEGER) AS k FROM (
    SELECT item_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s, k, row_number() OVER (PARTITION BY item_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) ORDER BY k) AS r FROM (
      SELECT item_id, unnest(ss) AS s, unnest(generate_series(0, len(ss) - 1)) AS k FROM (SELECT item_id, list_concat(['As in Fig. 3, e.g. item ' || item_id || '.'], list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1|', 'g'), '|'), lambda x: trim(x) <> '')) AS ss FROM benchmark)))
    WHERE r = 1 AND length(s) >= 12""")  # fmt: skip
def claim_index(t: Tables):
    """REV-02, FLT-10, HSH-09, WIN-09, STR-44: claims of each item, split where no abbreviation ends, normalised, long enough
    and not seen before in it."""
    text = F.concat(F.lit("As in Fig. 3, e.g. item "), "item_id", F.lit(". "), "text")
    df = t.benchmark.select("item_id", text.alias("text")).select("item_id", F.posexplode(U.split_claims("text")).alias("k", "s"))
    df = df.withColumn("s", F.btrim(F.regexp_replace(F.lower("s"), "[^a-z0-9]+", " ")))
    df = ranking.first_per_key(df, ["item_id", "s"], ["k"]).where(F.length("s") >= 12)
    return df.select("item_id", S.stable_digest(20, claim=F.col("item_id"), text=F.col("s")).alias("claim_id"), F.col("s").alias("claim_text"), "k")


@query("bucket_view", f"""WITH k AS (SELECT unnest({[*V.BUCKETS]!r}) AS bucket, unnest(generate_series(1, {len(V.BUCKETS)})) AS place)
    SELECT k.bucket, CAST(k.place AS INTEGER) AS place, count(d.doc_id) AS n FROM k LEFT JOIN (SELECT doc_id, CASE WHEN lang <> 'en' THEN 'other_languages' WHEN n_chars > 5000 THEN 'large_files' ELSE 'primary' END AS bucket FROM documents) d USING (bucket) GROUP BY ALL""")
def bucket_view(t: Tables):
    """CLI-01, AGG-11: all buckets in order, the empty ones too."""
    b = F.when(F.col("lang") != "en", "other_languages").when(F.col("n_chars") > 5000, "large_files").otherwise("primary")
    counts = t.documents.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    keys = t.spark.createDataFrame([(name, k + 1) for k, name in enumerate(V.BUCKETS)], "bucket string, place int")
    return keys.join(counts, "bucket", "left").select("bucket", "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("best_anchor", f"""SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM ({SCORES})) WHERE r = 1""")
def best_anchor(t: Tables):
    """CLI-07, SRT-07: each claim's best passage, the first of equals, as a maximum combined before the shuffle."""
    best = F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("m")
    return claim_scores(t, 1).groupBy("item_id").agg(best).select("item_id", (-F.col("m.d")).alias("doc_id"))


@query("weak_mapping", """SELECT doc_id, CASE WHEN n_chars % 3 > 0 THEN false WHEN doc_id % 2 = 0 AND quality <= 0 AND toxic <= 0 THEN true WHEN n_chars % 10 / 10e0 >= 0.25 THEN false WHEN quality >= 0.2 OR toxic >= 0.2 THEN false WHEN doc_id % 2 > 0 THEN false ELSE true END AS weak FROM documents JOIN labels USING (doc_id)""")
def weak_mapping(t: Tables):
    """FLT-08, CLI-05, CTR-11: the ordered rules for weak mappings, on measures made from the tables."""
    df = t.documents.join(t.labels, "doc_id")
    weak = S.weak_mapping(F.col("n_chars") % 3, F.col("doc_id") % 2, F.col("quality"), F.col("toxic"), (F.col("n_chars") % 10) / 10.0)
    return df.select("doc_id", weak.alias("weak"))
