"""More queries: file revisions, moved files, phrases, job reuse, projections and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import changes, contributions, reviews
from strandline.plans.registry import Tables, query
from strandline.plans.texts import SQL_STRIP


@query("identifier_words", r"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(list_sort(w), ' ')) AS words_md5 FROM (
    SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents)""")
def identifier_words(t: Tables):
    """STR-12, STR-35: the words of each text as of an identifier."""
    df = t.documents.select("doc_id", F.array_sort(T.identifier_words(F.col("text"))).alias("w"))
    return df.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def _from_marker_sql(x: str, markers, limit: int) -> str:
    cases = " ".join(f"WHEN contains(lower({x}), '{m}') THEN substring({x}, position('{m}' IN lower({x})), {limit})" for m in markers)
    return SQL_STRIP.format(f"CASE {cases} END")


PHRASE = "'We use blocks ' || CASE item_id % 4 WHEN 0 THEN 'for speed' WHEN 1 THEN 'instead of rows to save space' WHEN 2 THEN 'without copies, while text is ' || text ELSE 'only' END"


@query("marker_phrases", f"""SELECT item_id, {_from_marker_sql("x", V.PROBLEM_MARKERS, 160)} AS problem, {_from_marker_sql("x", V.DIFFERENCE_MARKERS, 180)} AS difference
    FROM (SELECT item_id, {PHRASE} AS x FROM benchmark)""")
def marker_phrases(t: Tables):
    """STR-21, STR-22: phrases from the first marker of a list on."""
    k = F.col("item_id") % 4
    tail = F.when(k == 0, "for speed").when(k == 1, "instead of rows to save space").when(k == 2, F.concat(F.lit("without copies, while text is "), "text")).otherwise("only")
    x = F.concat(F.lit("We use blocks "), tail)
    df = t.benchmark.select("item_id", x.alias("x"))
    return df.select("item_id", T.from_marker(F.col("x"), V.PROBLEM_MARKERS, 160).alias("problem"), T.from_marker(F.col("x"), V.DIFFERENCE_MARKERS, 180).alias("difference"))


@query("repo_revision", """SELECT source AS repo_url, left(sha256('[' || string_agg('{"content_sha256":"' || sha256(text) || '","relative_path":"' || doc_id || '"}', ',' ORDER BY CAST(doc_id AS VARCHAR)) || ']'), 16) AS revision FROM documents GROUP BY source""")
def repo_revision(t: Tables):
    """HSH-05, AGG-08: the digest of each source's files."""
    return reviews.revision(t.documents.select(F.col("source").alias("repo_url"), F.col("doc_id").cast("string").alias("path"), "text"))


SNAP = """WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority || o_custkey AS text FROM orders WHERE o_orderstatus <> 'F'),
  b AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_totalprice > 300000 THEN 'x' || o_custkey ELSE o_orderpriority || o_custkey END AS text FROM orders WHERE o_orderstatus <> 'O')"""


def _snapshots(t: Tables):
    key = F.col("o_orderkey").cast("string").alias("path")
    text = F.concat("o_orderpriority", "o_custkey")
    a = t.orders.where("o_orderstatus <> 'F'").select(key, text.alias("text"))
    b = t.orders.where("o_orderstatus <> 'O'").select(key, F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("x"), "o_custkey")).otherwise(text).alias("text"))
    return changes.compare_snapshots(a, b)


COMPARED = f"""{SNAP}, c AS (SELECT path, sha256(a.text) AS old, sha256(b.text) AS new FROM a FULL JOIN b USING (path)),
  d AS (SELECT path, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS diff_type FROM c WHERE old IS DISTINCT FROM new)"""


@query("snapshot_diff", f"{COMPARED} SELECT path, diff_type FROM d")
def snapshot_diff(t: Tables):
    """JON-03: open and finished orders as two snapshots."""
    return _snapshots(t).select("path", "diff_type")


@query("moved_files", f"""{COMPARED}, o AS (SELECT path, old AS h, row_number() OVER (PARTITION BY old ORDER BY path) AS n FROM d WHERE diff_type = 'deleted'),
  w AS (SELECT path, new AS h, row_number() OVER (PARTITION BY new ORDER BY path) AS n FROM d WHERE diff_type = 'added')
  SELECT o.path AS source_path, w.path AS current_path FROM w JOIN o USING (h, n)""")
def moved_files(t: Tables):
    """JON-04, SEQ-01: files with equal content, the n-th with the n-th."""
    return changes.moved_files(_snapshots(t))


@query("reusable_job", """WITH j AS (SELECT event_id AS job, CAST(user_id % 40 AS VARCHAR) AS paper_source, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS status, ts AS created_at FROM events),
    r AS (SELECT CAST(unnest(generate_series(0, 49)) AS VARCHAR) AS paper_source)
    SELECT r.paper_source, arg_max(job, (created_at, job)) AS reused_job FROM r LEFT JOIN (SELECT * FROM j WHERE status <> 'failed') j USING (paper_source) GROUP BY r.paper_source""")
def reusable_job(t: Tables):
    """FLT-12, STM-04: the newest live job of each requested source."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("running")
    jobs = t.events.select(F.col("event_id").alias("job"), (F.col("user_id") % 40).cast("string").alias("paper_source"), status.alias("status"), F.col("ts").alias("created_at"))
    return reviews.reusable_job(jobs, t.spark.range(50).select(F.col("id").cast("string").alias("paper_source")))


@query("formula_concepts", "SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in ms) + f" THEN '{c}' END" for c, ms in V.PAPER_CONCEPTS) + "], lambda x: x IS NOT NULL), ',') AS concepts FROM documents")
def formula_concepts(t: Tables):
    """CTR-10: formula concepts of each text."""
    low = t.documents.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.array_join(contributions.concepts(F.col("low"), V.PAPER_CONCEPTS), ",").alias("concepts"))


@query("search_hit_count", """SELECT user_id, event_type AS repo, count(*) AS hits, count(DISTINCT CAST(floor(value) AS BIGINT)) AS queries, CASE WHEN count(*) > 5 THEN 'strong' ELSE 'weak' END AS kind FROM events GROUP BY ALL""")
def search_hit_count(t: Tables):
    """AGG-09: hits and distinct queries of each repository."""
    n = F.count("*")
    df = t.events.withColumn("q", F.floor("value")).groupBy("user_id", F.col("event_type").alias("repo"))
    return df.agg(n.alias("hits"), F.count_distinct("q").alias("queries"), F.when(n > 5, "strong").otherwise("weak").alias("kind"))


@query("focus_mapping", """SELECT source AS job, lang AS cluster_id, doc_id AS contribution_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, toxic DESC, n_chars DESC, doc_id DESC, lang, doc_id) AS r FROM documents JOIN labels USING (doc_id)) WHERE r = 1""")
def focus_mapping(t: Tables):
    """WIN-11, CLI-04: the mapping each job opens with."""
    df = t.documents.join(t.labels, "doc_id").select(
        F.col("source").alias("job"), F.col("quality").alias("comparable"), F.col("toxic").alias("anchors"), F.col("n_chars").alias("coverage"), F.col("doc_id").alias("confidence"),
        F.col("lang").alias("cluster_id"), F.col("doc_id").alias("contribution_id"),
    )
    return reviews.focus(df).select("job", "cluster_id", "contribution_id")


@query("event_intervals", """SELECT user_id, event_id, coalesce(lag(event_type) OVER w, 'none') AS before, coalesce(lead(event_type) OVER w, 'none') AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_intervals(t: Tables):
    """WIN-05: states before and after each event."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.coalesce(F.lag("event_type").over(w), F.lit("none")).alias("before"), F.coalesce(F.lead("event_type").over(w), F.lit("none")).alias("after"))


@query("stream_change_detect", """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE r = 1 OR before IS DISTINCT FROM event_type""")
def stream_change_detect(t: Tables):
    """STM-01, STM-02, STM-03: the change detection as a stream with state, run over what is there."""
    from strandline.operators.graph import checkpoint_folder
    from strandline.streaming import progress

    place = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = progress.event_stream(t.spark, f"{t.folder}/event[s].parquet", t.events.schema)
    progress.run_available(progress.changes(stream), f"{place}/out", f"{place}/state")
    return t.spark.read.schema(progress.CHANGE).parquet(f"{place}/out")


@query("metadata_confidence", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.86e0 ELSE 0.82e0 END AS confidence FROM pages""")
def metadata_confidence(t: Tables):
    """MTH-06: confidence by metadata file."""
    names = F.element_at(F.array(*map(F.lit, (".gitmodules", ".git/config", "CITATION.cff", "setup.py", "requirements.txt"))), F.pmod("page_id", F.lit(5)).cast("int") + 1)
    out = None
    for path, value in V.METADATA_CONFIDENCE:
        out = F.when(F.lower(names) == path, value) if out is None else out.when(F.lower(names) == path, value)
    return t.pages.select("page_id", out.otherwise(V.METADATA_DEFAULT).alias("confidence"))


@query("first_match", """SELECT doc_id, list_filter(string_split(text, ' '), lambda w: length(w) >= 8)[1] AS first_long, CAST(len(list_slice(list_distinct(string_split(lang || ' ' || source, ' ')), 1, 6)) AS INTEGER) AS n FROM documents""")
def first_match(t: Tables):
    """ARR-02, ARR-05, ARR-06: first match, bounded distinct union."""
    words = F.split("text", " ")
    return t.documents.select("doc_id", S.first_match(words, lambda w: F.length(w) >= 8).alias("first_long"), F.size(S.bounded_distinct(F.array("lang"), F.array("source"), 6)).alias("n"))


