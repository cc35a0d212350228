"""Queries on sources and sinks: landed payloads, archives, state tables and artifacts, written and read back in the
shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import scores as S
from strandline.functions import unicode as U
from strandline.operators import changes, contributions, diffs, papers, sequences
from strandline.operators.graph import checkpoint_folder
from strandline.plans.papers import PY_SQL, code_files
from strandline.plans.registry import Tables, query
from strandline.plans.texts import SQL_STRIP
from strandline.sources import readers, sinks
from strandline.sources.locks import build_lock


def _place(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "job_store",
    """WITH e AS (SELECT user_id AS job, event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS progress FROM events),
    b AS (SELECT *, event_id % 2 AS half, row_number() OVER (PARTITION BY job, event_id % 2 ORDER BY event_id DESC) AS r FROM e), o AS (SELECT * FROM b WHERE r = 1 AND half = 0), n AS (SELECT * FROM b WHERE r = 1 AND half = 1)
    SELECT coalesce(n.job, o.job) AS job, coalesce(n.event_id, o.event_id) AS event_id, CASE WHEN o.job IS NULL THEN n.status ELSE coalesce(nullif(n.status, ''), o.status) END AS status, coalesce(n.progress, o.progress) AS progress FROM o FULL JOIN n ON n.job = o.job""",
)
def job_store(t: Tables):
    """SNK-02, SNK-03, SNK-04, SNK-06, SNK-10, SRC-20, API-05, REV-12: two batches of updates, in a versioned table under a
    build lock; the newest row of a batch wins, and its missing fields keep what is stored."""
    table = _place(t, "jobs")
    status = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    rows = t.events.select(F.col("user_id").alias("job"), "event_id", status.alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("progress"))
    for half in (0, 1):
        with build_lock(t.spark, f"{table}-locks", "jobs") as held:
            assert held
            sinks.upsert(rows.where(F.col("event_id") % 2 == half), table, ["job"], "event_id")
    return sinks.read(t.spark, table)


@query(
    "state_log",
    """SELECT user_id AS job, event_id, event_type AS status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""",
)
def state_log(t: Tables):
    """SNK-01, SNK-05, STM-02: a log of states, appended to in two batches; only changes are kept, across batches too."""
    table = _place(t, "states")
    rows = t.events.select(F.col("user_id").alias("job"), "event_id", F.col("event_type").alias("status"))
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]  # one number
    for batch in (rows.where(F.col("event_id") <= F.lit(middle)), rows.where(F.col("event_id") > F.lit(middle))):
        sinks.append_changed(batch, table, "job", ["status"], "event_id")
    return sinks.read(t.spark, table).select("job", "event_id", "status")


@query(
    "artifact_store",
    """SELECT source AS cache_key, doc_id, CASE WHEN source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0) THEN 'new' ELSE lang END AS lang FROM documents
    WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 3 <> 0)""",
)
def artifact_store(t: Tables):
    """SNK-07, SRC-22, REV-13: stored payloads by key; a second write replaces only its own keys, and only ready ones are
    read. The table is read by version."""
    folder = _place(t, "artifacts")
    per = t.documents.groupBy(F.col("source").alias("cache_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    rows = t.documents.select(F.col("source").alias("cache_key"), "doc_id", "lang")
    sinks.write_artifacts(rows, folder)
    sinks.write_artifacts(rows.join(per.where("n % 2 = 0"), "cache_key", "left_semi").withColumn("lang", F.lit("new")), folder)
    sessions = per.select("cache_key", F.when(F.col("first") % 3 != 0, "ready").otherwise("building").alias("build_status"))
    published = _place(t, "published")
    sinks.publish(sessions, published)
    sessions = sinks.read(t.spark, published)
    return readers.artifacts(t.spark, folder, sessions, "doc_id long, lang string").select("cache_key", "doc_id", "lang")


@query("migrated_rows", """SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS phase, 0 AS n_warnings FROM customer""")
def migrated_rows(t: Tables):
    """SNK-09: columns that an older table lacks, as nulls and empty lists; those it has stay."""
    df = sinks.migrate(t.customer.select("c_custkey", "c_name"), {"c_name": "string", "phase": "string", "warnings": "array<string>"})
    return df.select("c_custkey", "c_name", "phase", F.size("warnings").alias("n_warnings"))


@query(
    "search_payloads",
    """SELECT user_id AS job, event_type AS query, CAST(o AS INTEGER) AS ord, 'https://github.com/U' || (event_id % 9) || '/r' || o AS repo_url, CASE o WHEN 0 THEN 'd ' || event_id END AS description,
      CASE o WHEN 0 THEN 'own' || (event_id % 4) END AS owner, CASE WHEN o = 0 AND event_id % 2 = 0 THEN TIMESTAMP '2023-05-06 07:08:09' END AS created_at
    FROM events, (SELECT unnest([0, 1]) AS o)""",
)
def search_payloads(t: Tables):
    """SRC-18, DAT-02: hits of landed search payloads, in both shapes; what is no address or no time is null or goes."""
    n = F.col("event_id")
    first = F.struct(
        F.concat(F.lit("https://GitHub.com/U"), n % 9, F.lit("/r0.git")).alias("html_url"), F.concat(F.lit("d "), n).alias("description"),
        F.when(n % 2 == 0, "2023-05-06T07:08:09Z").otherwise("soon").alias("created_at"), F.struct(F.concat(F.lit("Own"), n % 4).alias("login")).alias("owner"),
    )
    second = F.struct(F.struct(F.concat(F.lit("https://github.com/U"), n % 9, F.lit("/r1/")).alias("html_url")).alias("repository"))
    payload = F.concat(F.lit('{"items": ['), F.to_json(first), F.lit(", "), F.to_json(second), F.lit(', {"html_url": "nowhere"}]}'))
    rows = t.events.select(F.col("user_id").cast("string").alias("strategy"), F.col("event_type").alias("query"), payload.alias("payload"))
    df = readers.search_hits(rows)
    return df.select(F.col("strategy").cast("long").alias("job"), "query", F.col("ord").cast("int").alias("ord"), "repo_url", "description", "owner", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(
    "atom_feed",
    """SELECT item_id, 'On ' || item_id AS title, regexp_replace(trim(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS abstract, 'A B|C ' || (item_id % 5) AS authors FROM benchmark WHERE item_id % 4 <> 3""",
)
def atom_feed(t: Tables):
    """SRC-09: title, abstract and authors of a feed's first entry; an entry without a title goes."""
    n = F.col("item_id")
    text = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    title = F.when(n % 4 == 3, " ").otherwise(F.concat(F.lit(" On\n "), n))
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title, F.lit("</title><summary> "), text, F.lit("</summary><author><name>A B</name></author><author><name>C "),
        n % 5, F.lit("</name></author></entry><entry><title>second</title></entry></feed>"),
    )
    return readers.atom_entries(t.benchmark.select("item_id", xml.alias("xml"))).select("item_id", "title", "abstract", F.array_join("authors", "|").alias("authors"))


@query(
    "latex_document",
    """SELECT doc_id AS job, CASE WHEN doc_id % 5 = 0 THEN 'given' ELSE 'Doc ' || doc_id END AS title, lang || ' x' AS abstract, 'Ann B.|Cy D' AS authors,
      'Links=https://github.com/a/b|Intro=see https://github.com/a/b ' || source || '|Our Method=done' AS sections FROM documents""",
)
def latex_document(t: Tables):
    """STR-27, STR-28, SRC-10, SRC-11, STR-26: parts of the LaTeX source of landed archives; the main file is chosen by
    what it holds, and metadata fill in what it lacks."""
    n = F.col("doc_id")
    title = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("\\title{Doc \\emph{"), n, F.lit("}}")))
    tex = F.concat(
        F.lit("\\documentclass{a}"), title, F.lit(" % note {\n\\author{Ann B. \\and Cy D, X}\n\\begin{abstract} "), "lang", F.lit("~x\\cite{k} \\end{abstract}\n\\section{Intro} see https://github.com/a/b "),
        "source", F.lit("\n\\section*{Our \\textbf{Method}} done"),
    )
    helper = F.concat(F.lit("% a longer helper\n"), F.repeat(F.lit("x"), 900))
    archives = t.documents.select(n.cast("string").alias("source"), F.explode(F.array(tex.cast("binary"), helper.cast("binary"))).alias("content"))
    main = readers.primary_tex(readers.tar_members(archives))
    df = papers.latex_parts(main.select(F.col("source").cast("long").alias("job"), F.col("text").alias("tex"), F.lit("given").alias("meta_title"), F.lit("other").alias("meta_abstract")))
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s["heading"], F.lit("="), s["text"])), "|")
    return df.select("job", "title", "abstract", F.array_join("authors", "|").alias("authors"), sections.alias("sections"))


@query(
    "fallback_sources",
    """SELECT doc_id AS paper, CASE WHEN lang = 'en' THEN 'own' ELSE 'page' END AS title, CASE WHEN lang = 'en' THEN 'w' ELSE 'source missing|late' END AS warnings FROM documents""",
)
def fallback_sources(t: Tables):
    """SRC-15, SRC-14, UDF-03, UDF-01: each request goes to its kind's reader, and what that lacks comes from the fallback
    with a warning put first."""
    kind = F.when(F.col("lang") == "en", F.concat(F.lit("arxiv: 2401."), F.lpad((F.col("doc_id") % 10000).cast("string"), 5, "1"))).otherwise(F.concat("source", F.lit(".pdf")))
    requests = t.documents.select(F.col("doc_id").alias("paper"), kind.alias("source"))
    columns = ["paper", F.lit("own").alias("title"), F.array(F.lit("w")).alias("warnings")]
    primary = readers.by_kind(requests, {"arxiv": lambda df: df.select(*columns), "pdf_file": lambda df: df.where("false").select(*columns)})
    fallback = t.documents.select(F.col("doc_id").alias("paper"), F.lit("page").alias("title"), F.array(F.lit("late")).alias("warnings"))
    out = readers.with_fallback(primary, fallback, "paper", "source missing")
    return out.select("paper", "title", F.array_join("warnings", "|").alias("warnings"))


@query(
    "file_reads",
    """WITH w AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
    SELECT doc_id, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN NULL ELSE md5(text) END AS strict, CASE WHEN k = 0 THEN NULL ELSE md5(text) END AS lossy, k = 2 AS in_snapshot FROM w JOIN documents USING (doc_id)""",
)
def file_reads(t: Tables):
    """SRC-03, SRC-05, SRC-06, FLT-01: single files and snapshot members as text; broken UTF-8 is null or loses its bad
    bytes, and a missing file is null."""
    n = F.col("doc_id")
    path = F.concat(F.when(n % 4 == 2, "src/f").otherwise("docs/f"), n, F.lit(".py"))
    raw = F.col("text").cast("binary")
    content = F.when(n % 4 == 1, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    files = t.documents.where(n % 4 != 0).select("doc_id", F.lit("r").alias("repo_url"), path.alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))
    wanted = t.documents.select("doc_id", F.lit("r").alias("repo_url"), path.alias("path"))
    read = readers.one_file(files.drop("doc_id", "length"), wanted)
    kept = readers.snapshot(files, most=1 << 30, max_bytes=1 << 30).select("path", F.lit(True).alias("in_snapshot"))
    df = read.withColumn("lossy", readers.lossy_text(F.col("content"))).join(kept, "path", "left")
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("strict"), F.md5(F.col("lossy").cast("binary")).alias("lossy"), F.coalesce("in_snapshot", F.lit(False)).alias("in_snapshot"))


BROKEN_SQL = "'See long-' || chr(10) || '  winded   Text ' || item_id || ', e.g. Fig. 2.' || chr(13) || chr(10) || 'It ends. So does this! ' || text || '  '"


@query(
    "claim_normalise",
    rf"""WITH b AS (SELECT item_id, {BROKEN_SQL} AS x FROM benchmark)
    SELECT item_id, lower(trim(regexp_replace(regexp_replace(x, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), '\s+', ' ', 'g'))) AS claim, rtrim(replace(x, chr(13) || chr(10), chr(10)), ' ' || chr(10)) AS line,
      'See long-|winded   Text ' || item_id || ', e.g. Fig. 2.|It ends.|So does this!|' || regexp_replace(trim(text), '([.!?])\s+', '\1|', 'g') AS sentences FROM b JOIN benchmark USING (item_id)""",
)
def claim_normalise(t: Tables):
    """STR-13, STR-14, STR-44, UDF-05: claims and lines in normal form, and sentences that abbreviations do not end."""
    x = F.concat(F.lit("See long-\n  winded   Text "), "item_id", F.lit(", e.g. Fig. 2.\r\nIt ends. So does this! "), "text", F.lit("  "))
    df = t.benchmark.select("item_id", x.alias("x"))
    return df.select("item_id", U.normalize_claim("x").alias("claim"), U.normalize_line("x").alias("line"), F.array_join(U.split_claims("x"), "|").alias("sentences"))


@query(
    "python_names",
    rf"""SELECT p_partkey, array_to_string(list_sort(list_distinct(['os.path', 'x', 'base', 'int', 'mixin', 'self', 'train', lower(regexp_extract({PY_SQL}, 'class (\w+)', 1)), 'layer' || regexp_extract({PY_SQL}, 'Layer(\d)', 1), 'compute_' || regexp_extract({PY_SQL}, 'compute_(\d+)', 1)])), ',') AS names,
      'a-b,trl' AS dependencies FROM part""",
)
def python_names(t: Tables):
    """STR-50, STR-38: names of parsed code, and dependencies of a project file."""
    toml = F.lit('[project]\ndependencies = ["A-b>=1", 3]\n[tool.poetry.dependencies]\npython = "3"\ntrl = "1"\n')
    df = code_files(t).select("p_partkey", U.ast_tokens("text").alias("n"), U.pyproject_dependencies(toml).alias("d"))
    return df.select("p_partkey", F.array_join("n", ",").alias("names"), F.array_join("d", ",").alias("dependencies"))


@query(
    "comparable_anchors",
    f"""WITH a AS (SELECT source, doc_id, text, lag(text) OVER w AS old, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    c AS (SELECT source, doc_id, {SQL_STRIP.format("text")} <> '' AND {SQL_STRIP.format("old")} <> '' AND {SQL_STRIP.format("text")} <> {SQL_STRIP.format("old")} AS comparable FROM a WHERE r > 1)
    SELECT source, doc_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY comparable DESC, doc_id) AS INTEGER) AS place FROM c) WHERE place <= 6""",
)
def comparable_anchors(t: Tables):
    """FLT-07, WIN-10, CTR-12: the first six anchors of each cluster, those first whose two sides can be compared."""
    w = Window.partitionBy("source").orderBy("doc_id")
    df = t.documents.select("source", "doc_id", F.lag("text").over(w).alias("old"), "text").where("old is not null")
    df = df.select("source", "doc_id", S.comparable_anchor(F.col("old"), F.col("text")).alias("comparable"))
    best = Window.partitionBy("source").orderBy(F.desc("comparable"), "doc_id")
    return df.withColumn("place", F.row_number().over(best)).where("place <= 6").select("source", "doc_id", "place")


@query(
    "file_payloads",
    """WITH d AS (SELECT doc_id, string_split('@@ -1,2 +1,3 @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '-') || chr(10) || '@@ -9 +9 @@' || chr(10) || ' same' || chr(10) || '+tail', chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line FROM d)
    SELECT doc_id AS file_id, count(*) FILTER (WHERE starts_with(line, '+')) AS added, count(*) FILTER (WHERE starts_with(line, '-')) AS removed, count(*) FILTER (WHERE starts_with(line, '+') OR starts_with(line, '-')) AS changed, CAST(2 AS BIGINT) AS n_hunks,
      left(sha256('{"file_id":"' || doc_id || '","new_start":1,"old_start":1}'), 24) || ' 1,2 1,3|' || left(sha256('{"file_id":"' || doc_id || '","new_start":9,"old_start":9}'), 24) || ' 9,1 9,1' AS hunks FROM l GROUP BY doc_id""",
)
def file_payloads(t: Tables):
    """DIF-05, ARR-07, AGG-02: the payload of each file: sums over its hunks, and the hunks in order with their ids."""
    text = F.concat(F.lit("@@ -1,2 +1,3 @@\n+"), F.replace("text", F.lit("\n"), F.lit("\n-")), F.lit("\n@@ -9 +9 @@\n same\n+tail"))
    df = changes.file_payloads(diffs.hunks(t.documents.select(F.col("doc_id").alias("file_id"), text.alias("diff")), "file_id", "diff"))

    def hunk(h):
        return F.concat(h["hunk_id"], F.lit(" "), F.concat_ws(",", h["old_start"], h["old_count"]), F.lit(" "), F.concat_ws(",", h["new_start"], h["new_count"]))

    return df.select("file_id", "added", "removed", "changed", "n_hunks", F.array_join(F.transform("hunks", hunk), "|").alias("hunks"))


@query(
    "rendered_diff",
    """WITH l AS (SELECT doc_id, unnest(string_split('@@ -1 +1 @@' || chr(10) || '-' || text || chr(10) || '+<b>&"', chr(10))) AS line, generate_subscripts(string_split('@@ -1 +1 @@' || chr(10) || '-' || text || chr(10) || '+<b>&"', chr(10)), 1) AS pos FROM documents),
    r AS (SELECT doc_id, pos, '<tr class="' || CASE WHEN starts_with(line, '@@') THEN 'hunk' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'del' ELSE 'same' END || '"><td>' || replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td></tr>' AS row FROM l)
    SELECT doc_id, md5('<table>' || string_agg(row, '' ORDER BY pos) || '</table>') AS html_md5 FROM r GROUP BY doc_id""",
)
def rendered_diff(t: Tables):
    """SNK-08: diffs as HTML tables."""
    diff = F.concat(F.lit("@@ -1 +1 @@\n-"), "text", F.lit('\n+<b>&"'))
    return t.documents.select("doc_id", F.md5(diffs.html(diff).cast("binary")).alias("html_md5"))


@query(
    "merged_suggestions",
    """WITH own AS (SELECT doc_id AS job, 1 AS ord, 'Own ' || lang AS title, [lang, 'x'] AS ks FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 1, 'Other', ['o'] FROM documents WHERE doc_id % 3 = 0),
    s AS (SELECT doc_id AS job, -999999 AS ord, 'OWN ' || upper(lang) AS title, ['k', 'x', 'y', 'z', 'q'] AS ks FROM documents WHERE doc_id % 2 = 0),
    b AS (SELECT job, lower(title) AS key, min(ord) AS ord, arg_min(title, ord) AS title, arg_min(ks, ord) AS k1, arg_max(ks, ord) AS k2 FROM (SELECT * FROM own UNION ALL SELECT * FROM s) GROUP BY ALL)
    SELECT job, title, array_to_string(list_slice(list_concat(k1, list_filter(k2, lambda w: NOT list_contains(k1, w))), 1, 6), ',') AS keywords FROM b""",
)
def merged_suggestions(t: Tables):
    """CTR-06, CTR-07, SEQ-06: structured contributions, or the fallback's where a job has none; suggested ones first,
    merged by title with six keywords at most."""
    n = F.col("doc_id")
    kind = "array<string>"

    def rows(df, title, *words):
        return df.select(n.alias("job"), F.lit(1).alias("ord"), F.lit("c").alias("id"), title.alias("title"), F.array(*words).cast(kind).alias("keywords"))

    structured = rows(t.documents.where(n % 3 > 0), F.concat(F.lit("Own "), "lang"), F.col("lang"), F.lit("x"))
    own = contributions.structured_or_fallback(structured, rows(t.documents, F.lit("Other"), F.lit("o")))
    suggested = rows(t.documents.where(n % 2 == 0), F.concat(F.lit("OWN "), F.upper("lang")), *map(F.lit, "kxyzq"))
    return contributions.with_suggestions(own, suggested).select("job", "title", F.array_join("keywords", ",").alias("keywords"))


@query("folded_sets")
def folded_sets(t: Tables):
    """SEQ-04, SEQ-06: the sentences of each conversation's users, which take up those of its assistants."""
    from strandline.functions import text as T

    n = F.col("conv_id")
    df = t.conversations.select(n, "role", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "title"))
    words = T.tokens(F.col("title"))
    long = F.length("title") > 60
    df = df.select(
        n, "role", (F.col("turn") * 100_000 + F.col("pos")).alias("ord"), F.concat_ws("-", n, "turn", "pos").alias("id"), "title", words.alias("words"),
        F.when(F.col("pos") == 0, "Abstract").otherwise(F.concat(F.lit("Section "), "pos")).alias("section"), F.slice(words, 1, 3).alias("keywords"),
        F.slice(words, 3, 4).alias("impl_hints"), F.when(long, F.col("title")).alias("problem_solved"), F.when(~long, F.col("title")).alias("baseline_difference"),
        F.array(F.concat(F.lit("turn "), "turn"), F.concat(F.lit("place "), "pos")).alias("evidence_refs"), (F.length("title") % 5).cast("int").alias("complexity"),
    )
    user = F.col("role") == "user"
    return sequences.merge_sets(df.where(user).drop("role"), df.where(~user).drop("role"), "conv_id")


@query("synthesised_contributions")
def synthesised_contributions(t: Tables):
    """CTR-05, SEQ-03, SRT-05, SRT-08: findings of each conversation clustered in order, the best clusters with their lead."""
    from strandline.functions import text as T

    kind = F.when(F.col("turn") % 3 == 0, "contributions").when(F.col("turn") % 3 == 1, "method").otherwise("abstract")
    found = t.conversations.select(F.col("conv_id").alias("job"), F.col("turn").alias("ord"), kind.alias("kind"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "snippet"))
    found = found.withColumn("score", (4 + F.length("snippet") % 5).cast("long"))
    return contributions.synthesise(found).select("job", "cluster", "score", "size", "lead", F.array_join("keywords", " ").alias("keywords"))


@query("assigned_clusters")
def assigned_clusters(t: Tables):
    """SEQ-02: clusters of each job in order take their best contribution, of equals one that is not used yet."""
    scores = t.lineitem.select(
        (F.col("l_orderkey") % 500).alias("job"), F.lpad((F.col("l_suppkey") % 12).cast("string"), 2, "0").alias("cluster_id"),
        F.concat(F.lit("C"), F.col("l_partkey") % 7).alias("contribution_id"), (F.col("l_quantity") % 4).cast("long").alias("score"),
    )
    best = scores.groupBy("job", "cluster_id", "contribution_id").agg(F.max("score").alias("score"))
    return contributions.assign(best)


@query("fixture_rows", """SELECT n_nationkey, n_name, 'n_nationkey=' || n_nationkey || '/' AS folder, n_name || chr(10) AS content FROM nation""")
def fixture_rows(t: Tables):
    """SRC-01, SRC-13, SRC-17, SRC-21: JSON fixtures, and a tree of files with their contents, written and read back."""
    fixtures, tree = _place(t, "fixtures"), _place(t, "tree")
    rows = t.nation.select("n_nationkey", "n_name")
    rows.groupBy("n_nationkey").agg(F.first("n_name").alias("n_name")).select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name"), {"pretty": "true"}).alias("value")).repartition(
        64, "n_nationkey"
    ).write.partitionBy("n_nationkey").text(fixtures)
    rows.write.partitionBy("n_nationkey").text(tree)
    read = readers.fixture(t.spark, fixtures, "n_nationkey int, n_name string").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    files = readers.file_tree(t.spark, tree).where(F.contains("path", F.lit("part-")))
    files = files.select(F.regexp_replace("path", "part-.*$", "").alias("folder"), F.col("content").cast("string").alias("content"))
    return read.join(files, F.concat(F.lit("n_nationkey="), "n_nationkey", F.lit("/")) == F.col("folder"))


@query(
    "landed_pages",
    """SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN md5(html) END AS html_md5 FROM pages""",
)
def landed_pages(t: Tables):
    """SRC-19: the landed page of each wanted address; every fifth was not fetched."""
    n = F.col("page_id")
    # Addresses may repeat; the number makes them differ.
    own = F.concat(F.regexp_replace("url", r"#.*$", ""), F.lit("?id="), n)
    wanted = t.pages.select("page_id", F.concat(own, F.lit("#top")).alias("url"))
    df = readers.landed_pages(wanted, t.pages.where(n % 5 != 4).select(own.alias("url"), "html"))
    return df.select("page_id", F.md5(F.col("html").cast("binary")).alias("html_md5"))


PDF_HEAD = "%PDF-1.4\n1 0 obj<</Type /Catalog /Pages 2 0 R>>endobj\n2 0 obj<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2>>endobj\n3 0 obj<</Type /Page /Contents 5 0 R>>endobj\n4 0 obj<</Type /Page /Contents [6 0 R]>>endobj\n"


@query(
    "pdf_pages",
    """SELECT item_id, CAST(k AS INTEGER) AS page, 'Paper (' || item_id || ')' AS title, CASE k WHEN 0 THEN 'Heading ' || item_id || chr(10) || 'first (a) line' ELSE 'AB c' END AS text FROM benchmark, (SELECT unnest([0, 1]) AS k) WHERE item_id % 3 > 0""",
)
def pdf_pages(t: Tables):
    """SRC-12, SRC-23: pages of PDF files; every third file is none."""
    n = F.col("item_id")
    one = F.concat(F.lit("BT /F1 12 Tf 72 700 Td (Heading "), n, F.lit(") Tj 0 -14 Td [(fir) -20 (st) -300 (\\(a\\) line)] TJ ET"))
    body = F.concat(
        F.lit(PDF_HEAD), F.lit("5 0 obj<</Length 9>>stream\n"), one, F.lit("\nendstream endobj\n6 0 obj<<>>stream\nBT <4142> Tj ( c) Tj ET\nendstream endobj\n7 0 obj<</Title (Paper \\("), n, F.lit("\\))>>endobj\n"),
    )
    files = t.benchmark.select(n.cast("string").alias("path"), F.when(n % 3 > 0, body).otherwise("no paper").cast("binary").alias("content"))
    return readers.pdf_pages(files).select(F.col("path").cast("long").alias("item_id"), "page", "title", "text")


@query(
    "symmetric_matches",
    """WITH p AS (SELECT p_partkey AS k, lag(p_partkey) OVER (ORDER BY p_partkey) AS j, string_split(p_name, ' ') AS a, lag(string_split(p_name, ' ')) OVER (ORDER BY p_partkey) AS b FROM part)
    SELECT k AS p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_intersect(a, b), list_concat(list_intersect(a, [b[1]]), list_intersect([a[2]], b))))), ',') AS shared FROM p WHERE j IS NOT NULL""",
)
def symmetric_matches(t: Tables):
    """SET-05, MTH-01: words that neighbouring names share, or share with the other's stem."""
    a = t.part.select("p_partkey", F.split("p_name", " ").alias("a"))
    b = t.part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.split("p_name", " ").alias("b"))  # keys are dense
    shared = S.symmetric_match(F.col("a"), F.get("a", F.lit(1)), F.col("b"), F.get("b", F.lit(0)))
    return a.join(b, "p_partkey").select("p_partkey", F.array_join(shared, ",").alias("shared"))


@query(
    "cluster_records",
    """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_brand || '-' || p_size AS change_type, p_type AS label, string_split(p_name, ' ') AS tags, 'f' || p_partkey AS path FROM part),
    r AS (SELECT id, change_type || '|' || unnest(list_concat(list_transform(tags, lambda x: 't:' || x), ['l:' || label])) AS r FROM c),
    cc(id, low) USING KEY (id) AS (SELECT id, id FROM c UNION (SELECT y.id, min(cc.low) FROM cc JOIN r x ON x.id = cc.id JOIN r y ON y.r = x.r JOIN recurring.cc AS old ON old.id = y.id WHERE cc.low < old.low GROUP BY y.id)),
    n AS (SELECT low, label, count(*) AS n FROM cc JOIN c USING (id) GROUP BY ALL),
    b AS (SELECT low, label FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC, label DESC) AS k FROM n) WHERE k = 1)
    SELECT low AS cluster, b.label, b.label || ': ' || count(*) || ' file(s) changed as ' || arg_min(change_type, id) || ' (shared words).' AS summary, string_agg(path, ',' ORDER BY path) AS files FROM cc JOIN (SELECT id, change_type, path FROM c) c USING (id) JOIN b USING (low) GROUP BY low, b.label""",
)
def cluster_records(t: Tables):
    """GRF-01, GRF-02, AGG-06, SRT-12, STR-52: clusters of linked parts with their label, files and summary."""
    from strandline.functions import text as T

    changed = t.part.select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("-"), "p_size").alias("change_type"), F.split("p_name", " ").alias("tags"), F.array().cast("array<string>").alias("imports"),
        F.col("p_type").alias("label"), F.concat(F.lit("f"), "p_partkey").alias("dir"), F.concat(F.lit("f"), "p_partkey").alias("path"),
    )
    df = changes.clusters(changed)
    return df.select("cluster", "label", T.cluster_summary(F.col("label"), F.col("files"), F.col("change_type"), F.lit("shared words")).alias("summary"), F.array_join("files", ",").alias("files"))


@query(
    "merged_details",
    """WITH c AS (SELECT item_id AS job, p AS place, CASE p WHEN 1 THEN 'Alpha beta ' || (item_id % 3) ELSE 'Gamma delta words' END AS title, CASE p WHEN 1 THEN ['alpha', 'beta'] ELSE ['gamma', 'delta', 'words'] END AS ks FROM benchmark, (SELECT unnest([1, 2]) AS p)),
    d AS (SELECT item_id AS job, o AS ord, CASE o WHEN 0 THEN 'the alpha and the beta' WHEN 1 THEN 'words of gamma, delta' WHEN 2 THEN 'only alpha here' ELSE 'alpha beta gamma delta words' END AS snippet, 'Eq. ' || o AS ref FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS o) WHERE item_id % 4 <> o),
    m AS (SELECT job, ord, snippet, ref, CASE WHEN ord = 0 THEN 1 WHEN ord = 1 THEN 2 WHEN ord = 3 THEN 2 END AS place FROM d WHERE ord <> 2)
    SELECT c.job, c.place, coalesce(string_agg(snippet, '|' ORDER BY ord), '') AS hints, array_to_string(list_concat(['Table 1'], coalesce(list(ref ORDER BY ord) FILTER (WHERE ref IS NOT NULL), [])), '|') AS refs, CAST(CASE WHEN count(m.ord) > 0 THEN 4 ELSE 3 END AS INTEGER) AS complexity
    FROM c LEFT JOIN m ON m.job = c.job AND m.place = c.place GROUP BY c.job, c.place""",
)
def merged_details(t: Tables):
    """SEQ-05: detail findings go to the contribution that shares most words with them, two at least."""
    n, p, o = F.col("item_id"), F.col("place"), F.col("ord")
    own = t.benchmark.select(n.alias("job"), n, F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    words = F.when(p == 1, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array(*map(F.lit, ("gamma", "delta", "words"))))
    own = own.select("job", "place", F.when(p == 1, F.concat(F.lit("Alpha beta "), n % 3)).otherwise("Gamma delta words").alias("title"), words.alias("keywords"), F.array(F.lit("Table 1")).alias("evidence_refs"), F.lit(3).alias("complexity"))
    snippet = F.when(o == 0, "the alpha and the beta").when(o == 1, "words of gamma, delta").when(o == 2, "only alpha here").otherwise("alpha beta gamma delta words")
    details = t.benchmark.select(n.alias("job"), F.explode(F.array(*map(F.lit, range(4)))).alias("ord")).where(F.col("job") % 4 != o)
    df = contributions.merge_details(own, details.select("job", "ord", snippet.alias("snippet"), F.array(F.concat(F.lit("Eq. "), o)).alias("refs")))
    return df.select("job", "place", F.array_join("hints", "|").alias("hints"), F.array_join("evidence_refs", "|").alias("refs"), F.col("complexity").cast("int").alias("complexity"))
