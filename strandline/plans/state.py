"""Queries on review state: refinement, projections, job answers, client views, traces of contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import basefiles, contributions, reviews
from strandline.plans.papers import PY_PATH, PY_SQL, code_files
from strandline.plans.registry import Tables, query
from strandline.plans.texts import SQL_STRIP, sql_list, sql_tokens

# Links are line items: the order is the claim, the line the hunk; the flag is the model's verdict.
VERDICT_SQL = "CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'partially_supports' WHEN 'R' THEN 'contradicts' END"
LINKED_SQL = f"""l AS (SELECT l_orderkey AS claim_id, l_linenumber, l_suppkey % 20 AS file_id, l_linenumber % 3 <> 0 AND {VERDICT_SQL} <> 'contradicts' AS accepted FROM lineitem)"""


def _refined(t: Tables):
    """Links and verdicts; every third line's verdict is of a kind that counts for nothing."""
    flag = F.col("l_returnflag")
    hunk = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    links = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), hunk.alias("hunk_id"), (F.col("l_suppkey") % 20).alias("file_id"))
    verdict = F.when(F.col("l_linenumber") % 3 == 0, "maybe").when(flag == "A", "supports").when(flag == "N", "partially_supports").otherwise("contradicts")
    verdicts = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), hunk.alias("hunk_id"), verdict.alias("verdict")).distinct()
    return reviews.refine(links, verdicts)


@query(
    "refined_statuses",
    f"""WITH {LINKED_SQL}, c AS (SELECT o_custkey AS job, o_orderpriority AS contribution_key, o_orderkey AS claim_id, bool_or(accepted) AS m FROM orders LEFT JOIN l ON claim_id = o_orderkey GROUP BY ALL),
    s AS (SELECT *, CASE WHEN m THEN 'mapped' WHEN m IS NOT NULL THEN 'refining' ELSE 'unmapped' END AS status FROM c)
    SELECT job, contribution_key, claim_id, status, CASE WHEN bool_and(status = 'mapped') OVER w THEN 'mapped' WHEN bool_or(status = 'mapped') OVER w THEN 'partially_mapped' WHEN bool_or(status = 'refining') OVER w THEN 'refining' ELSE 'unmapped' END AS contribution_status
    FROM s WINDOW w AS (PARTITION BY job, contribution_key)""",
)
def refined_statuses(t: Tables):
    """REV-10, FLT-14, REV-05, AGG-07: links that verdicts support, and the statuses of claims and contributions."""
    claims = t.orders.select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("contribution_key"), F.col("o_orderkey").alias("claim_id"))
    df = reviews.project_statuses(claims, _refined(t).select("claim_id", "accepted"), refining=True)
    return df.select("job", "contribution_key", "claim_id", "status", "contribution_status")


STATUS_RANK = {"mapped": 0, "partially_mapped": 1, "refining": 2, "unmapped": 3}


@query(
    "claim_pane_order",
    f"""WITH {LINKED_SQL}, c AS (SELECT o_custkey AS job, o_orderpriority AS k, o_orderkey AS claim_id, coalesce(bool_or(accepted), false) AS m FROM orders LEFT JOIN l ON claim_id = o_orderkey GROUP BY ALL),
    s AS (SELECT *, CASE WHEN bool_and(m) OVER w THEN 0 WHEN bool_or(m) OVER w THEN 1 ELSE 3 END AS r FROM c WINDOW w AS (PARTITION BY job, k))
    SELECT job, claim_id, CAST(row_number() OVER (PARTITION BY job ORDER BY m DESC, r, k, claim_id) AS INTEGER) AS place FROM s""",
)
def claim_pane_order(t: Tables):
    """SRT-14: a job's claims, linked ones first, then by the status of their contribution, then by label."""
    from pyspark.sql.window import Window

    claims = t.orders.select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("contribution_key"), F.col("o_orderkey").alias("claim_id"))
    df = reviews.project_statuses(claims, _refined(t).select("claim_id", "accepted"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv)), F.col("contribution_status"))
    w = Window.partitionBy("job").orderBy((F.col("status") == "mapped").desc(), rank, "contribution_key", "claim_id")
    return df.select("job", "claim_id", F.row_number().over(w).alias("place"))


@query(
    "reprojected_entries",
    """WITH n AS (SELECT l_suppkey % 20 AS file_id, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 2 AND l_returnflag = 'A' AND l_quantity > 45) AS n FROM lineitem GROUP BY ALL),
    e AS (SELECT p_brand AS job, p_partkey % 20 AS file_id, p_name || p_partkey AS path, p_size AS changed FROM part),
    s AS (SELECT e.*, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 OR changed >= 50 THEN 3 WHEN changed >= 10 THEN 2 ELSE 1 END AS r FROM e LEFT JOIN n ON n.file_id = e.file_id AND job = 'Brand#1')
    SELECT job, path, n AS linked_claims, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS significance, CAST(row_number() OVER (PARTITION BY job ORDER BY n > 0 DESC, r DESC, changed DESC, path) AS INTEGER) AS place FROM s""",
)
def reprojected_entries(t: Tables):
    """REV-11, SRT-03, MTH-16: entries with their new link counts, sorted anew; one job has links."""
    ok = (F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)
    links = t.lineitem.select(F.lit("Brand#1").alias("job"), (F.col("l_suppkey") % 20).alias("file_id"), F.col("l_orderkey").alias("claim_id"), ok.alias("accepted"))
    entries = t.part.select(F.col("p_brand").alias("job"), (F.col("p_partkey") % 20).alias("file_id"), F.concat("p_name", "p_partkey").alias("path"), F.col("p_size").alias("changed_lines"), F.lit(0).alias("place"))
    return reviews.apply_projection(entries, links).select("job", "path", "linked_claims", "significance", "place")


@query(
    "build_status",
    f"""WITH s AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'building' ELSE 'failed' END AS status, o_custkey % {len(reviews.PHASES)} AS stage, o_orderkey % 7 AS total, o_orderkey % 11 AS done FROM orders)
    SELECT job, status = 'ready' AS available, CASE WHEN status = 'ready' THEN 100e0 ELSE greatest(0e0, least(1e0, (stage + CASE WHEN total > 0 THEN done / total ELSE 0e0 END) / {len(reviews.PHASES)})) * 100 END AS percent FROM s""",
)
def build_status(t: Tables):
    """REV-15, CLI-10, STM-05: percent and availability of each build, as a client that polls sees it."""
    phase = F.element_at(F.array(*map(F.lit, reviews.PHASES)), F.pmod("o_custkey", F.lit(len(reviews.PHASES))).cast("int") + 1)
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "building").otherwise("failed")
    df = t.orders.select(F.col("o_orderkey").alias("job"), status.alias("build_status"), phase.alias("phase"), (F.col("o_orderkey") % 11).alias("done"), (F.col("o_orderkey") % 7).alias("total"))
    return reviews.status_view(df).select("job", "available", "percent")


@query(
    "job_answers",
    """WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'unknown' END END AS status, o_orderdate AS created_at FROM orders),
    r AS (SELECT DISTINCT l_orderkey AS job, 1 AS result FROM lineitem WHERE l_shipdate < DATE '1997-01-01')
    SELECT job, CAST(CASE WHEN result IS NOT NULL THEN 200 WHEN status = 'running' THEN 202 WHEN status = 'failed' THEN 409 ELSE 404 END AS INTEGER) AS code FROM j LEFT JOIN r USING (job)""",
)
def job_answers(t: Tables):
    """API-02, API-03, API-04, SRT-11: each job, newest first, with the answer to a request for its result."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("unknown")
    jobs = t.orders.select(F.col("o_orderkey").alias("job"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    results = t.lineitem.where("l_shipdate < DATE '1997-01-01'").select(F.col("l_orderkey").alias("job")).distinct().withColumn("result", F.lit(1))
    return reviews.job_list(reviews.result_of(jobs, results)).select("job", F.col("code").cast("int").alias("code"))


@query(
    "entry_lookup",
    """WITH e AS (SELECT c_nationkey AS job, c_custkey % 40 AS file_id, c_mktsegment AS bucket, c_name AS path, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 40 ORDER BY c_mktsegment, c_custkey) AS r FROM customer),
    w AS (SELECT s_nationkey AS job, s_suppkey % 50 AS file_id FROM supplier)
    SELECT w.job, w.file_id, e.bucket, e.path FROM w LEFT JOIN e ON e.job = w.job AND e.file_id = w.file_id AND r = 1""",
)
def entry_lookup(t: Tables):
    """API-06, CLI-02: wanted files with their entry in the first bucket that holds one, null where there is none."""
    place = F.struct("c_mktsegment", "c_custkey")
    entries = t.customer.select(F.col("c_nationkey").alias("job"), (F.col("c_custkey") % 40).alias("file_id"), place.alias("bucket_place"), F.col("c_mktsegment").alias("bucket"), F.col("c_name").alias("path"))
    wanted = t.supplier.select(F.col("s_nationkey").alias("job"), (F.col("s_suppkey") % 50).alias("file_id"))
    return reviews.file_of(entries, wanted).select("job", "file_id", "bucket", "path")


@query(
    "cluster_files",
    """WITH g AS (SELECT l_suppkey AS cluster_id, 'p' || (l_partkey % 30) AS path, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS comparable FROM lineitem GROUP BY ALL)
    SELECT cluster_id, path, n, comparable, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, path) AS INTEGER) AS place FROM g""",
)
def cluster_files(t: Tables):
    """CLI-08, CLI-09, AGG-17: files of each cluster by number of anchors, and how many can be compared."""
    path = F.concat(F.lit("p"), F.col("l_partkey") % 30)
    return reviews.cluster_files(t.lineitem.select(F.col("l_suppkey").alias("cluster_id"), path.alias("path"), (F.col("l_discount") > 0.05).alias("comparable")))


@query("linked_hunks", """SELECT o_custkey AS file_id, count(*) FILTER (WHERE list_contains([o_orderkey % 5, o_orderkey % 7], o_custkey % 4)) AS n FROM orders GROUP BY o_custkey""")
def linked_hunks(t: Tables):
    """CLI-11: hunks of each file that hold the selected claim."""
    k = F.col("o_orderkey")
    return reviews.linked_hunks(t.orders.select(F.col("o_custkey").alias("file_id"), F.array(k % 5, k % 7).alias("claim_ids"), (F.col("o_custkey") % 4).alias("selected")))


@query(
    "claim_checklist",
    f"""SELECT item_id, array_to_string(list_filter(flatten(list_transform([text, CASE WHEN item_id % 2 = 0 THEN 'One. Two!' || chr(10) || ' ' END], lambda x: list_transform(string_split_regex(regexp_replace(coalesce(x, ''), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda s: {SQL_STRIP.format("s")}))), lambda s: s <> ''), '|') AS items FROM benchmark""",
)
def claim_checklist(t: Tables):
    """CLI-12, ARR-04: the non-empty sentences of what a contribution says."""
    more = F.when(F.col("item_id") % 2 == 0, "One. Two!\n ")
    return t.benchmark.select("item_id", F.array_join(reviews.checklist(F.array("text", more)), "|").alias("items"))


@query(
    "reading_order",
    f"""WITH f AS (SELECT source AS job, lang AS cluster_id, lang || '/' || CASE doc_id % 3 WHEN 0 THEN 'Loss' ELSE 'x' END || doc_id AS path, len(list_intersect({sql_tokens("text")}, ['the', 'die', 'que', 'and', 'les'])) AS shared FROM documents)
    SELECT job, cluster_id, path, CAST(shared AS INTEGER) AS shared, CAST(row_number() OVER (PARTITION BY job, cluster_id ORDER BY shared DESC, contains(lower(path), 'loss') DESC, path) AS INTEGER) AS place FROM f""",
)
def reading_order(t: Tables):
    """SRT-06, SRT-07, SRT-17: a cluster's files by words shared with the contribution, a tag in the path, and path."""
    path = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "Loss").otherwise("x"), "doc_id")
    wanted = F.array(*map(F.lit, ("the", "die", "que", "and", "les")))
    files = t.documents.select(F.col("source").alias("job"), F.col("lang").alias("cluster_id"), path.alias("path"), T.tokens(F.col("text")).alias("tokens"), wanted.alias("wanted"), F.array(F.lit("loss")).alias("tags"))
    return contributions.reading_order(files).select("job", "cluster_id", "path", F.col("shared").cast("int").alias("shared"), "place")


def _concepts_sql(x: str, table) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({x}, '{m}')" for m in ms) + f" THEN '{c}' END" for c, ms in table) + "], lambda q: q IS NOT NULL)"


SNIP_SQL = "text || CASE doc_id % 4 WHEN 0 THEN ' low_rank adapter' WHEN 1 THEN ' softmax attn' WHEN 2 THEN ' cuda' ELSE '' END"
WORDS = ("Low-Rank", "softmax", "the")


@query(
    "anchor_trace",
    f"""WITH a AS (SELECT source AS job, lang AS cluster_id, doc_id % 3 AS contribution_id, 'm/' || CASE doc_id % 5 WHEN 0 THEN 'softmax' ELSE 'f' END || (doc_id % 50) AS path, doc_id AS start, lower({SNIP_SQL}) AS low FROM documents),
    s AS (SELECT *, 3 * ({" + ".join(f"CAST(contains(low, '{w.lower()}') AS INTEGER)" for w in WORDS)}) + 4 * len(list_intersect({_concepts_sql("low", V.CODE_CONCEPTS)}, {_concepts_sql("'" + " ".join(WORDS).lower() + "'", V.PAPER_CONCEPTS)}))
      + 2 * ({" + ".join(f"CAST(contains(lower(path), '{w.lower()}') AS INTEGER)" for w in WORDS)}) AS score FROM a),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY job, cluster_id, contribution_id ORDER BY score DESC, path DESC, start DESC) AS INTEGER) AS place FROM s WHERE score > 0)
    SELECT job, cluster_id, contribution_id, path, start, CAST(score AS INTEGER) AS score, place FROM r WHERE place <= 4""",
)
def anchor_trace(t: Tables):
    """CTR-09, SRT-09: the best anchors of each contribution in each cluster."""
    n = F.col("doc_id")
    snippet = F.concat("text", F.when(n % 4 == 0, " low_rank adapter").when(n % 4 == 1, " softmax attn").when(n % 4 == 2, " cuda").otherwise(""))
    path = F.concat(F.lit("m/"), F.when(n % 5 == 0, "softmax").otherwise("f"), n % 50)
    anchors = t.documents.select(
        F.col("source").alias("job"), F.col("lang").alias("cluster_id"), (n % 3).alias("contribution_id"), path.alias("path"), n.alias("start"), snippet.alias("snippet"), F.array(*map(F.lit, WORDS)).alias("keywords")
    )
    return contributions.trace_anchors(anchors).select("job", "cluster_id", "contribution_id", "path", "start", F.col("score").cast("int").alias("score"), "place")


HINTS = ("Use a Low-Rank update of frozen weights; and apply softmax over cached keys", "short")
TITLES = ("Low-rank adapter updates for the die and les parts", "Fused softmax kernel with temperature")
_STEPS = "list_slice(list_distinct(list_filter(list_transform(flatten(list_transform([title, h1, h2], lambda s: string_split_regex(s, '" + V.STEP_SPLIT.replace("(?i)", "(?i)") + "'))), lambda s: " + SQL_STRIP.format("s") + "), lambda s: length(s) >= 18)), 1, 5)"


@query(
    "step_trace",
    f"""WITH c AS (SELECT k, title, '{HINTS[0]}' AS h1, '{HINTS[1]}' AS h2, ['the', 'Adapter', 'kernel'] AS keywords FROM (VALUES (0, '{TITLES[0]}'), (1, '{TITLES[1]}')) AS v(k, title)),
    d AS (SELECT doc_id, doc_id % 2 AS job, text || CASE doc_id % 4 WHEN 0 THEN ' Low-Rank adapter updates; frozen weights update' WHEN 1 THEN ' softmax over cached keys' WHEN 2 THEN ' fused kernel temperature' ELSE '' END AS x FROM documents),
    j AS (SELECT k, doc_id, title, h1, h2, lower(x) AS hay, {sql_tokens("x")} AS own, {_STEPS} AS steps, {sql_tokens("title")} AS tt, {sql_tokens("h1 || ' ' || h2")} AS ht, lower(title || ' ' || h1 || ' ' || h2) AS paper, keywords FROM c JOIN d ON job = k),
    m AS (SELECT k, doc_id, len(list_filter(keywords, lambda w: contains(hay, lower(w)))) AS words, len(list_filter(tt, lambda w: contains(hay, w))) AS ti, least(len(list_filter(ht, lambda w: contains(hay, w))), 3) AS hi,
      len(steps) AS n, len(list_filter(list_transform(steps, lambda s: len(list_intersect({sql_tokens("s").replace("lambda t:", "lambda z:").replace(", t)", ", z)").replace("(t,", "(z,")}, own))), lambda q: q >= 2)) AS done,
      len(list_intersect(own, {sql_tokens("paper")})) / len({sql_tokens("paper")}) AS snippet, len(list_intersect({_concepts_sql("paper", V.PAPER_CONCEPTS)}, {_concepts_sql("hay", V.CODE_CONCEPTS)})) / len({_concepts_sql("paper", V.PAPER_CONCEPTS)}) AS formula FROM j),
    s AS (SELECT *, 5 * words + 2 * ti + hi + 3 * done AS score, CASE WHEN n > 0 THEN done / n ELSE 0e0 END AS share, greatest(formula, snippet) AS fid FROM m)
    SELECT k AS contribution_id, doc_id AS cluster_id, CAST(n AS INTEGER) AS steps, CAST(done AS INTEGER) AS steps_done, CAST(score AS INTEGER) AS score, round(snippet, 9) AS snippet_fidelity, round(fid, 9) AS formula_fidelity,
      round(least(0.55e0 + 0.03e0 * score + 0.12e0 * share + 0.12e0 * snippet, 0.97e0), 2) AS confidence, round(least(0.12e0 + 0.05e0 * score + 0.24e0 * share + 0.2e0 * snippet + 0.14e0 * fid, 1e0), 2) AS coverage FROM s""",
)
def step_trace(t: Tables):
    """MTH-09, MTH-10, MTH-11, CTR-08, STR-24: score, confidence, coverage and fidelity of two contributions and the
    documents of their job."""
    n = F.col("doc_id")
    own = t.spark.createDataFrame([(k, k, title, ["the", "Adapter", "kernel"], list(HINTS)) for k, title in enumerate(TITLES)], "job long, contribution_id long, title string, keywords array<string>, hints array<string>")
    tail = F.when(n % 4 == 0, " Low-Rank adapter updates; frozen weights update").when(n % 4 == 1, " softmax over cached keys").when(n % 4 == 2, " fused kernel temperature").otherwise("")
    clusters = t.documents.select((n % 2).alias("job"), n.alias("cluster_id"), F.concat("text", tail).alias("text"))
    df = contributions.match_scores(F.broadcast(own), clusters)  # two literal rows
    return df.select(
        "contribution_id", "cluster_id", F.col("steps").cast("int").alias("steps"), F.col("steps_done").cast("int").alias("steps_done"), F.col("score").cast("int").alias("score"),
        F.round("snippet_fidelity", 9).alias("snippet_fidelity"), F.round("formula_fidelity", 9).alias("formula_fidelity"), "confidence", "coverage",
    )


_BASE_SQL = """SELECT s_suppkey AS k, 'j' || s_suppkey % 5 AS job, CASE s_suppkey % 6 WHEN 0 THEN 'lib/m' || s_suppkey % 9 || '/' || CASE WHEN s_suppkey % 4 = 0 THEN '__init__' ELSE 'n' || s_suppkey END || '.py' WHEN 1 THEN 'core/layers_' || s_suppkey || '.py' WHEN 2 THEN 'src/loss/Part' || s_suppkey || '.cu' WHEN 3 THEN 'src/part' || s_suppkey || '.py' WHEN 4 THEN 'src/adapter/other' || s_suppkey || '.rs' ELSE 'docs/part' || s_suppkey || '.md' END AS path,
  CASE WHEN s_suppkey % 4 = 1 THEN 'class Layer' || s_suppkey % 7 || ': pass' || chr(10) ELSE '' END || 'def compute_' || s_suppkey % 11 || '(x): pass  # ' || CASE s_suppkey % 3 WHEN 0 THEN 'LoRA adapter' WHEN 1 THEN 'the loss, train' ELSE 'os lib' END || ' ' || lower(s_name) AS text FROM supplier"""


@query(
    "base_file_match",
    rf"""WITH b AS (SELECT *, lower(text) AS low, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS sfx, lower(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^./]+$', '')) AS stem FROM ({_BASE_SQL})),
    p AS (SELECT p_partkey, 'j' || p_partkey % 5 AS job, {PY_PATH} AS path, {PY_SQL} AS x, CASE p_size % 3 WHEN 0 THEN ['adapter', 'loss'] WHEN 1 THEN ['Loss'] ELSE [] END AS tags FROM part),
    f AS (SELECT *, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS sfx, lower(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^./]+$', '')) AS stem,
      ['os', 'path', 'lib', 'm' || regexp_extract(x, 'lib\.m(\d)', 1), 'x'] AS imp, list_transform(tags, lambda q: lower(q)) AS tgs,
      list_distinct(list_transform(regexp_extract_all(x, '\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda q: lower(q))) AS syms FROM p),
    g AS (SELECT *, list_distinct(list_concat(list_filter(string_split(lower(path), '/'), lambda q: length(q) >= 3), list_filter([stem], lambda q: length(q) >= 3), list_filter([sfx], lambda q: length(q) > 1))) AS sig FROM f),
    h AS (SELECT *, list_distinct(list_concat(list_filter(string_split(lower(path), '/'), lambda q: length(q) >= 3), list_filter([stem], lambda q: length(q) >= 3), list_filter([sfx], lambda q: length(q) > 1))) AS sig FROM b),
    i AS (SELECT p_partkey, arg_min(h.path, CASE WHEN ends_with(h.path, '.py') AND NOT ends_with(h.path, '__init__.py') THEN 0 ELSE 1 END) AS path FROM g JOIN h ON g.job = h.job AND h.path IN ('lib/m' || regexp_extract(x, 'lib\.m(\d)', 1) || '.py', 'lib/m' || regexp_extract(x, 'lib\.m(\d)', 1) || '/__init__.py') GROUP BY p_partkey),
    d AS (SELECT job, symbol, min(path) AS path FROM (SELECT job, path, unnest(regexp_extract_all(text, '\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS symbol FROM b) GROUP BY ALL HAVING count(*) = 1),
    c AS (SELECT p_partkey, d.path FROM g JOIN d ON d.job = g.job AND d.symbol = 'Layer' || regexp_extract(x, 'Layer(\d)', 1)),
    s AS (SELECT p_partkey, h.path, CASE WHEN g.stem = h.stem THEN 6 ELSE 0 END + 2 * len(list_intersect(list_distinct(list_concat(g.sig, tgs, imp)), h.sig)) + 3 * len(list_filter(tgs, lambda q: contains(low, q))) + 2 * len(list_filter(imp, lambda q: contains(low, q))) + len(list_filter(syms, lambda q: contains(low, q))) AS score
      FROM g JOIN h ON g.job = h.job AND (g.sfx = '' OR g.sfx = h.sfx)),
    m AS (SELECT p_partkey, path FROM s WHERE score >= 5 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, path) = 1)
    SELECT p_partkey, coalesce(h.path, i.path, c.path, m.path) AS base_path FROM g LEFT JOIN h ON h.job = g.job AND h.path = g.path LEFT JOIN i USING (p_partkey) LEFT JOIN c USING (p_partkey) LEFT JOIN m USING (p_partkey)""",
)
def base_file_match(t: Tables):
    """JON-06, MTH-14, STR-32, STR-33, STR-34: the base file of each new file, among files made of the suppliers."""
    n, z = F.col("p_partkey"), F.col("p_size")
    tags = F.when(z % 3 == 0, F.array(F.lit("adapter"), F.lit("loss"))).when(z % 3 == 1, F.array(F.lit("Loss"))).otherwise(F.array().cast("array<string>"))
    files = code_files(t).join(t.part.select("p_partkey", tags.alias("tags")), "p_partkey").withColumn("job", F.concat(F.lit("j"), n % 5))
    k = F.col("s_suppkey")

    def at(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    first = F.when(k % 4 == 0, "__init__").otherwise(at("n", k))
    path = (
        F.when(k % 6 == 0, F.concat(at("lib/m", k % 9, "/"), first, F.lit(".py"))).when(k % 6 == 1, at("core/layers_", k, ".py")).when(k % 6 == 2, at("src/loss/Part", k, ".cu"))
        .when(k % 6 == 3, at("src/part", k, ".py")).when(k % 6 == 4, at("src/adapter/other", k, ".rs")).otherwise(at("docs/part", k, ".md"))
    )
    note = F.when(k % 3 == 0, "LoRA adapter").when(k % 3 == 1, "the loss, train").otherwise("os lib")
    text = F.concat(F.when(k % 4 == 1, at("class Layer", k % 7, ": pass\n")).otherwise(""), at("def compute_", k % 11, "(x): pass  # "), note, F.lit(" "), F.lower("s_name"))
    base = t.supplier.select(at("j", k % 5).alias("job"), path.alias("path"), text.alias("text"))
    found = basefiles.base_matches(files.select("job", "path", "text", "tags"), base).withColumnRenamed("new_path", "path")
    return files.join(found, ["job", "path"]).select("p_partkey", "base_path")


@query(
    "submitted_jobs",
    """WITH r AS (SELECT trim(CASE WHEN page_id % 3 = 0 THEN ' arxiv: 2401.0' || (page_id % 9000 + 1000) || ' ' ELSE url END) AS paper_source, CASE WHEN page_id % 2 = 0 THEN 'https://github.com/a/b' END AS repo_url FROM pages)
    SELECT left(sha256('{"paper_source":"' || paper_source || '","repo_url":"' || coalesce(repo_url, '') || '"}'), 24) AS job, paper_source, CASE WHEN starts_with(paper_source, 'arxiv') THEN 'arxiv' WHEN regexp_matches(lower(paper_source), '^https?://.*\\.pdf') THEN 'pdf_url' ELSE 'text_reference' END AS kind, 'queued' AS status, 0e0 AS progress, true AS stamped FROM r""",
)
def submitted_jobs(t: Tables):
    """API-01, SNK-01, HSH-02, DAT-04: requests as rows with a stable id, a queued state and a stamp of now."""
    n = F.col("page_id")
    source = F.when(n % 3 == 0, F.concat(F.lit(" arxiv: 2401.0"), n % 9000 + 1000, F.lit(" "))).otherwise(F.col("url"))
    df = reviews.submit(t.pages.select(source.alias("paper_source"), F.when(n % 2 == 0, "https://github.com/a/b").alias("repo_url")))
    stamped = (F.col("created_at") <= F.current_timestamp()) & (F.col("created_at") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR"))
    return df.select("job", "paper_source", "kind", "status", "progress", stamped.alias("stamped"))


@query(
    "cache_keys",
    """SELECT doc_id, left(sha256('{"flags":["true","2"],"modules":"' || sha256(text) || '","settings":{"top_k":5,"version":"' || lang || '"},"zeta":null}'), 32) AS cache_key FROM documents""",
)
def cache_keys(t: Tables):
    """HSH-06, HSH-07, HSH-08: the key of a stored build, over module digests and settings."""
    key = reviews.cache_key(
        modules=F.sha2(F.col("text").cast("binary"), 256), settings=F.struct(F.lit(5).alias("top_k"), F.col("lang").alias("version")),
        flags=F.from_json(F.lit("[true, 2]"), "array<string>"), zeta=F.lit(None).cast("string"),
    )
    return t.documents.select("doc_id", key.alias("cache_key"))


@query(
    "anchor_sets",
    f"""WITH c AS (SELECT source, lang, array_to_string(list_sort(list_distinct(list(n_chars % 11))), ',') AS a, array_to_string(list_sort(list_intersect(list(DISTINCT n_chars % 11), [0, 1, 2, 3])), ',') AS both FROM documents GROUP BY ALL)
    SELECT *, '0,1,2,3,{",".join(map(str, range(4, 11)))}' AS everything FROM c""",
)
def anchor_sets(t: Tables):
    """ARR-03, SET-04, AGG-15: sets of each group: all, those shared with a fixed set, and the union with a fixed set."""
    got = t.documents.groupBy("source", "lang").agg(F.collect_set(F.col("n_chars") % 11).alias("s"))
    fixed, rest = F.array(*(F.lit(k).cast("long") for k in range(4))), F.array(*(F.lit(k).cast("long") for k in range(11)))

    def text(x):
        return F.array_join(F.array_sort(x).cast("array<string>"), ",")

    s = F.col("s").cast("array<bigint>")
    return got.select("source", "lang", text(s).alias("a"), text(F.array_intersect(s, fixed)).alias("both"), text(F.array_union(F.array_union(s, fixed), rest)).alias("everything"))


@query("tree_order", """WITH p AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS ps FROM pages),
    e AS (SELECT DISTINCT host, ps[1] AS name, len(ps) = 1 AS is_file FROM p WHERE len(ps) >= 1)
    SELECT host, name, is_file, CAST(row_number() OVER (PARTITION BY host ORDER BY is_file, name) AS INTEGER) AS place FROM e""")  # fmt: skip
def tree_order(t: Tables):
    """SRT-16: the top entries of each host's tree, folders first."""
    from pyspark.sql.window import Window

    parts = F.filter(F.split(T.url_path(F.col("url")), "/"), lambda p: p != "")
    df = t.pages.select(F.lower(T.url_host(F.col("url"))).alias("host"), parts.alias("ps")).where(F.size("ps") >= 1)
    df = df.select("host", F.get("ps", F.lit(0)).alias("name"), (F.size("ps") == 1).alias("is_file")).distinct()
    return df.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("is_file", "name")))


@query(
    "demoted_mappings",
    """WITH m AS (SELECT doc_id, n_chars % 3 AS comparable, doc_id % 2 AS anchors, quality / 10e0 AS sf, toxic / 5e0 AS ff, n_chars % 10 / 10e0 AS coverage FROM documents JOIN labels USING (doc_id)),
    w AS (SELECT *, CASE WHEN comparable > 0 THEN false WHEN anchors = 0 AND sf <= 0 AND ff <= 0 THEN true WHEN coverage >= 0.25 THEN false WHEN sf >= 0.2 OR ff >= 0.2 THEN false WHEN anchors > 0 THEN false ELSE true END AS weak FROM m)
    SELECT doc_id, CASE WHEN weak THEN least(coverage, 0.1e0) ELSE coverage END AS coverage, CASE WHEN weak THEN 'MISSING' ELSE 'PARTIAL' END AS coverage_type FROM w WHERE NOT weak OR anchors > 0""",
)
def demoted_mappings(t: Tables):
    """CTR-11, FLT-08: weak mappings lose their coverage, and go where they have no anchor."""
    df = t.documents.join(t.labels, "doc_id").select(
        "doc_id", (F.col("n_chars") % 3).alias("comparable"), (F.col("doc_id") % 2).alias("anchors"), (F.col("quality") / 10.0).alias("snippet_fidelity"), (F.col("toxic") / 5.0).alias("formula_fidelity"),
        ((F.col("n_chars") % 10) / 10.0).alias("coverage"), F.lit("PARTIAL").alias("coverage_type"),
    )
    return reviews.demote_weak(df).select("doc_id", "coverage", "coverage_type")


@query("health", f"""SELECT unnest({sql_list(("alpha", "beta"))}) AS example, 'ok' AS status""")
def health(t: Tables):
    """API-07: the state of the engine and its example cases, as a literal table."""
    from strandline.plans.papers import CASES

    return t.spark.createDataFrame([(slug, "ok") for slug, _ in CASES], "example string, status string")
