"""Queries on ancestry candidates: each strategy on texts and logs made from the tables, and the trace over all."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.operators import candidates as C
from strandline.operators import reviews
from strandline.plans.registry import Tables, query
from strandline.plans.texts import sql_any, sql_list
from strandline.sources import readers

COLUMNS = "job, repo_url, strategy, confidence, evidence"
# What is put behind a text, by number modulo four: an address, an alias with its owner, a bare alias, nothing.
TAIL_SQL = "CASE {0} % 4 WHEN 0 THEN ' see https://github.com/Own' || ({0} % 7) || '/Repo' || ({0} % 5) || '.git.' WHEN 1 THEN ' uses huggingface/trl.' WHEN 2 THEN ' uses Triton kernels' ELSE '' END"
TAIL = ").,;:!?]}>\"''"


def urls_sql(x: str) -> str:
    key = rf"regexp_replace(rtrim(u, '{TAIL}'), '^https?://github\.com/([^/]+)/(.+?)(\.git)?$', 'https://github.com/\1/\2')"
    return f"list_distinct(list_transform(regexp_extract_all({x}, '{V.REPO_URL}'), lambda u: {key}))"


def _tail(n):
    address = F.concat(F.lit(" see https://github.com/Own"), n % 7, F.lit("/Repo"), n % 5, F.lit(".git."))
    return F.when(n % 4 == 0, address).when(n % 4 == 1, " uses huggingface/trl.").when(n % 4 == 2, " uses Triton kernels").otherwise("")


def _alias_sql(x: str) -> str:
    one = (f"CASE WHEN {f'contains({x}, {a!r})' if '/' in a else f'regexp_matches({x}, {chr(39)}{chr(92)}b{a}{chr(92)}b{chr(39)})'} THEN {{'u': '{u}', 'a': '{a}'}} END" for a, u in V.UPSTREAM_ALIASES)
    return "list_filter([" + ", ".join(one) + "], lambda x: x IS NOT NULL)"


@query(
    "paper_mention",
    f"""WITH p AS (SELECT doc_id AS job, text || {TAIL_SQL.format("doc_id")} AS x FROM documents)
    SELECT job, unnest({urls_sql("x")}) AS repo_url, 'paper_mention' AS strategy, 0.9e0 AS confidence, 'address in the text' AS evidence FROM p
    UNION ALL SELECT job, a.u, 'paper_mention', CASE WHEN contains(a.a, '/') THEN 0.76e0 ELSE 0.7e0 END, 'mentions ' || a.a FROM (SELECT job, unnest({_alias_sql("lower(x)")}) AS a FROM p)""",
)
def paper_mention(t: Tables):
    """CND-01, STR-06, STR-09: addresses and aliases in each text."""
    return C.paper_mentions(t.documents.select(F.col("doc_id").alias("job"), F.concat("text", _tail(F.col("doc_id"))).alias("text")))


@query(
    "fossil_evidence",
    f"""WITH c AS (SELECT conv_id AS job, arg_min(text || {TAIL_SQL.format("conv_id")}, turn) AS x, min(turn) AS t FROM conversations GROUP BY conv_id),
    b AS (SELECT job, x, (job + t) % 12 >= 8 AS bulk FROM c)
    SELECT job, unnest({urls_sql("x")}) AS repo_url, 'fossil_evidence' AS strategy, CASE WHEN bulk THEN 0.9e0 ELSE 0.84e0 END AS confidence, 'address in the first commit' AS evidence FROM b
    UNION ALL SELECT job, a.u, 'fossil_evidence', CASE WHEN bulk THEN 0.86e0 ELSE 0.8e0 END, 'alias in the first commit' FROM (SELECT job, bulk, unnest({_alias_sql("lower(x)")}) AS a FROM b)""",
)
def fossil_evidence(t: Tables):
    """CND-03, SRC-08: what the first commit of each history names; a conversation is a history, its turns are commits."""
    n = F.col("conv_id")
    files = F.array_repeat(F.lit("f"), F.pmod(n + F.col("turn"), F.lit(12)).cast("int"))
    commits = t.conversations.select(n.alias("repo_url"), F.col("turn").alias("ts"), F.concat("text", _tail(n)).alias("subject"), files.alias("files"))
    return C.fossils(readers.first_commit(commits).withColumnRenamed("repo_url", "job"))


CODE_SQL = "CASE doc_id % 6 WHEN 0 THEN 'import transformers' WHEN 1 THEN 'class A(DPOTrainer): pass' WHEN 2 THEN 'import triton.language' WHEN 3 THEN 'class B (BaseFairseqModel):' ELSE '' END"
PLACE_SQL = "CASE doc_id % 5 WHEN 0 THEN 'src/transformers/models/m' WHEN 1 THEN 'trl/trainer/t' ELSE 'lib/x' END || doc_id || '.py'"


def _weight_sql(imports, bases, dirs) -> str:
    parts = [f"CAST(contains(x, '{w}') AS INTEGER)" for w in imports]
    parts += [f"2 * CAST(regexp_matches(x, 'class\\s+\\w+\\([^)]*\\b{w}\\b') AS INTEGER)" for w in bases]
    parts += [f"2 * CAST(starts_with(path, '{w}') AS INTEGER)" for w in dirs]
    return " + ".join(parts)


@query(
    "framework_signature",
    f"""WITH f AS (SELECT doc_id // 3 AS job, {PLACE_SQL} AS path, text || chr(10) || {CODE_SQL} AS x FROM documents),
    w AS ({" UNION ALL ".join(f"SELECT job, '{u}' AS repo_url, {_weight_sql(i, b, d)} AS w FROM f" for u, i, b, d in V.FRAMEWORKS)}),
    s AS (SELECT job, repo_url, CAST(sum(w) AS BIGINT) AS w FROM w GROUP BY ALL)
    SELECT job, repo_url, 'framework_signature' AS strategy, round(least(0.7e0 + 0.04e0 * w, 0.97e0), 2) AS confidence, 'signature weight ' || w AS evidence FROM s WHERE w > 0""",
)
def framework_signature(t: Tables):
    """CND-04: frameworks whose imports, base classes or folders the files of a job use."""
    n = F.col("doc_id")
    code = F.when(n % 6 == 0, "import transformers").when(n % 6 == 1, "class A(DPOTrainer): pass").when(n % 6 == 2, "import triton.language").when(n % 6 == 3, "class B (BaseFairseqModel):").otherwise("")
    place = F.concat(F.when(n % 5 == 0, "src/transformers/models/m").when(n % 5 == 1, "trl/trainer/t").otherwise("lib/x"), n, F.lit(".py"))
    return C.frameworks(t.documents.select(F.floor(n / 3).alias("job"), place.alias("path"), F.concat("text", F.lit("\n"), code).alias("text")))


META = (".gitmodules", ".git/config", "CITATION.cff", "setup.py", "citation.bib")


@query(
    "metadata_url",
    f"""SELECT page_id AS job, unnest({urls_sql("x")}) AS repo_url, 'metadata_url' AS strategy,
      CASE lower(path) {" ".join(f"WHEN '{p}' THEN {v}e0" for p, v in V.METADATA_CONFIDENCE)} ELSE {V.METADATA_DEFAULT}e0 END AS confidence, 'address in ' || path AS evidence
    FROM (SELECT page_id, {sql_list(META)}[page_id % 5 + 1] AS path, html || chr(10) || 'url = https://github.com/o' || (page_id % 9) || '/r.git' || chr(10) || 'home = http://github.com/p/q-' || (page_id % 3) AS x FROM pages)""",
)
def metadata_url(t: Tables):
    """CND-05, MTH-06, SRC-04: addresses in metadata files, surer by the kind of file."""
    n = F.col("page_id")
    path = F.element_at(F.array(*map(F.lit, META)), F.pmod(n, F.lit(5)).cast("int") + 1)
    text = F.concat("html", F.lit("\nurl = https://github.com/o"), n % 9, F.lit("/r.git\nhome = http://github.com/p/q-"), n % 3)
    return C.metadata_urls(t.pages.select(n.alias("job"), path.alias("path"), text.alias("text")))


DEP_FILES = (
    ("requirements.txt", "trl==1.0\n# peft\n\nnumpy>=2\nfairseq"),
    ("pyproject.toml", "x @ git+https://github.com/huggingface/trl.git"),
    (".gitmodules", "url = https://github.com/openai/triton"),
    ("setup.py", "Accelerate~=0.3\ntriton"),
)
DEP_TABLE = "[" + ", ".join(f"{{'n': '{n}', 'u': '{u}'}}" for n, u in V.DEPENDENCY_REPOS) + "]"


@query(
    "dependency_archaeology",
    f"""WITH d AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{p}', replace('{x}', '{chr(92)}n', chr(10)))".replace(chr(10), chr(92) + "n") for k, (p, x) in enumerate(DEP_FILES))}) AS v(k, path, x)),
    f AS (SELECT DISTINCT o_custkey AS job, path, x FROM orders JOIN d ON k = o_orderkey % 4),
    direct AS (SELECT DISTINCT job, unnest({urls_sql("x")}) AS repo_url FROM f WHERE path <> '.gitmodules'),
    names AS (SELECT DISTINCT job, lower(regexp_extract(trim(line), '^([A-Za-z0-9_.-]+)', 1)) AS n FROM (SELECT job, unnest(string_split(x, chr(10))) AS line FROM f WHERE path <> '.gitmodules') WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
    named AS (SELECT DISTINCT job, e.u AS repo_url FROM names JOIN (SELECT unnest({DEP_TABLE}) AS e) ON e.n = n)
    SELECT job, repo_url, 'dependency_archaeology' AS strategy, 0.93e0 AS confidence, 'direct dependency' AS evidence FROM direct
    UNION ALL SELECT job, unnest({urls_sql("x")}), 'dependency_archaeology', 0.91e0, 'submodule' FROM f WHERE path = '.gitmodules'
    UNION ALL SELECT job, repo_url, 'dependency_archaeology', 0.79e0, 'known dependency' FROM named ANTI JOIN direct USING (job, repo_url)""",
)
def dependency_archaeology(t: Tables):
    """CND-06, JON-10, STR-37: addresses, submodules and known names in dependency files; a customer's orders pick the files."""
    files = t.spark.createDataFrame([(k, *x) for k, x in enumerate(DEP_FILES)], "k long, path string, text string")
    picked = t.orders.select(F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 4).alias("k")).distinct()
    return C.dependencies(picked.join(F.broadcast(files), "k").drop("k"))  # four literal rows


@query(
    "code_reference",
    f"""SELECT job, a.u AS repo_url, 'code_reference' AS strategy, 0.74e0 AS confidence, 'named in ' || min(path) AS evidence FROM
      (SELECT job, path, unnest({_alias_sql("lower(path || chr(10) || x)")}) AS a FROM (SELECT source AS job, 'f' || doc_id || '.py' AS path, text || {TAIL_SQL.format("doc_id")} AS x FROM documents)) GROUP BY job, a.u""",
)
def code_reference(t: Tables):
    """CND-07: known aliases in the files of each job."""
    n = F.col("doc_id")
    return C.code_references(t.documents.select(F.col("source").alias("job"), F.concat(F.lit("f"), n, F.lit(".py")).alias("path"), F.concat("text", _tail(n)).alias("text")))


LINE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'Based on' WHEN 1 THEN 'We follow' ELSE 'See' END || ' https://github.com/Own' || (doc_id % 7) || '/Repo' || (doc_id % 5) || '.'"


@query(
    "readme_declaration",
    f"""WITH r AS (SELECT doc_id AS job, text || chr(10) || {LINE_SQL} AS x FROM documents),
    u AS (SELECT job, x, unnest({urls_sql("x")}) AS repo_url FROM r),
    b AS (SELECT *, len(list_filter(string_split(lower(x), chr(10)), lambda s: contains(s, lower(regexp_extract(repo_url, '([^/]+)$', 1))) AND {sql_any("s", V.BASE_DECLARATIONS)})) > 0 AS base,
      regexp_matches(lower(x), '\\bbased on\\b|\\bbuilt on top of\\b|\\bfollow(?:ing|s)?\\b') AS follows FROM u)
    SELECT job, repo_url, CASE WHEN base THEN 'readme_base_declaration' ELSE 'readme_declaration' END AS strategy, CASE WHEN base THEN 0.99e0 WHEN follows THEN 0.88e0 ELSE 0.82e0 END AS confidence, 'address in the README' AS evidence FROM b""",
)
def readme_declaration(t: Tables):
    """CND-08, FLT-04, STR-05: addresses in a README, most sure where a line declares the base."""
    n = F.col("doc_id")
    line = F.concat(F.when(n % 3 == 0, "Based on").when(n % 3 == 1, "We follow").otherwise("See"), F.lit(" https://github.com/Own"), n % 7, F.lit("/Repo"), n % 5, F.lit("."))
    return C.readmes(t.documents.select(n.alias("job"), F.concat("text", F.lit("\n"), line).alias("text")))


@query(
    "fork_parent",
    """SELECT c_custkey AS job, 'https://github.com/N' || c_nationkey || '/seg-' || lower(c_mktsegment) AS repo_url, 'github_fork' AS strategy, 0.99e0 AS confidence, 'fork parent' AS evidence
    FROM customer WHERE c_custkey % 3 <> 0""",
)
def fork_parent(t: Tables):
    """CND-02, SRC-16: fork parents from landed repository payloads; every third repository is no fork."""
    n = F.col("c_custkey")
    parent = F.concat(F.lit("https://GitHub.com/N"), "c_nationkey", F.lit("/seg-"), F.lower("c_mktsegment"), F.lit(".git/"))
    repo = F.struct(F.when(n % 3 != 0, F.struct(parent.alias("html_url"))).alias("parent"), F.col("c_name").alias("description"))
    readme = F.to_json(F.struct(F.base64(F.col("c_name").cast("binary")).alias("content"), F.lit("base64").alias("encoding")))
    payloads = t.customer.select(n.alias("repo_url"), F.to_json(repo).alias("repository"), readme.alias("readme"))
    return C.fork_parents(readers.repository_metadata(payloads).withColumnRenamed("repo_url", "job"))


HITS_SQL = """h AS (SELECT user_id AS job, 'https://github.com/o' || (event_id % 5) || '/r' AS repo_url, event_type AS query, event_id AS ord, ts AS created_at, 'own' || (event_id % 9) AS owner, 'By ' || event_type AS description FROM events),
  q AS (SELECT job, repo_url, query, min(ord) AS o FROM h GROUP BY ALL), l AS (SELECT job, repo_url, string_agg(query, '; ' ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY job, repo_url ORDER BY o) AS r FROM q) WHERE r <= 3 GROUP BY ALL),
  g AS (SELECT job, repo_url, count(*) AS n, count(DISTINCT query) AS k, max(CASE WHEN created_at <= TIMESTAMP '2024-01-08 00:00:00' THEN 0.08e0 ELSE 0e0 END) AS early FROM h GROUP BY ALL)"""


def _hits(t: Tables):
    n = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("job"), F.concat(F.lit("https://github.com/o"), n % 5, F.lit("/r")).alias("repo_url"), F.col("event_type").alias("query"), n.alias("ord"),
        F.col("ts").alias("created_at"), F.lit("2024-01-08 00:00:00").cast("timestamp").alias("paper_ts"), F.concat(F.lit("own"), n % 9).alias("owner"),
        F.concat(F.lit("By "), "event_type").alias("description"), F.array(F.lit("own3"), F.lit("purchase")).alias("surnames"),
    )


@query(
    "search_strategies",
    f"""WITH {HITS_SQL}
    SELECT job, repo_url, 'github_code_search' AS strategy, round(least(0.68e0 + 0.06e0 * n, 0.9e0), 2) AS confidence, evidence FROM g JOIN l USING (job, repo_url)
    UNION ALL SELECT job, repo_url, 'temporal_topic_search', round(least(0.62e0 + 0.05e0 * k + early, 0.9e0), 2), evidence FROM g JOIN l USING (job, repo_url)
    UNION ALL SELECT job, repo_url, 'citation_graph', round(least(0.66e0 + 0.05e0 * n, 0.9e0), 2), evidence FROM g JOIN l USING (job, repo_url)
    UNION ALL SELECT job, repo_url, 'author_graph', 0.72e0, arg_max(query, ord) FROM h WHERE contains(owner || ' ' || lower(description), 'own3') OR contains(owner || ' ' || lower(description), 'purchase') GROUP BY job, repo_url""",
)
def search_strategies(t: Tables):
    """CND-09, CND-10, CND-11, CND-12, AGG-09, DAT-03, FLT-15: landed search hits counted by repository."""
    h = _hits(t)
    return C.code_search(h).unionByName(C.topic_search(h)).unionByName(C.citation_search(h)).unionByName(C.author_search(h))


STRATEGIES = [name for name, _ in V.STRATEGY_PRIORITY]
RAW_SQL = f"""SELECT user_id AS job, 'https://github.com/o' || (event_id % 5) || '/r' AS repo_url, {sql_list(STRATEGIES)}[event_id % {len(STRATEGIES)} + 1] AS strategy, (event_id * 7 % 95 + 5) / 100e0 AS confidence, event_type AS evidence FROM events"""
TRACE_SQL = f"""WITH jobs AS (SELECT DISTINCT user_id AS job, 'https://GitHub.com/o' || (user_id % 7) || '/r' AS own_url FROM events UNION ALL SELECT -1 - n_nationkey, n_name FROM nation),
  e AS (SELECT c.* FROM ({RAW_SQL}) c JOIN jobs USING (job) WHERE lower(repo_url) <> lower(own_url)),
  a AS (SELECT * FROM e UNION ALL SELECT job, own_url, 'fallback', 0.35e0, 'no other candidate' FROM jobs ANTI JOIN e USING (job)),
  p AS (SELECT *, CASE strategy {" ".join(f"WHEN '{n}' THEN {p}" for n, p in V.STRATEGY_PRIORITY)} ELSE 0 END AS priority FROM a),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, repo_url ORDER BY priority DESC, confidence DESC, evidence DESC, strategy DESC) AS r FROM p) WHERE r = 1),
  trace AS (SELECT job, repo_url, strategy, confidence, evidence, priority, CAST(row_number() OVER (PARTITION BY job ORDER BY priority DESC, confidence DESC, repo_url DESC, evidence DESC, strategy DESC) AS INTEGER) AS place FROM b)"""


def _raw(t: Tables):
    n = F.col("event_id")
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), (n % len(STRATEGIES)).cast("int") + 1)
    return t.events.select(F.col("user_id").alias("job"), F.concat(F.lit("https://github.com/o"), n % 5, F.lit("/r")).alias("repo_url"), strategy.alias("strategy"), ((n * 7 % 95 + 5) / 100.0).alias("confidence"), F.col("event_type").alias("evidence"))


def _trace(t: Tables):
    own = F.concat(F.lit("https://GitHub.com/o"), F.col("user_id") % 7, F.lit("/r"))
    jobs = t.events.select(F.col("user_id").alias("job"), own.alias("own_url")).distinct()
    jobs = jobs.unionByName(t.nation.select((-1 - F.col("n_nationkey")).cast("long").alias("job"), F.col("n_name").alias("own_url")))
    return C.ranked([_raw(t)], jobs)


@query(
    "candidate_trace",
    f"""{TRACE_SQL}, g AS (SELECT *, CASE strategy {" ".join(f"WHEN '{n}' THEN {v}" for n, v in reviews.RINGS)} ELSE 3 END AS ring FROM trace)
    SELECT job, repo_url, strategy, confidence, place, ring, CAST(row_number() OVER (PARTITION BY job ORDER BY ring, confidence DESC, repo_url) AS INTEGER) AS ring_place FROM g""",
)
def candidate_trace(t: Tables):
    """CND-16, CND-17, SET-01, SET-02, WIN-01, SRT-01, FLT-02, CLI-06, SRT-15: all strategies' candidates of each job
    without its own address, the best of each repository in order, and its ring; a job without any has itself."""
    return reviews.lineage_rings(_trace(t)).select("job", "repo_url", "strategy", "confidence", "place", "ring", "ring_place")


@query(
    "preview_rerank",
    f"""{TRACE_SQL}, v AS (SELECT user_id AS job, 'https://github.com/o' || (event_id % 5) || '/r' AS repo_url, count(*) FILTER (WHERE event_type = 'purchase') AS ca, count(*) FILTER (WHERE event_type = 'click') AS cf, count(*) FILTER (WHERE event_type = 'view') AS m, count(*) FILTER (WHERE event_type = 'error') AS rw, count(*) AS nw FROM events GROUP BY ALL),
    c AS (SELECT t.*, coalesce(ca, 0) AS ca, coalesce(cf, 0) AS cf, coalesce(m, 0) AS m, coalesce(rw, 0) AS rw, coalesce(nw, 0) AS nw FROM trace t LEFT JOIN v USING (job, repo_url) WHERE place <= 4 OR strategy = 'llm_reasoning')
    SELECT job, repo_url, strategy, CAST(row_number() OVER (PARTITION BY job ORDER BY ca > 0 DESC, strategy = 'readme_base_declaration' DESC, ca DESC, cf DESC, m DESC, rw DESC, nw, priority DESC, confidence DESC, repo_url DESC) AS INTEGER) AS place FROM c""",
)
def preview_rerank(t: Tables):
    """SRT-02, AGG-01: the first four and all suggested candidates by counts of their diff previews."""
    kind = F.col("event_type")
    repo = F.concat(F.lit("https://github.com/o"), F.col("event_id") % 5, F.lit("/r"))
    previews = t.events.groupBy(F.col("user_id").alias("job"), repo.alias("repo_url")).agg(
        F.count_if(kind == "purchase").alias("comparable_anchors"), F.count_if(kind == "click").alias("comparable_files"), F.count_if(kind == "view").alias("modified"),
        F.count_if(kind == "error").alias("raw"), F.count("*").alias("new"),
    )
    return C.rerank(_trace(t), previews).select("job", "repo_url", "strategy", "place")


@query(
    "search_gates",
    f"""SELECT job, NOT bool_or(list_contains({sql_list(V.LOCAL_STRATEGIES)}, strategy) AND confidence >= 0.82) AS needs_search,
      bool_or(strategy = 'github_fork') OR count(*) FILTER (WHERE strategy = 'readme_base_declaration' AND confidence >= 0.98) = 1 AS settled FROM ({RAW_SQL}) GROUP BY job""",
)
def search_gates(t: Tables):
    """FLT-05, FLT-06: jobs that need a remote search, and jobs whose base is settled."""
    raw = _raw(t)
    need = C.needs_remote_search(raw).select("job", F.lit(True).alias("needs_search"))
    done = C.is_settled(raw).select("job", F.lit(True).alias("settled"))
    df = raw.select("job").distinct().join(need, "job", "left").join(done, "job", "left")
    return df.select("job", F.coalesce("needs_search", F.lit(False)).alias("needs_search"), F.coalesce("settled", F.lit(False)).alias("settled"))
