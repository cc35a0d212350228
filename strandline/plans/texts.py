"""Queries on text, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.plans.registry import Tables, query

WS = r"[ \t\n\x0B\f\r]"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def sql_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def sql_first(x: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(x, ms)} THEN {v!r}" for v, ms in table) + f" ELSE {default} END"


def sql_tokens(x: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{V.TOKEN}')), "
        f"lambda t: NOT list_contains({sql_list(V.STOPWORDS)}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"
    )


SQL_STRIP = "regexp_replace(regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')"
SQL_SENTENCES = (
    "list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), "
    "'\\x01|\\n+'), lambda s: " + SQL_STRIP.format("s") + "), lambda s: s <> '')"
)


@query(
    "tokenize_docs",
    f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5
    FROM (SELECT doc_id, {sql_tokens("text")} AS t FROM documents)""",
)
def tokenize_docs(t: Tables):
    """STR-10: token set of each document."""
    tok = T.tokens(F.col("text"))
    df = t.documents.select("doc_id", F.array_sort(tok).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "token_list",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{V.TOKEN}') AS ts FROM documents),
    e AS (SELECT doc_id, unnest(ts) AS tok, unnest(generate_series(1, len(ts))) AS pos FROM t),
    f AS (SELECT doc_id, tok, min(pos) AS pos FROM e GROUP BY ALL)
    SELECT doc_id, count(*) AS n_tokens, md5(string_agg(tok, ' ' ORDER BY pos)) AS tokens_md5 FROM f GROUP BY doc_id""",
)
def token_list(t: Tables):
    """STR-11, ARR-01: tokens in order of first occurrence."""
    df = t.documents.select("doc_id", T.token_list(F.col("text")).alias("t")).where(F.size("t") > 0)
    return df.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "sentence_split",
    f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(1))) AS sentences_md5
    FROM (SELECT doc_id, {SQL_SENTENCES} AS s FROM documents)""",
)
def sentence_split(t: Tables):
    """STR-15: sentences of each document."""
    df = t.documents.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return df.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\x01")).alias("sentences_md5"))


@query(
    "list_items",
    r"""SELECT doc_id, CAST(len(i) AS BIGINT) AS n_items, array_to_string(i, chr(1)) AS items FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all('- ' || replace(text, chr(10), chr(10) || '- '),
      '(?m)^\s*(?:[-*•]|(?:\(?\d+[\.\)])|(?:\(?[a-zA-Z][\.\)]))\s+(.+)$', 1), lambda s: """
    + SQL_STRIP.format("s")
    + """), lambda s: length(s) >= 25) AS i FROM documents)""",
)
def list_items(t: Tables):
    """STR-16: bulleted items of at least 25 characters; each line is made an item first."""
    bulleted = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n- ")))
    df = t.documents.select("doc_id", T.list_items(bulleted).alias("i"))
    return df.select("doc_id", F.size("i").cast("long").alias("n_items"), F.array_join("i", "\x01").alias("items"))


HEADINGS = "(1, '1 Abstract'), (2, '2.1  Our Contributions'), (3, 'Methods'), (4, 'Experimental Evaluation'), (5, 'A Appendix'), (6, 'Related work'), (7, '3 Implementation Details')"


@query(
    "section_kind",
    f"""WITH h AS (SELECT k, n, regexp_replace(regexp_replace({SQL_STRIP.format("lower(h)")}, '^\\d+(?:\\.\\d+)*\\s+', ''), '\\s+', ' ', 'g') AS g
      FROM (SELECT conv_id AS k, count(*) AS n FROM conversations GROUP BY conv_id) AS c JOIN (VALUES {HEADINGS}) AS v(i, h) ON c.k % 7 + 1 = v.i)
    SELECT k AS conv_id, {sql_first("g", V.SECTION_KINDS, "'other'")} AS kind,
      CAST({sql_first("g", [(v, (m,)) for m, v in V.HEADING_BOOSTS], "0")} AS INTEGER) AS boost, g AS heading FROM h""",
)
def section_kind(t: Tables):
    """STR-17, STR-18, STR-19: normalised heading, boost and kind."""
    h = t.spark.sql(f"SELECT * FROM VALUES {HEADINGS} AS v(i, h)")
    ids = t.conversations.groupBy(F.col("conv_id")).count()
    df = ids.join(F.broadcast(h), F.pmod("conv_id", F.lit(7)) + 1 == F.col("i"))  # seven literal rows
    x = F.col("h")
    return df.select("conv_id", T.section_kind(x).alias("kind"), T.heading_boost(x).cast("int").alias("boost"), T.heading(x).alias("heading"))


def sql_count(x: str, markers) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{m}') AS INTEGER)" for m in markers) + ")"


@query(
    "sentence_score",
    f"""WITH s AS (SELECT doc_id, ss, generate_subscripts(ss, 1) AS pos, unnest(ss) AS s FROM (SELECT doc_id, {SQL_SENTENCES} AS ss FROM documents)),
    r AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(3 * {sql_count("lower(s)", V.CONTRIBUTION_MARKERS)} + {sql_count("lower(s)", V.TECHNICAL_MARKERS)}
      + least(len({sql_tokens("s")}) // 6, 3) AS INTEGER) AS score FROM s)
    SELECT doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM r) WHERE r <= 3""",
)
def sentence_score(t: Tables):
    """MTH-07, CTR-02: the three sentences of each document with the highest score."""
    df = t.documents.select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "s")).where("pos is not null")
    df = df.select("doc_id", (F.col("pos") + 1).alias("pos"), T.sentence_score(F.col("s")).cast("int").alias("score"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    return df.withColumn("r", F.row_number().over(best)).where("r <= 3").drop("r")


@query(
    "title_from_sentence",
    f"""WITH s AS (SELECT doc_id, {SQL_SENTENCES}[1] AS s FROM documents)
    SELECT doc_id, left(array_to_string(list_slice(list_filter(string_split_regex(rtrim(regexp_replace(s,
      '{V.LEADING_PHRASE}', ''), '.'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), 1, 8), ' '), 120) AS title
    FROM s WHERE s IS NOT NULL""",
)
def title_from_sentence(t: Tables):
    """STR-23: a title from each document's first sentence."""
    df = t.documents.select("doc_id", F.get(T.sentences(F.col("text")), F.lit(0)).alias("s")).where("s is not null")
    return df.select("doc_id", T.title_of(F.col("s")).alias("title"))


@query(
    "url_extract",
    r"""WITH p AS (SELECT page_id, 'http://h.example' AS base, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h, url FROM pages),
    u AS (SELECT page_id, unnest(list_transform(h, lambda x: CASE WHEN starts_with(x, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || x ELSE x END)) AS u FROM p),
    c AS (SELECT page_id, rtrim(u, ').,;:!?]}>"''') AS u FROM u WHERE regexp_matches(u, '^https?://[^\s<>()"'']+$'))
    SELECT page_id, count(DISTINCT u) AS n_urls, min(u) AS first_url, max(u) AS last_url FROM c GROUP BY page_id""",
)
def url_extract(t: Tables):
    """STR-07, STR-08: addresses of each page, its relative links joined to the page's host."""
    links = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), F.lit(1))
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    full = F.transform(links, lambda x: F.when(F.startswith(x, F.lit("/")), F.concat(base, x)).otherwise(x))
    full = F.filter(full, lambda u: u.rlike(r"^https?://[^\s<>()\"']+$"))
    found = F.array_distinct(F.transform(full, lambda u: F.rtrim(u, F.lit(V.URL_TAIL))))
    df = t.pages.select("page_id", found.alias("u")).where(F.size("u") > 0)
    return df.select("page_id", F.size("u").cast("long").alias("n_urls"), F.array_min("u").alias("first_url"), F.array_max("u").alias("last_url"))


SQL_REPO = r"""
  SELECT page_id, b, regexp_extract(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host,
    list_filter(string_split(regexp_extract(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS ps
  FROM (SELECT page_id, rtrim(trim(url), ').,;:!?]}>"''') AS b FROM pages)"""


@query(
    "repo_url_norm",
    rf"""SELECT page_id, 'https://' || lower(host) || '/' || ps[1] || '/' || regexp_replace(ps[2], '\.git$', '') AS repo_url
    FROM ({SQL_REPO}) WHERE len(ps) >= 2 AND regexp_matches(b, '^https?://') AND regexp_replace(ps[2], '\.git$', '') <> ''""",
)
def repo_url_norm(t: Tables):
    """STR-04: canonical address of the first two path parts."""
    return t.pages.select("page_id", T.repo_key(F.col("url")).alias("repo_url")).where("repo_url is not null")


ALIASES = ("the", "licensed under", "apache", "and/or", "that")


@query(
    "alias_match",
    "SELECT alias, doc_id FROM documents, (SELECT unnest(" + sql_list(ALIASES) + r""") AS alias) WHERE CASE WHEN contains(alias, '/')
    THEN contains(lower(text), alias) ELSE regexp_matches(regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g'), '\b' || alias || '\b') END""",
)
def alias_match(t: Tables):
    """FLT-03, JON-12: which of a few literal aliases each document holds, as one pass over the documents."""
    # Non-ASCII letters count as word characters on both sides.
    flat = F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "_")
    found = F.array(*(F.when(T.has_alias(flat, F.lit(a)), F.lit(a)) for a in ALIASES))
    return t.documents.select(F.explode(F.filter(found, lambda a: a.isNotNull())).alias("alias"), "doc_id")


@query(
    "classify_change",
    f"""SELECT doc_id, CASE WHEN c <> '' THEN c WHEN doc_id % 2 = 0 THEN 'NEW_MODULE' ELSE 'MODIFIED_CORE' END AS change_type
    FROM (SELECT doc_id, {sql_first("lower(source || chr(10) || text)", V.CHANGE_TYPES, "''")} AS c FROM documents)""",
)
def classify_change(t: Tables):
    """STR-43, STR-47: change type of each document; even ids count as new."""
    hay = F.lower(F.concat_ws("\n", "source", "text"))
    return t.documents.select("doc_id", T.change_type(hay, F.col("doc_id") % 2 == 0).alias("change_type"))


@query(
    "semantic_tags",
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any('lower(text)', ms)} THEN '{v}' END" for v, ms in V.SEMANTIC_TAGS)
    + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents",
)
def semantic_tags(t: Tables):
    """STR-42: tags of each document."""
    low = t.documents.select("doc_id", F.lower("text").alias("low"))  # once, not for each marker
    return low.select("doc_id", F.array_join(T.semantic_tags(F.col("low")), ",").alias("tags"))


@query("trim_text", f"""SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE regexp_replace(left(s, 77), '[ \\t\\n\\x0B\\f\\r]+$', '') || '...' END AS short
    FROM (SELECT doc_id, {SQL_STRIP.format("text")} AS s FROM documents)""")  # fmt: skip
def trim_text(t: Tables):
    """STR-45: each text cut to 80 characters."""
    return t.documents.select("doc_id", T.trim_to(F.col("text"), 80).alias("short"))


@query("compact_text", f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {SQL_STRIP.format("s")}), lambda s: s <> ''), chr(10))) AS compact_md5 FROM documents""")
def compact_text(t: Tables):
    """STR-25: texts without blank lines."""
    return t.documents.select("doc_id", F.md5(T.compact(F.col("text"))).alias("compact_md5"))


@query(
    "html_clean",
    r"""SELECT page_id, length(x) AS n_chars, md5(x) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM pages)""",
)
def html_clean(t: Tables):
    """STR-25, STR-26 style rewrites: the text of each page."""
    df = t.pages.select("page_id", T.strip_html(F.col("html")).alias("x"))
    return df.select("page_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("text_md5"))


@query("patch_id", """SELECT l_orderkey, l_linenumber, left(sha1(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || l_returnflag), 12) AS patch_id FROM lineitem""")
def patch_id(t: Tables):
    """HSH-01: a stable id of each line item."""
    keys = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.patch_id(*keys).alias("patch_id"))


@query(
    "stable_digest",
    """SELECT doc_id, left(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}'), 24) AS digest,
    left(sha256(text), 20) AS content FROM documents""",
)
def stable_digest(t: Tables):
    """HSH-02, HSH-03, HSH-09: canonical-JSON digest and content digest."""
    digest = S.stable_digest(24, source=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id"))
    return t.documents.select("doc_id", digest.alias("digest"), S.text_digest(F.col("text"), 20).alias("content"))


@query(
    "file_filter",
    rf"""WITH p AS (SELECT page_id, trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.png' WHEN 2 THEN '.md' ELSE '.rs' END AS path FROM pages)
    SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 2 THEN 'text' ELSE 'rust' END AS language FROM p
    WHERE page_id % 4 <> 1 AND NOT starts_with(list_extract(string_split(path, '/'), -1), '.') AND NOT list_contains(string_split(path, '/'), '.git')
      AND len(list_filter(string_split(lower(path), '/'), lambda x: list_contains({sql_list(V.EXCLUDED_DIRS)}, x))) = 0
      AND NOT list_contains({sql_list(V.EXCLUDED_FILENAMES)}, lower(list_extract(string_split(path, '/'), -1)))""",
)
def file_filter(t: Tables):
    """FLT-01, STR-36: pages' paths, with an extension by id, that belong to a snapshot."""
    ext = F.element_at(F.array(*map(F.lit, (".py", ".png", ".md", ".rs"))), F.pmod("page_id", F.lit(4)).cast("int") + 1)
    df = t.pages.select("page_id", F.concat(F.btrim(T.url_path(F.col("url")), F.lit("/")), ext).alias("path"))
    return df.where(T.included_file(F.col("path"))).withColumn("language", T.language(F.col("path")))


@query(
    "snapshot_scan",
    f"""SELECT source, doc_id, n AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
    FROM documents WHERE strlen(text) <= {V.MAX_FILE_BYTES}) WHERE n <= {V.MAX_FILES}""",
)
def snapshot_scan(t: Tables):
    """SRC-02, SRT-13: the documents of each source within the reference's limits, size before place as there."""
    first = Window.partitionBy("source").orderBy("doc_id")
    df = t.documents.where(F.octet_length("text") <= V.MAX_FILE_BYTES).select("source", "doc_id", F.row_number().over(first).cast("long").alias("place"))
    return df.where(F.col("place") <= V.MAX_FILES)


@query("reference_markers", r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all('see Eq. ' || doc_id || ' and Table 2, figure ' || (doc_id % 3) || ' and Table 2', '(?i)\b(?:eq(?:uation)?\.?\s*\d+|algorithm\s*\d+|table\s*\d+|fig(?:ure)?\.?\s*\d+)\b'))) AS INTEGER) AS n FROM documents""")
def reference_markers(t: Tables):
    """STR-20: distinct references of a phrase made from each id."""
    x = F.concat(F.lit("see Eq. "), F.col("doc_id"), F.lit(" and Table 2, figure "), F.col("doc_id") % 3, F.lit(" and Table 2"))
    return t.documents.select("doc_id", F.size(T.references(x)).alias("n"))


@query("path_rollup", r"""WITH p AS (SELECT page_id, length(html) AS n, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)', 1), '/'), lambda p: p <> '') AS ps FROM pages),
    e AS (SELECT page_id, n, array_to_string(list_slice(ps, 1, k), '/') AS prefix FROM (SELECT page_id, n, ps, unnest(generate_series(1, len(ps) - 1)) AS k FROM p))
    SELECT prefix, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars FROM e GROUP BY prefix""")  # fmt: skip
def path_rollup(t: Tables):
    """AGG-12, CLI-03: pages and characters below each proper prefix of host and path."""
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)", 1)
    df = t.pages.select(F.explode(T.ancestors(path)).alias("prefix"), F.length("html").alias("n"))
    return df.groupBy("prefix").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


@query("owner_groups", """SELECT owner, page_id, row_number() OVER (PARTITION BY owner ORDER BY page_id) AS place, count(*) OVER (PARTITION BY owner) AS n
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS owner FROM pages)""")  # fmt: skip
def owner_groups(t: Tables):
    """AGG-13, AGG-08: pages by host, in order. The list of a host is rows with places, not one row that grows: all rows
    are numbered in one range-partitioned order, and a host's places count from its first."""
    from strandline.operators.ordering import numbered

    df = numbered(t.pages.select("page_id", F.lower(T.url_host(F.col("url"))).alias("owner")), [F.col("owner"), F.col("page_id")], "g")
    first = df.groupBy("owner").agg(F.min("g").alias("first"), F.count("*").alias("n"))
    return df.join(first, "owner").select("owner", "page_id", (F.col("g") - F.col("first") + 1).cast("long").alias("place"), "n")


@query("freq_topk", f"""WITH e AS (SELECT source, unnest({sql_tokens("text")}) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM e GROUP BY ALL)
    SELECT source, token, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS r FROM c) WHERE r <= 6""")
def freq_topk(t: Tables):
    """AGG-05: the six most frequent tokens of each source, ties by token."""
    df = t.documents.select("source", F.explode_outer(T.tokens(F.col("text"))).alias("token")).where("token is not null").groupBy("source", "token").agg(F.count("*").alias("n"))
    best = Window.partitionBy("source").orderBy(F.desc("n"), "token")
    return df.withColumn("r", F.row_number().over(best)).where("r <= 6").drop("r")


@query("large_file_mode", f"""SELECT doc_id, CASE WHEN lines > {V.LARGE_LINES} OR bytes > {V.LARGE_BYTES} THEN 'raw_diff_only' ELSE 'inline' END AS mode, lines, bytes
    FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(strlen(text) AS BIGINT) AS bytes FROM documents)""")  # fmt: skip
def large_file_mode(t: Tables):
    """REV-14: display mode by lines and bytes, with the reference's thresholds."""
    df = t.documents.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"))
    large = (F.col("lines") > V.LARGE_LINES) | (F.col("bytes") > V.LARGE_BYTES)
    return df.select("doc_id", F.when(large, "raw_diff_only").otherwise("inline").alias("mode"), "lines", "bytes")


@query("significance_queue", """SELECT doc_id, significance, lines, CAST(row_number() OVER (ORDER BY linked DESC, rank DESC, lines DESC, doc_id) AS BIGINT) AS place FROM (
    SELECT doc_id, lines, linked, CASE WHEN linked > 0 OR lines >= 50 THEN 'high' WHEN lines >= 10 THEN 'medium' ELSE 'low' END AS significance,
      CASE WHEN linked > 0 OR lines >= 50 THEN 3 WHEN lines >= 10 THEN 2 ELSE 1 END AS rank
    FROM (SELECT d.doc_id, len(string_split(text, chr(10))) AS lines, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS linked FROM documents d LEFT JOIN labels l USING (doc_id)))""")  # fmt: skip
def significance_queue(t: Tables):
    """MTH-16, SRT-03: the review queue of all documents, with its places. A total order is asked for: the rows
    are range-partitioned by the sort keys, and places are counted from the partitions' sizes."""
    from strandline.operators.ordering import numbered

    labels = t.labels.select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("linked"))
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    df = t.documents.select("doc_id", lines.alias("lines")).join(labels, "doc_id", "left").select("doc_id", "lines", F.coalesce("linked", F.lit(0)).alias("linked"))
    df = df.withColumn("significance", S.significance(F.col("lines"), F.col("linked")))
    df = df.withColumn("rank", S.significance_rank(F.col("significance")))
    order = [F.desc("linked"), F.desc("rank"), F.desc("lines"), F.asc("doc_id")]
    return numbered(df, order, "place").select("doc_id", "significance", "lines", "place")
