"""Queries on papers: sources, sections, findings, contributions, queries and replies, made from the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import candidates, contributions, papers, reviews
from strandline.plans.more import _from_marker_sql
from strandline.plans.registry import Tables, query
from strandline.plans.texts import SQL_SENTENCES, SQL_STRIP, sql_any, sql_count, sql_first, sql_list, sql_tokens

# Known cases by slug, with the names that a request may use.
CASES = (("alpha", ("en-guide", "alpha")), ("beta", ("arxiv: 2305", "beta")))
SOURCE_SQL = """CASE doc_id % 7 WHEN 0 THEN ' https://arxiv.org/abs/2401.0' || (doc_id % 10000 + 1000) || 'v2 ' WHEN 1 THEN 'arXiv: 2305.' || (doc_id % 90000 + 10000) WHEN 2 THEN 'HTTPS://x.org/' || lang || '.pdf?dl=1'
  WHEN 3 THEN 'papers/' || source || ' (' || doc_id || ').PDF' WHEN 4 THEN 'file://tmp/' || doc_id WHEN 5 THEN lang || '-guide ' || text ELSE '. ' || lang || '/' END"""


@query(
    "paper_source_kind",
    rf"""WITH s AS (SELECT doc_id, {SOURCE_SQL} AS raw FROM documents), i AS (SELECT doc_id, raw, trim(raw) AS s, nullif(regexp_extract(trim(raw), '(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*)(\d{{4}}\.\d{{4,5}})', 1), '') AS paper_id FROM s),
    n AS (SELECT *, trim(regexp_replace(raw, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') AS safe, lower(regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme FROM i)
    SELECT doc_id, paper_id, CASE WHEN paper_id IS NOT NULL THEN 'arxiv' WHEN regexp_matches(lower(s), '^https?://.*\.pdf') THEN 'pdf_url' WHEN ends_with(lower(s), '.pdf') THEN 'pdf_file' ELSE 'text_reference' END AS kind,
      CASE WHEN safe = '' THEN 'upload' ELSE safe END AS safe_name, scheme IN ('', 'file') AS is_local, {sql_first("lower(s)", CASES, "NULL")} AS case_slug, left(sha256(s), 16) AS mirror,
      CAST(CASE WHEN CAST(substr(paper_id, 3, 2) AS INTEGER) BETWEEN 1 AND 12 THEN make_date(2000 + CAST(left(paper_id, 2) AS INTEGER), CAST(substr(paper_id, 3, 2) AS INTEGER), 1) END AS VARCHAR) AS month FROM n""",
)
def paper_source_kind(t: Tables):
    """STR-01, STR-02, STR-03, STR-48, STR-49, FLT-13, SRC-07, SRC-14, SRC-23, DAT-01: what kind of source a request names."""
    n = F.col("doc_id")
    raw = (
        F.when(n % 7 == 0, F.concat(F.lit(" https://arxiv.org/abs/2401.0"), n % 10000 + 1000, F.lit("v2 ")))
        .when(n % 7 == 1, F.concat(F.lit("arXiv: 2305."), n % 90000 + 10000))
        .when(n % 7 == 2, F.concat(F.lit("HTTPS://x.org/"), "lang", F.lit(".pdf?dl=1")))
        .when(n % 7 == 3, F.concat(F.lit("papers/"), "source", F.lit(" ("), n, F.lit(").PDF")))
        .when(n % 7 == 4, F.concat(F.lit("file://tmp/"), n))
        .when(n % 7 == 5, F.concat("lang", F.lit("-guide "), "text"))
        .otherwise(F.concat(F.lit(". "), "lang", F.lit("/")))
    )
    from strandline.sources.readers import mirror_key

    df = t.documents.select("doc_id", raw.alias("raw"), F.btrim(raw).alias("s"))
    s = F.col("s")
    return df.select(
        "doc_id", T.paper_id(s).alias("paper_id"), T.paper_kind(s).alias("kind"), T.safe_name(F.col("raw")).alias("safe_name"), T.is_local(s).alias("is_local"),
        T.case_slug(s, CASES).alias("case_slug"), mirror_key(s).alias("mirror"), S.month_of_id(T.paper_id(s)).cast("string").alias("month"),
    )


PAGE_SQL = "CASE turn % 4 WHEN 0 THEN '1 Introduction' || chr(10) WHEN 1 THEN '  2.1  Related   Work ' || chr(10) WHEN 2 THEN 'Method' || chr(10) || 'CONCLUSIONS' || chr(10) ELSE '' END || text"
HEAD_SQL = r"regexp_replace(regexp_replace(lower(line), '^\d+(?:\.\d+)*\s+', ''), '\s+', ' ', 'g')"


@query(
    "page_sections",
    f"""WITH p AS (SELECT conv_id AS job, turn, string_split({PAGE_SQL}, chr(10)) AS ls FROM conversations),
    l AS (SELECT job, turn, unnest(generate_series(1, len(ls))) AS pos, {SQL_STRIP.format("unnest(ls)")} AS line FROM p),
    h AS (SELECT *, length(line) <= 80 AND list_contains({sql_list(papers.PAGE_HEADINGS)}, {HEAD_SQL}) AS is_head FROM l WHERE line <> ''),
    s AS (SELECT *, CAST(sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY job ORDER BY turn, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM h)
    SELECT job, section, max(CASE WHEN is_head THEN line END) AS heading, md5(coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY turn, pos), '')) AS text_md5,
      CAST({sql_first("lower(coalesce(max(CASE WHEN is_head THEN line END), ''))", [(v, (m,)) for m, v in papers.SECTION_PRIORITY], "1")} AS INTEGER) AS priority FROM s GROUP BY job, section""",
)
def page_sections(t: Tables):
    """STR-29, STR-30, STR-31, WIN-12, MTH-18: sections of page texts, with their priority; a conversation is a paper."""
    k = F.col("turn") % 4
    head = F.when(k == 0, "1 Introduction\n").when(k == 1, "  2.1  Related   Work \n").when(k == 2, "Method\nCONCLUSIONS\n").otherwise("")
    df = papers.page_sections(t.conversations.select(F.col("conv_id").alias("job"), F.col("turn").alias("page"), F.concat(head, "text").alias("text")))
    priority = papers.section_priority(F.coalesce("heading", F.lit(""))).cast("int")
    return df.select("job", "section", "heading", F.md5(F.col("text").cast("binary")).alias("text_md5"), priority.alias("priority"))


@query(
    "page_title",
    f"""WITH p AS (SELECT conv_id AS job, arg_min(text, turn) AS x FROM conversations GROUP BY conv_id)
    SELECT job, left(list_filter(list_transform(string_split(x, chr(10)), lambda s: {SQL_STRIP.format("s")}), lambda s: length(s) >= 12)[1], 200) AS title FROM p""",
)
def page_title(t: Tables):
    """STR-29: the title of each paper's first page."""
    return papers.page_title(t.conversations.select(F.col("conv_id").alias("job"), F.col("turn").alias("page"), "text"))


FOUND_SQL = "'We propose an efficient adapter module for training with a frozen encoder instead of a full loss, see Table ' || (doc_id % 5) || ' and Eq. 3.' || chr(10) || '- a second objective without attention, kernel or routing at all' || chr(10) || text"
HEADS = ("1 Abstract", "Our Contributions", "3.2 Methods", "Experiments", "Related work")
_ITEMS = r"list_filter(list_transform(regexp_extract_all(text, '(?m)^\s*(?:[-*•]|(?:\(?\d+[\.\)])|(?:\(?[a-zA-Z][\.\)]))\s+(.+)$', 1), lambda s: " + SQL_STRIP.format("s") + "), lambda s: length(s) >= 25)"
_TITLE = (
    f"left(array_to_string(list_slice(list_filter(string_split_regex(rtrim(regexp_replace(s, '{V.LEADING_PHRASE}', ''), '.'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), 1, 8), ' '), 120)"
)
FINDINGS_SQL = f"""WITH d AS (SELECT doc_id, {FOUND_SQL} AS text, {sql_list(HEADS)}[doc_id % 5 + 1] AS h FROM documents),
  k AS (SELECT doc_id, {sql_first("lower(h)", V.SECTION_KINDS, "'other'")} AS kind, {sql_first("lower(h)", [(v, (m,)) for m, v in V.HEADING_BOOSTS], "0")} AS boost, text FROM d),
  p AS (SELECT doc_id, kind, boost, list_concat({_ITEMS}, {SQL_SENTENCES}) AS ps FROM k WHERE kind IN ('contributions', 'method', 'abstract')),
  e AS (SELECT doc_id, kind, boost, unnest(ps) AS s, unnest(generate_series(1, len(ps))) AS pos FROM p), u AS (SELECT doc_id, kind, boost, s, min(pos) AS pos FROM e GROUP BY ALL),
  f AS (SELECT *, CAST(3 * {sql_count("lower(s)", V.CONTRIBUTION_MARKERS)} + {sql_count("lower(s)", V.TECHNICAL_MARKERS)} + least(len({sql_tokens("s")}) // 6, 3) + boost AS INTEGER) AS score FROM u)"""


def _findings(t: Tables):
    n = F.col("doc_id")
    text = F.concat(
        F.lit("We propose an efficient adapter module for training with a frozen encoder instead of a full loss, see Table "), n % 5,
        F.lit(" and Eq. 3.\n- a second objective without attention, kernel or routing at all\n"), "text",
    )
    head = F.element_at(F.array(*map(F.lit, HEADS)), F.pmod(n, F.lit(5)).cast("int") + 1)
    sections = t.documents.select(n.alias("job"), F.lit(0).alias("ord"), head.alias("heading"), text.alias("text"))
    return contributions.findings(sections, ("contributions", "method", "abstract"))


@query("section_findings", f"{FINDINGS_SQL} SELECT doc_id AS job, kind, count(*) AS n, CAST(max(score) AS INTEGER) AS best, CAST(sum(score) AS BIGINT) AS total, md5(string_agg(s, chr(1) ORDER BY pos)) AS snippets_md5 FROM f GROUP BY doc_id, kind")
def section_findings(t: Tables):
    """CTR-03, FLT-16: findings of the sections of three kinds, with their scores."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda x: x["snippet"]), "\x01")
    return _findings(t).groupBy("job", "kind").agg(F.count("*").alias("n"), F.max("score").cast("int").alias("best"), F.sum("score").cast("long").alias("total"), F.md5(text.cast("binary")).alias("snippets_md5"))


_REFS = r"list_distinct(regexp_extract_all(s, '(?i)\b(?:eq(?:uation)?\.?\s*\d+|algorithm\s*\d+|table\s*\d+|fig(?:ure)?\.?\s*\d+)\b'))"


@query(
    "finding_contributions",
    f"""{FINDINGS_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(s) DESC, pos) AS INTEGER) AS place FROM f WHERE score >= 5)
    SELECT doc_id AS job, place, {_TITLE} AS title, {_from_marker_sql("s", V.PROBLEM_MARKERS, 160)} AS problem_solved, {_from_marker_sql("s", V.DIFFERENCE_MARKERS, 180)} AS baseline_difference,
      array_to_string(list_sort({_REFS}), ',') AS refs, array_to_string(list_sort({sql_tokens("s")}), ' ') AS keywords,
      CAST(least(5, 2 + CASE WHEN len({sql_tokens("s")}) >= 12 THEN 1 ELSE 0 END + CASE WHEN len({_REFS}) > 0 THEN 1 ELSE 0 END + CASE WHEN {sql_any("lower(s)", ("kernel", "optimizer", "training", "loss"))} THEN 1 ELSE 0 END) AS INTEGER) AS complexity
    FROM r WHERE place <= 5""",
)
def finding_contributions(t: Tables):
    """CTR-04, SRT-04, MTH-08, STR-21, STR-22, STR-20: the best findings of each paper as contributions."""
    df = contributions.from_findings(_findings(t))
    return df.select(
        "job", "place", "title", "problem_solved", "baseline_difference", F.array_join(F.array_sort("evidence_refs"), ",").alias("refs"),
        F.array_join(F.array_sort("keywords"), " ").alias("keywords"), F.col("complexity").cast("int").alias("complexity"),
    )


TRIGGER_SQL = "CASE doc_id % 5 WHEN 0 THEN 'with a low-rank adapter' WHEN 1 THEN 'Freeze the pretrained weights' WHEN 2 THEN 'a reward model from preference data' WHEN 3 THEN 'Tiling makes an attention kernel IO-aware' ELSE '' END"


def _signature_sql() -> str:
    out = []
    for cid, title, keywords, triggers in V.SIGNATURES:
        found = "list_filter([" + ", ".join(f"CASE WHEN contains(x, '{t}') THEN '{t}' END" for t in triggers) + "], lambda q: q IS NOT NULL)"
        out.append(f"SELECT job, '{cid}' AS id, '{title}' AS title, {sql_list(keywords)} AS ks, {found} AS fs FROM p")
    # The first four distinct words: keywords, then triggers that are no keywords, in order.
    extra = "list_filter(fs, lambda q: NOT list_contains(ks, q))"
    return f"SELECT job, id, title, array_to_string(list_slice(list_concat(ks, {extra}), 1, 4), ',') AS keywords FROM (" + " UNION ALL ".join(out) + ") WHERE len(fs) > 0"


@query("signature_contributions", f"WITH p AS (SELECT doc_id AS job, lower(source || chr(10) || text || ' ' || {TRIGGER_SQL}) AS x FROM documents) {_signature_sql()}")
def signature_contributions(t: Tables):
    """CTR-01: known contributions whose triggers a paper holds."""
    n = F.col("doc_id")
    tail = F.when(n % 5 == 0, "with a low-rank adapter").when(n % 5 == 1, "Freeze the pretrained weights").when(n % 5 == 2, "a reward model from preference data").when(n % 5 == 3, "Tiling makes an attention kernel IO-aware").otherwise("")
    df = contributions.by_signature(t.documents.select(n.alias("job"), F.col("source").alias("title"), F.concat("text", F.lit(" "), tail).alias("text")))
    return df.select("job", "id", "title", F.array_join("keywords", ",").alias("keywords"))


def _words_sql(x: str) -> str:
    return f"array_to_string(list_slice(list_filter(list_transform(list_sort(list_transform(list_distinct(list_transform(ws, lambda w: w)), lambda w: {{'p': list_position(ws, w), 'w': w}})), lambda z: z.w), lambda w: true), 1, 5), ' ')".replace("ws", x)


@query(
    "search_queries",
    f"""WITH b AS (SELECT item_id, text, ['on fast ' || (item_id % 7) || '-bit attention', text, 'the model'] AS topics, ['Ann Lee-' || chr(CAST(65 + item_id % 26 AS INTEGER)), 'Bo O''Neil Jr', 'X', '  Cy Lee-A '] AS authors FROM benchmark),
    q AS (SELECT item_id, authors, list_transform(list_concat([text], topics), lambda x: list_filter(regexp_extract_all(lower(x), '[a-z0-9][a-z0-9-]+'), lambda w: NOT list_contains({sql_list(V.TOPIC_STOPWORDS)}, w))) AS wss FROM b),
    m AS (SELECT item_id, authors, list_filter(list_transform(wss, lambda ws: {_words_sql("ws")}), lambda s: s <> '') AS made FROM q),
    u AS (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(made), lambda s: {{'p': list_position(made, s), 's': s}})), lambda z: z.s) AS qs,
      list_filter(list_transform(authors, lambda a: lower(regexp_replace(string_split(trim(a), ' ')[-1], '[^A-Za-z''-]', '', 'g'))), lambda s: length(s) >= 2 AND NOT list_contains({sql_list(V.SURNAME_SUFFIXES)}, s)) AS names FROM m),
    n AS (SELECT item_id, list_slice(qs, 1, 4) AS qs, list_slice(list_transform(list_sort(list_transform(list_distinct(names), lambda s: {{'p': list_position(names, s), 's': s}})), lambda z: z.s), 1, 4) AS names FROM u)
    SELECT item_id, array_to_string(qs, '|') AS topic_queries, array_to_string(list_transform(names, lambda s: s || ' ' || qs[1]), '|') AS author_queries FROM n""",
)
def search_queries(t: Tables):
    """STR-39, STR-40: queries from the topical words of title and topics, and from the authors' surnames."""
    n = F.col("item_id")
    topics = F.array(F.concat(F.lit("on fast "), n % 7, F.lit("-bit attention")), F.col("text"), F.lit("the model"))
    authors = F.array(F.concat(F.lit("Ann Lee-"), F.char((65 + n % 26).cast("long"))), F.lit("Bo O'Neil Jr"), F.lit("X"), F.lit("  Cy Lee-A "))
    df = t.benchmark.select("item_id", papers.topic_queries(F.col("text"), topics).alias("q"), authors.alias("a"))
    return df.select("item_id", F.array_join("q", "|").alias("topic_queries"), F.array_join(papers.author_queries(F.col("a"), F.get("q", F.lit(0))), "|").alias("author_queries"))


PY_SQL = "'import os.path' || chr(10) || 'from lib.m' || (p_size % 9) || ' import x' || chr(10) || 'class ' || upper(p_name[1]) || 'Model' || (p_partkey % 50) || '(base.Layer' || (p_size % 7) || '[int], Mixin):' || chr(10) || '  def compute_' || (p_size % 11) || '(self): pass' || chr(10) || 'def train(): pass'"
PY_PATH = "'src/' || replace(p_name, ' ', '_') || '/Part' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.cu' WHEN 2 THEN '' ELSE '.RS' END"


def code_files(t: Tables):
    """Files of code made of all parts: job (the brand), path, text."""
    z, k = F.col("p_size"), F.col("p_partkey")
    text = F.concat(
        F.lit("import os.path\nfrom lib.m"), z % 9, F.lit(" import x\nclass "), F.upper(F.left("p_name", F.lit(1))), F.lit("Model"), k % 50, F.lit("(base.Layer"), z % 7,
        F.lit("[int], Mixin):\n  def compute_"), z % 11, F.lit("(self): pass\ndef train(): pass"),
    )
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/Part"), k, F.when(z % 4 == 0, ".py").when(z % 4 == 1, ".cu").when(z % 4 == 2, "").otherwise(".RS"))
    return t.part.select(F.col("p_brand").alias("job"), path.alias("path"), text.alias("text"), "p_partkey")


@query(
    "code_symbols",
    rf"""WITH f AS (SELECT p_partkey, {PY_PATH} AS path, {PY_SQL} AS x FROM part),
    s AS (SELECT *, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext, list_distinct(regexp_extract_all(x, '\b(?:from|import)\s+([A-Za-z_][A-Za-z0-9_\.]*)', 1)) AS mods FROM f)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1))), ',') AS symbols,
      array_to_string(list_sort(mods), ',') AS imports, array_to_string(flatten(list_transform(list_sort(mods), lambda m: [replace(m, '.', '/') || '.py', replace(m, '.', '/') || '/__init__.py'])), ',') AS import_paths,
      'Layer' || regexp_extract(x, 'base\.Layer(\d)', 1) || ',Mixin' AS base_classes,
      array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(lower(path), '/'), lambda p: length(p) >= 3), list_filter([regexp_replace(lower(string_split(path, '/')[-1]), '\.[^.]*$', ''), ext], lambda p: length(p) >= 3)))), ',') AS signature,
      CASE ext WHEN '' THEN 'unknown' WHEN '.py' THEN 'python' WHEN '.cu' THEN 'cuda' ELSE 'rust' END AS language FROM s""",
)
def code_symbols(t: Tables):
    """STR-32, STR-33, STR-34, STR-36, FLT-11: names, imports and bases of code, paths of imported modules, language."""
    x, path = F.col("text"), F.col("path")
    return code_files(t).select(
        "p_partkey", F.array_join(F.array_sort(T.symbols(x)), ",").alias("symbols"), F.array_join(F.array_sort(T.imports(x)), ",").alias("imports"),
        F.array_join(T.import_paths(T.imports(x)), ",").alias("import_paths"), F.array_join(T.base_classes(x), ",").alias("base_classes"),
        F.array_join(F.array_sort(T.signature_tokens(path)), ",").alias("signature"), T.language(path).alias("language"),
    )


@query(
    "signature_queries",
    rf"""WITH f AS (SELECT p_brand AS job, {PY_PATH} AS path, regexp_extract_all({PY_SQL}, '\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS ns FROM part),
    e AS (SELECT job, path, unnest(ns) AS name, unnest(generate_series(1, len(ns))) AS pos FROM f), g AS (SELECT job, name, min((path, pos)) AS spot FROM e WHERE length(name) >= 8 GROUP BY ALL)
    SELECT job, place, name FROM (SELECT job, name, CAST(row_number() OVER (PARTITION BY job ORDER BY spot) AS INTEGER) AS place FROM g) WHERE place <= 4""",
)
def signature_queries(t: Tables):
    """STR-41: the first telling definitions of each job's files."""
    return papers.signature_queries(code_files(t)).select("job", "place", "name")


@query(
    "context_summary",
    rf"""WITH f AS (SELECT p_brand AS job, {PY_PATH} AS path, {PY_SQL} AS x FROM part),
    v AS (SELECT job, 'd' AS k, split_part(path, '/', 1) AS v FROM f UNION ALL SELECT job, 'i', unnest(list_distinct(regexp_extract_all(x, '\b(?:from|import)\s+([A-Za-z_][A-Za-z0-9_\.]*)', 1))) FROM f),
    n AS (SELECT job, k, v, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job, k ORDER BY n DESC, v) AS r FROM n),
    l AS (SELECT job, string_agg(v || ' (' || n || ')', ', ' ORDER BY r) FILTER (WHERE k = 'd') AS d, string_agg(v || ' (' || n || ')', ', ' ORDER BY r) FILTER (WHERE k = 'i') AS i FROM r WHERE r <= 10 GROUP BY job)
    SELECT job AS repo_url, 'folders: ' || d || chr(10) || 'imports: ' || i AS summary FROM l""",
)
def context_summary(t: Tables):
    """STR-51, AGG-05: most frequent folders and imports of each repository."""
    return reviews.context_summary(code_files(t).withColumnRenamed("job", "repo_url")).select("repo_url", "summary")


LINK_SQL = "'<p>Our ' || CASE page_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'project page' ELSE 'thing' END || ': <a href=\"https://github.com/Own/' || CASE page_id % 2 WHEN 0 THEN 'fr-blog' ELSE 'x' END || '\">here</a>'"


@query(
    "project_page_score",
    rf"""WITH p AS (SELECT page_id, url, lower(CASE WHEN page_id % 5 = 4 THEN html ELSE html || {LINK_SQL} END) AS low, 'https://github.com/Own/' || CASE page_id % 2 WHEN 0 THEN 'fr-blog' ELSE 'x' END AS repo FROM pages),
    a AS (SELECT *, strpos(low, lower(repo)) AS spot FROM p), n AS (SELECT *, substr(low, greatest(spot - 160, 1), length(repo) + 320) AS near,
      list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(repo, '^https?://[^/]+/', '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS rw,
      list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS pw FROM a)
    SELECT page_id, CAST(CASE WHEN spot > 0 THEN 6 * CAST({sql_any("near", ("code", "github", "implementation", "source"))} AS INTEGER) + 2 * CAST({sql_any("near", ("project page", "website", "homepage"))} AS INTEGER)
      + 2 * len(list_intersect(pw, rw)) + len(list_intersect(['own', 'news'], rw)) ELSE 0 END AS INTEGER) AS score FROM n""",
)
def project_page_score(t: Tables):
    """MTH-15, STR-08: how well a page speaks for the repository it links to."""
    n = F.col("page_id")
    repo = F.concat(F.lit("https://github.com/Own/"), F.when(n % 2 == 0, "fr-blog").otherwise("x"))
    link = F.concat(F.lit("<p>Our "), F.when(n % 3 == 0, "code").when(n % 3 == 1, "project page").otherwise("thing"), F.lit(': <a href="'), repo, F.lit('">here</a>'))
    pages = t.pages.select("page_id", F.col("url").alias("page_url"), F.when(n % 5 == 4, F.col("html")).otherwise(F.concat("html", link)).alias("html"), repo.alias("repo_url"), F.lit("Own news").alias("title"))
    return papers.project_page_scores(pages).select("page_id", F.col("score").cast("int").alias("score"))


@query(
    "stage_warnings",
    """WITH k AS (SELECT doc_id AS job, lang, n_chars, doc_id % 3 AS n FROM documents),
    p AS (SELECT job, list_filter([CASE WHEN lang = 'fr' THEN 'no abstract' END, CASE WHEN n = 0 THEN 'no sections' END, CASE WHEN lang <> 'en' THEN 'no method section' END, CASE WHEN n_chars > 1000 THEN 'no contributions section' END, CASE WHEN n = 1 THEN 'no contributions' END], lambda x: x IS NOT NULL) AS w,
      CASE WHEN n = 2 THEN ['no method section', 'late'] ELSE ['late'] END AS v FROM k)
    SELECT job, array_to_string(list_concat(w, list_filter(v, lambda x: NOT list_contains(w, x))), '|') AS warnings FROM p""",
)
def stage_warnings(t: Tables):
    """AGG-16, AGG-14, UDF-02: what is missing from a paper, and the distinct warnings of two stages in order."""
    n = F.col("doc_id") % 3
    kinds = F.array(F.when(F.col("lang") == "en", "method").otherwise("other"), F.when(F.col("n_chars") > 1000, "other").otherwise("contributions"))
    papers_ = t.documents.select(
        F.col("doc_id").alias("job"), F.when(F.col("lang") == "fr", "").otherwise("x").alias("abstract"), F.when(n == 0, 0).otherwise(2).alias("n_sections"),
        F.when(n == 1, 0).otherwise(1).alias("n_contributions"), kinds.alias("kinds"), F.when(n == 2, F.array(F.lit("no method section"), F.lit("late"))).otherwise(F.array(F.lit("late"), F.lit("late"))).alias("more"),
    )
    first = papers.gap_warnings(papers_).select("job", "warnings")
    df = reviews.all_warnings(first, papers_.select("job", F.col("more").alias("warnings")))
    return df.select("job", F.array_join("warnings", "|").alias("warnings"))


@query(
    "model_replies",
    """WITH k AS (SELECT doc_id, doc_id % 5 AS k FROM documents)
    SELECT doc_id AS job, CAST(o AS INTEGER) AS ord, CASE o WHEN 0 THEN 'T ' || doc_id ELSE 'More' END AS title, CASE WHEN o = 0 THEN 'a,b' ELSE '' END AS keywords,
      CAST(CASE WHEN o = 0 THEN least(5, greatest(1, doc_id % 9)) ELSE 2 END AS INTEGER) AS complexity, CASE WHEN o = 0 THEN least(0.99e0, (doc_id % 13) / 10e0) ELSE 0.45e0 END AS confidence,
      CASE WHEN o = 0 THEN 'https://github.com/A/b' END AS repo_url
    FROM k JOIN (SELECT unnest([0, 2]) AS o) ON o = 0 OR k < 3 WHERE k <> 4""",
)
def model_replies(t: Tables):
    """JSN-03, STR-46, CND-15, UDF-04: contributions from landed model replies, fenced, bare or useless; items without a
    title go."""
    n = F.col("doc_id")
    one = F.concat(F.lit('{"title": "T '), n, F.lit('", "keywords": ["a", "b"], "implementation_complexity": '), n % 9, F.lit(', "confidence": '), (n % 13) / 10.0, F.lit(', "repo_url": "https://GITHUB.com/A/b.git"}'))
    many = F.concat(F.lit("["), one, F.lit(', {"title": " "}, {"title": "More", "confidence": "x"}]'))
    reply = F.when(n % 5 == 0, F.concat(F.lit("Sure:\n```json\n"), many, F.lit("\n```"))).when(n % 5 < 3, many).when(n % 5 == 3, F.concat(F.lit("["), one, F.lit("] done"))).otherwise("nothing")
    df = reviews.coerce_contribution(t.documents.select(n.alias("job"), reply.alias("payload")))
    return df.select("job", F.col("ord").cast("int").alias("ord"), "title", F.array_join("keywords", ",").alias("keywords"), F.col("complexity").cast("int").alias("complexity"), "confidence", "repo_url")


@query(
    "target_repository",
    """SELECT doc_id AS job, CASE doc_id % 7 WHEN 0 THEN 'e' || doc_id WHEN 1 THEN 'p' WHEN 2 THEN 'g' WHEN 3 THEN 's' WHEN 4 THEN 'c' WHEN 5 THEN 'h' END AS target_url FROM documents""",
)
def target_repository(t: Tables):
    """JON-13: the first named address of six sources; an empty one counts as missing."""
    k = F.col("doc_id") % 7
    names = ("explicit_url", "paper_url", "page_url", "suggested_url", "case_url", "searched_url")
    values = (F.concat(F.lit("e"), "doc_id"), F.lit("p"), F.lit("g"), F.lit("s"), F.lit("c"), F.lit("h"))
    columns = [F.when(k == i, v).when(k > i, "").otherwise(F.when(k < 6, f"later{i}")).alias(c) for i, (c, v) in enumerate(zip(names, values))]
    return candidates.target_repository(t.documents.select(F.col("doc_id").alias("job"), *columns)).select("job", "target_url")
