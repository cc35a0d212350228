"""Papers from LaTeX source and from page text, search queries and project pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import text as T

# Heading lines that open a section in page text.
PAGE_HEADINGS = (
    "abstract", "introduction", "related work", "background", "method", "methods", "approach", "experiments", "results",
    "evaluation", "discussion", "conclusion", "conclusions", "references", "appendix", "contributions",
)
# Priority of sections for a bounded reading, by heading marker.
SECTION_PRIORITY = (
    ("contribution", 7), ("abstract", 6), ("method", 5), ("approach", 5), ("introduction", 4), ("experiment", 3), ("appendix", 2),
)


def latex_parts(sources: DataFrame) -> DataFrame:
    """STR-27, STR-28: title, abstract, authors (ten at most) and sections of LaTeX source (job, tex, meta_title,
    meta_abstract); the source's own values win over the metadata's."""
    tex = F.regexp_replace("tex", r"(?m)(?<!\\)%.*$", "")
    raw_authors = F.split(F.regexp_extract(tex, r"(?s)\\author\{((?:[^{}]|\{[^{}]*\})*)\}", 1), r"\\and|,|\\\\")
    authors = F.slice(F.filter(F.transform(raw_authors, T.strip_latex), lambda a: F.length(a) >= 3), 1, 10)
    heads = F.regexp_extract_all(tex, F.lit(r"\\section\*?\{([^}]*)\}"), F.lit(1))
    bodies = F.slice(F.split(tex, r"\\section\*?\{[^}]*\}", -1), F.lit(2), F.greatest(F.size(heads), F.lit(1)))
    sections = F.when(F.size(heads) > 0, F.zip_with(heads, bodies, lambda h, b: F.struct(T.strip_latex(h).alias("heading"), F.left(T.strip_latex(b), F.lit(5000)).alias("text"))))
    links = F.array_distinct(F.regexp_extract_all(tex, F.lit(V.REPO_URL), F.lit(0)))
    links = F.when(F.size(links) > 0, F.array(F.struct(F.lit("Links").alias("heading"), F.array_join(links, "\n").alias("text"))))
    none = F.array().cast("array<struct<heading:string,text:string>>")

    def own(pattern: str) -> Column:
        return F.nullif(T.strip_latex(F.regexp_extract(tex, pattern, 1)), F.lit(""))

    return sources.select(
        "job",
        F.coalesce(own(r"(?s)\\title\{((?:[^{}]|\{[^{}]*\})*)\}"), "meta_title").alias("title"),
        F.coalesce(own(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"), "meta_abstract").alias("abstract"),
        authors.alias("authors"),
        F.concat(F.coalesce(links, none), F.coalesce(sections, none)).alias("sections"),
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """STR-29, STR-30, STR-31, WIN-12: sections of page texts (job, page, text). A heading line opens one; a running
    count of headings numbers the lines; text before the first heading is a section of its own."""
    lines = pages.select("job", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    lines = lines.where("line <> ''")
    head = (F.length("line") <= 80) & T.heading(F.col("line")).isin(*PAGE_HEADINGS)
    w = Window.partitionBy("job").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_head", head).withColumn("section", F.sum(F.col("is_head").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("page", "pos", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy("job", "section").agg(F.max(F.when(F.col("is_head"), F.col("line"))).alias("heading"), body.alias("text"))


def page_title(pages: DataFrame) -> DataFrame:
    """STR-29: the first line of 12 characters or more of each job's first page."""
    first = pages.groupBy("job").agg(F.min_by("text", "page").alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda s: F.length(s) >= 12)
    return first.select("job", F.left(F.get(lines, F.lit(0)), F.lit(200)).alias("title"))


def section_priority(heading: Column) -> Column:
    """MTH-18."""
    return T.first_marker(T.heading(heading), [(v, (m,)) for m, v in SECTION_PRIORITY], 1)


def reading_plan(sections: DataFrame) -> DataFrame:
    """WIN-07, MTH-18: which sections (job, ord, heading, text) fit the reading budget, by priority."""
    from strandline.operators.folds import running_budget

    df = sections.withColumn("at", F.struct((-section_priority(F.col("heading"))).alias("p"), "ord"))
    return running_budget(df, "job", "at", "text", V.PARSE_SECTIONS, V.PARSE_SECTION_CHARS, V.PARSE_TOTAL_CHARS, V.PARSE_LEAST)


def topic_queries(title: Column, topics: Column) -> Column:
    """STR-40: the first five topical words of title and topics, four distinct queries."""
    def words(x):
        found = F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9][a-z0-9-]+"), F.lit(0)), lambda t: ~t.isin(*V.TOPIC_STOPWORDS))
        return F.array_join(F.slice(F.array_distinct(found), 1, 5), " ")

    made = F.transform(F.concat(F.array(title), topics), words)
    return F.slice(F.array_distinct(F.filter(made, lambda q: q != "")), 1, 4)


def author_queries(authors: Column, topic: Column) -> Column:
    """STR-39, STR-40: each surname with the topic."""
    return F.transform(T.surnames(authors), lambda s: F.concat_ws(" ", s, topic))


def signature_queries(files: DataFrame) -> DataFrame:
    """STR-41: the first four telling definition names of each job's files (job, path, text)."""
    generic = ("train", "forward", "main", "setup", "run", "build", "load", "save", "evaluate")  # fixed values
    df = files.select("job", "path", F.posexplode(T.symbols(F.col("text"))).alias("pos", "name"))
    df = df.where((F.length("name") >= 8) & ~F.lower("name").isin(*generic))
    df = df.groupBy("job", "name").agg(F.min(F.struct("path", "pos")).alias("at"))
    w = Window.partitionBy("job").orderBy("at")
    return df.withColumn("place", F.row_number().over(w)).where("place <= 4").select("job", "place", "name")


def project_page_scores(pages: DataFrame) -> DataFrame:
    """MTH-15: how well a page (job, page_url, html, repo_url, title) speaks for a repository it links to: code words
    near the link (160 characters on each side), a named website, and tokens shared with page path and title."""
    low = F.lower("html")
    at = F.position(F.lower("repo_url"), low)
    near = F.substring(low, F.greatest(at - 160, F.lit(1)), F.length("repo_url") + 320)
    repo = T.identifier_words(F.regexp_replace("repo_url", "^https?://[^/]+/", ""))
    score = (
        6 * T.any_contains(near, ("code", "github", "implementation", "source")).cast("int")
        + 2 * T.any_contains(near, ("project page", "website", "homepage")).cast("int")
        + 2 * F.size(F.array_intersect(T.identifier_words(T.url_path(F.col("page_url"))), repo))
        + F.size(F.array_intersect(T.identifier_words(F.col("title")), repo))
    )
    return pages.withColumn("score", F.when(at > 0, score).otherwise(0))


def project_pages(x: Column) -> Column:
    """STR-08: addresses that may be project pages: no code host, no preprint server, no PDF."""
    hosts = ("github.com", "www.github.com", "arxiv.org", "www.arxiv.org")  # fixed values
    return F.filter(T.urls(x), lambda u: ~F.lower(T.url_host(u)).isin(*hosts) & ~F.endswith(F.lower(u), F.lit(".pdf")))


def gap_warnings(papers: DataFrame) -> DataFrame:
    """AGG-16: what is missing from a parsed paper (job, abstract, n_sections, n_contributions, kinds)."""
    checks = (
        (F.coalesce("abstract", F.lit("")) == "", "no abstract"),
        (F.col("n_sections") == 0, "no sections"),
        (~F.array_contains("kinds", "method"), "no method section"),
        (~F.array_contains("kinds", "contributions"), "no contributions section"),
        (F.col("n_contributions") == 0, "no contributions"),
    )
    found = F.array(*(F.when(c, F.lit(m)) for c, m in checks))
    return papers.withColumn("warnings", F.filter(found, lambda w: w.isNotNull()))
