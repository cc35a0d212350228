"""Ancestry candidates: each strategy is a function of DataFrames that gives (job, repo_url, strategy, confidence,
evidence). Strategies are united, ranked by priority, and the best row of each repository stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import ranking

COLUMNS = ("job", "repo_url", "strategy", "confidence", "evidence")


def _out(df: DataFrame, strategy: str | Column, confidence, evidence) -> DataFrame:
    kind = F.lit(strategy) if isinstance(strategy, str) else strategy
    value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    said = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return df.select("job", "repo_url", kind.alias("strategy"), value.alias("confidence"), said.alias("evidence")).where("repo_url is not null")


def _aliases_in(text: Column) -> Column:
    """array<struct<repo_url, alias>> of the known aliases that a lower-cased text holds, in order of the table."""
    one = [F.when(T.has_alias(text, F.lit(a)), F.struct(F.lit(u).alias("repo_url"), F.lit(a).alias("alias"))) for a, u in V.UPSTREAM_ALIASES]
    return F.filter(F.array(*one), lambda x: x.isNotNull())


def _urls(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(V.REPO_URL), F.lit(0)), lambda u: T.repo_key(u, "github.com")), lambda u: u.isNotNull()))


def paper_mentions(papers: DataFrame) -> DataFrame:
    """CND-01, STR-06, STR-09: addresses in a paper's text (job, text), then owner/name aliases, then bare ones."""
    direct = _out(papers.select("job", F.explode(_urls(F.col("text"))).alias("repo_url")), "paper_mention", 0.9, "address in the text")
    named = papers.select("job", F.explode(_aliases_in(F.lower("text"))).alias("a")).select("job", "a.repo_url", "a.alias")
    confidence = F.when(F.contains("alias", F.lit("/")), 0.76).otherwise(0.7)
    return direct.unionByName(_out(named, "paper_mention", confidence, F.concat(F.lit("mentions "), "alias")))


def fork_parents(metadata: DataFrame) -> DataFrame:
    """CND-02: metadata has job and fork_parent."""
    return _out(metadata.select("job", T.repo_key(F.col("fork_parent"), "github.com").alias("repo_url")), "github_fork", 0.99, "fork parent")


def fossils(commits: DataFrame) -> DataFrame:
    """CND-03: addresses and aliases in the first commit's message (job, subject, files); more sure for a bulk import."""
    df = commits.withColumn("bulk", F.size("files") >= 8)
    direct = df.select("job", "bulk", F.explode(_urls(F.col("subject"))).alias("repo_url"))
    named = df.select("job", "bulk", F.explode(_aliases_in(F.lower("subject"))).alias("a")).select("job", "bulk", "a.repo_url")
    return _out(direct, "fossil_evidence", F.when(F.col("bulk"), 0.9).otherwise(0.84), "address in the first commit").unionByName(
        _out(named, "fossil_evidence", F.when(F.col("bulk"), 0.86).otherwise(0.8), "alias in the first commit")
    )


def frameworks(files: DataFrame) -> DataFrame:
    """CND-04: files (job, path, text) that use a framework's imports, base classes or folders. Signatures are a table
    of four rows in the plan, so it is one pass over the files and one sum for each job."""
    def hits(imports, bases, dirs) -> Column:
        text = F.col("text")
        n = F.lit(0)
        for word in imports:
            n = n + F.contains(text, F.lit(word)).cast("int")
        for word in bases:
            n = n + 2 * text.rlike(rf"class\s+\w+\([^)]*\b{word}\b").cast("int")
        for word in dirs:
            n = n + 2 * F.startswith(F.col("path"), F.lit(word)).cast("int")
        return n

    rows = F.array(*(F.struct(F.lit(u).alias("repo_url"), hits(i, b, d).alias("w")) for u, i, b, d in V.FRAMEWORKS))
    df = files.select("job", F.explode(rows).alias("r")).groupBy("job", F.col("r.repo_url").alias("repo_url")).agg(F.sum("r.w").alias("w")).where("w > 0")
    return _out(df, "framework_signature", S.clamp_linear(0.7, 0.04, F.col("w"), 0.97), F.concat(F.lit("signature weight "), "w"))


def metadata_urls(files: DataFrame) -> DataFrame:
    """CND-05, MTH-06: addresses in metadata files, by file."""
    name, confidence = F.lower("path"), None
    for path, value in V.METADATA_CONFIDENCE:
        confidence = F.when(name == path, value) if confidence is None else confidence.when(name == path, value)
    df = files.select("job", "path", confidence.otherwise(V.METADATA_DEFAULT).alias("c"), F.explode(_urls(F.col("text"))).alias("repo_url"))
    return _out(df, "metadata_url", F.col("c"), F.concat(F.lit("address in "), "path"))


def dependencies(files: DataFrame) -> DataFrame:
    """CND-06, JON-10: direct git addresses in requirement files; submodules; mapped names of what has no address."""
    req = files.where(F.lower("path").isin("requirements.txt", "requirements-dev.txt", "setup.py", "pyproject.toml"))
    direct = req.select("job", F.explode(_urls(F.col("text"))).alias("repo_url")).distinct()
    modules = files.where("path = '.gitmodules'").select("job", F.explode(_urls(F.col("text"))).alias("repo_url"))
    table = F.create_map(*(x for n, u in V.DEPENDENCY_REPOS for x in (F.lit(n), F.lit(u))))
    named = req.select("job", F.explode(T.dependency_names(F.col("text"))).alias("name")).select("job", F.try_element_at(table, F.col("name")).alias("repo_url"))
    named = named.where("repo_url is not null").distinct().join(direct, ["job", "repo_url"], "left_anti")
    kind = "dependency_archaeology"
    return _out(direct, kind, 0.93, "direct dependency").unionByName(_out(modules, kind, 0.91, "submodule")).unionByName(_out(named, kind, 0.79, "known dependency"))


def code_references(files: DataFrame) -> DataFrame:
    """CND-07: known aliases in a snapshot's files."""
    df = files.select("job", "path", F.explode(_aliases_in(F.lower(F.concat_ws("\n", "path", "text")))).alias("a"))
    df = df.groupBy("job", F.col("a.repo_url").alias("repo_url")).agg(F.min("path").alias("path"))
    return _out(df, "code_reference", 0.74, F.concat(F.lit("named in "), "path"))


def readmes(readme: DataFrame) -> DataFrame:
    """CND-08, FLT-04: addresses in a README (job, text); most sure where a line declares the base."""
    df = readme.select("job", "text", F.explode(_urls(F.col("text"))).alias("repo_url"))
    base = T.declares_base(F.col("text"), T.repo_aliases(F.col("repo_url")))
    follows = F.lower("text").rlike(r"\bbased on\b|\bbuilt on top of\b|\bfollow(?:ing|s)?\b")
    kind = F.when(base, "readme_base_declaration").otherwise("readme_declaration")
    return _out(df, kind, F.when(base, 0.99).when(follows, 0.88).otherwise(0.82), "address in the README")


def search_hits(hits: DataFrame, strategy: str, base: float, slope: float, cap: float, distinct_queries: bool = False, bonus: Column | None = None) -> DataFrame:
    """CND-09 to CND-11, AGG-09: landed search hits (job, repo_url, query, ord) counted by repository."""
    n = F.count_distinct("query") if distinct_queries else F.count("*")
    df = hits.withColumn("extra", bonus if bonus is not None else F.lit(0.0)).groupBy("job", "repo_url")
    queries = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"])), 1, 3)
    df = df.agg(n.alias("n"), F.max("extra").alias("extra"), F.array_join(queries, "; ").alias("queries"))
    return _out(df, strategy, S.python_round(F.least(F.lit(base) + slope * F.col("n") + F.col("extra"), F.lit(cap))), F.col("queries"))


def code_search(hits: DataFrame) -> DataFrame:
    return search_hits(hits, "github_code_search", 0.68, 0.06, 0.9)


def topic_search(hits: DataFrame, paper_ts: str = "paper_ts") -> DataFrame:
    """CND-10, DAT-03: a bonus for what was there before the paper."""
    early = F.when(F.col("created_at") <= F.col(paper_ts), 0.08).otherwise(0.0)
    return search_hits(hits, "temporal_topic_search", 0.62, 0.05, 0.9, True, early)


def citation_search(hits: DataFrame) -> DataFrame:
    return search_hits(hits, "citation_graph", 0.66, 0.05, 0.9)


def author_search(hits: DataFrame) -> DataFrame:
    """CND-12, FLT-15: hits whose owner or description holds one of the paper's surnames; the last query speaks."""
    text = F.concat_ws(" ", F.coalesce("owner", F.lit("")), F.lower(F.coalesce("description", F.lit(""))))
    df = hits.where(F.exists("surnames", lambda s: F.contains(text, s))).groupBy("job", "repo_url").agg(F.max_by("query", "ord").alias("query"))
    return _out(df, "author_graph", 0.72, F.col("query"))


def _token_overlap(target: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """(job, repo_url, name): MTH-01 of a job's tokens (job, token) with each candidate's (repo_url, token)."""
    target, other = target.distinct(), other.distinct()
    na = target.groupBy("job").agg(F.count("*").alias("na"))
    nb = other.groupBy("repo_url").agg(F.count("*").alias("nb"))
    both = target.join(other, "token").groupBy("job", "repo_url").agg(F.count("*").alias("k")).join(na, "job").join(nb, "repo_url")
    return both.select("job", "repo_url", (F.col("k") / F.least("na", "nb")).alias(name))


def fingerprints(files: DataFrame, others: DataFrame) -> DataFrame:
    """CND-13, MTH-03: path and symbol overlap of snapshots; files (job, path, text), others (repo_url, path, text)."""
    def tokens(df, key, col):
        return df.select(key, F.explode(col).alias("token"))

    paths = _token_overlap(*(tokens(d, k, T.signature_tokens(F.col("path"))) for d, k in ((files, "job"), (others, "repo_url"))), "paths")
    names = _token_overlap(*(tokens(d, k, T.symbols(F.col("text"))) for d, k in ((files, "job"), (others, "repo_url"))), "names")
    df = paths.join(names, ["job", "repo_url"], "full_outer").withColumn("s", 0.35 * F.coalesce("paths", F.lit(0.0)) + 0.65 * F.coalesce("names", F.lit(0.0)))
    df = df.where(F.col("s") >= V.FINGERPRINT_FLOOR)
    return _out(df, "code_fingerprint", S.clamp_linear(0.55, 1.0, F.col("s"), 0.92), F.concat(F.lit("fingerprint "), F.format_number("s", 2)))


def shapes(files: DataFrame, others: DataFrame) -> DataFrame:
    """CND-14, MTH-04: layout and dependency overlap."""
    def layout(df, key):
        top, ext = F.lower(F.get(F.split("path", "/"), F.lit(0))), T.extension(F.col("path"))
        return df.select(key, F.explode(F.filter(F.array(top, ext), lambda x: x != "")).alias("token"))

    def deps(df, key):
        req = df.where(F.lower("path").isin("requirements.txt", "requirements-dev.txt"))
        return req.select(key, F.explode(T.dependency_names(F.col("text"))).alias("token"))

    a = _token_overlap(layout(files, "job"), layout(others, "repo_url"), "layout")
    b = _token_overlap(deps(files, "job"), deps(others, "repo_url"), "deps")
    df = a.join(b, ["job", "repo_url"], "full_outer").withColumn("s", 0.55 * F.coalesce("layout", F.lit(0.0)) + 0.45 * F.coalesce("deps", F.lit(0.0)))
    return _out(df.where(F.col("s") >= V.SHAPE_FLOOR), "shape_similarity", S.clamp_linear(0.58, 1.0, F.col("s"), 0.88), "like layout")


def fallback(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """CND-16: a job without candidates has itself; jobs: job, own_url."""
    lone = jobs.join(candidates.select("job").distinct(), "job", "left_anti").select("job", F.col("own_url").alias("repo_url"))
    return _out(lone, "fallback", 0.35, "no other candidate")


def needs_remote_search(candidates: DataFrame) -> DataFrame:
    """FLT-05: jobs without a strong local signal."""
    strong = F.bool_or(F.col("strategy").isin(*V.LOCAL_STRATEGIES) & (F.col("confidence") >= 0.82))
    return candidates.groupBy("job").agg(strong.alias("strong")).where("not strong").select("job")


def is_settled(candidates: DataFrame) -> DataFrame:
    """FLT-06: jobs with a fork parent, or with exactly one declared base of 0.98 or more."""
    fork = F.bool_or(F.col("strategy") == "github_fork")
    bases = F.count_if((F.col("strategy") == "readme_base_declaration") & (F.col("confidence") >= 0.98))
    return candidates.groupBy("job").agg((fork | (bases == 1)).alias("settled")).where("settled").select("job")


def ranked(strategies: list[DataFrame], jobs: DataFrame) -> DataFrame:
    """CND-17, SET-01, SET-02, WIN-01, SRT-01, FLT-02: all strategies, without a job's own address; the best row of each
    repository, with its place."""
    every = reduce(DataFrame.unionByName, strategies).join(jobs, "job")
    every = every.where(F.lower("repo_url") != F.lower(F.coalesce("own_url", F.lit("")))).select(*COLUMNS)
    every = every.unionByName(fallback(jobs, every))
    table = F.create_map(*(x for n, p in V.STRATEGY_PRIORITY for x in (F.lit(n), F.lit(p))))
    every = every.withColumn("priority", F.coalesce(F.try_element_at(table, F.col("strategy")), F.lit(0)))
    order = [F.desc("priority"), F.desc("confidence"), F.desc("repo_url"), F.desc("evidence"), F.desc("strategy")]
    best = ranking.first_per_key(every, ["job", "repo_url"], order)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy(*order)))


def rerank(candidates: DataFrame, previews: DataFrame, top: int = 4) -> DataFrame:
    """SRT-02, AGG-01: the first `top` (and all model suggestions) by their diff previews: comparable anchors first, then
    a declared base, then the counts. previews: job, repo_url, comparable_anchors, comparable_files, modified, raw, new."""
    counts = ["comparable_anchors", "comparable_files", "modified", "raw"]
    df = candidates.where((F.col("place") <= top) | (F.col("strategy") == "llm_reasoning")).join(previews, ["job", "repo_url"], "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in [*counts, "new"]})
    key = F.struct(
        (F.col("comparable_anchors") > 0).alias("a"), (F.col("strategy") == "readme_base_declaration").alias("b"), *counts, (-F.col("new")).alias("n"), "priority", "confidence", "repo_url"
    )
    return df.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy(key.desc())))


def target_repository(requests: DataFrame) -> DataFrame:
    """JON-13: the first of explicit, paper, project page, suggested, known case and searched address; null if none."""
    names = ["explicit_url", "paper_url", "page_url", "suggested_url", "case_url", "searched_url"]
    return requests.withColumn("target_url", F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names)))
