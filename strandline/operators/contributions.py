"""Contributions of a paper: found in sections and sentences, clustered, merged, and mapped to clusters of changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T


def by_signature(papers: DataFrame) -> DataFrame:
    """CTR-01: known contributions whose triggers a paper (job, title, text) holds; one pass, no join."""
    hay = F.lower(F.concat_ws("\n", "title", "text"))

    def one(cid, title, keywords, triggers) -> Column:
        found = F.filter(F.array(*(F.when(F.contains(hay, F.lit(t)), F.lit(t)) for t in triggers)), lambda x: x.isNotNull())
        words = F.slice(F.array_distinct(F.concat(F.array(*map(F.lit, keywords)), found)), 1, 4)
        return F.when(F.size(found) > 0, F.struct(F.lit(cid).alias("id"), F.lit(title).alias("title"), words.alias("keywords")))

    rows = F.filter(F.array(*(one(*s) for s in V.SIGNATURES)), lambda x: x.isNotNull())
    return papers.select("job", F.posexplode(rows).alias("ord", "c")).select("job", "ord", "c.*")


def by_sentence(papers: DataFrame, least: int = 4, most: int = 3) -> DataFrame:
    """CTR-02: the best sentences of each paper, by score, of at least `least`."""
    df = papers.select("job", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence")).withColumn("score", T.sentence_score(F.col("sentence")))
    w = Window.partitionBy("job").orderBy(F.desc("score"), "ord")
    df = df.where(F.col("score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return df.select("job", "place", T.title_of(F.col("sentence")).alias("title"), T.tokens(F.col("sentence")).alias("keywords"), "score")


def findings(sections: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """CTR-03, FLT-16: list items and sentences of sections (job, ord, heading, text) of the given kinds, scored with the
    heading's boost."""
    df = sections.withColumn("kind", T.section_kind(F.col("heading"))).where(F.col("kind").isin(*kinds))
    parts = F.array_distinct(F.concat(T.list_items(F.col("text")), T.sentences(F.col("text"))))
    df = df.select("job", "ord", "kind", "heading", F.posexplode(parts).alias("pos", "snippet"))
    return df.withColumn("score", T.sentence_score(F.col("snippet")) + T.heading_boost(F.col("heading")))


def from_findings(found: DataFrame, least: int = 5, most: int = 5) -> DataFrame:
    """CTR-04, SRT-04: the best findings of each job as contributions."""
    w = Window.partitionBy("job").orderBy(F.desc("score"), F.desc(F.length("snippet")), "ord", "pos")
    df = found.where(F.col("score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    x = F.col("snippet")
    return df.select(
        "job", "place", T.title_of(x).alias("title"), T.tokens(x).alias("keywords"), T.from_marker(x, V.PROBLEM_MARKERS, 160).alias("problem_solved"),
        T.from_marker(x, V.DIFFERENCE_MARKERS, 180).alias("baseline_difference"), T.references(x).alias("evidence_refs"), T.complexity(x).alias("complexity"),
    )


def merge_by_title(contributions: DataFrame) -> DataFrame:
    """SEQ-06: one row for each lower-cased title of a job; the first gives id and title, lists are united in order and
    cut to six keywords; other details are not carried over."""
    df = contributions.withColumn("key", F.lower("title"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "id", "title", "keywords")))
    df = df.groupBy("job", "key").agg(rows.alias("r"))
    words = F.slice(F.array_distinct(F.flatten(F.transform("r", lambda x: x["keywords"]))), 1, 6)
    return df.select("job", F.col("r")[0]["ord"].alias("ord"), F.col("r")[0]["id"].alias("id"), F.col("r")[0]["title"].alias("title"), words.alias("keywords"))


def synthesise(found: DataFrame, least_score: int = 4, most: int = 5) -> DataFrame:
    """CTR-05, SEQ-03, SRT-05, SRT-08: findings of a job clustered in order by shared tokens (two or more); the best
    clusters, by summed score and number of section kinds, then size, led by their best finding."""
    schema = "job string, cluster int, score long, size int, lead string, keywords array<string>"

    def run(pdf):
        clusters: list[dict] = []
        for r in pdf.sort_values(["ord", "pos"]).itertuples(index=False):
            mine = set(r.tokens)
            best = max(clusters, key=lambda c: len(mine & c["tokens"]), default=None)
            if best is None or len(mine & best["tokens"]) < 2:
                best = {"tokens": set(), "rows": [], "kinds": set()}
                clusters.append(best)
            best["tokens"] |= mine
            best["rows"].append(r)
            best["kinds"].add(r.kind)
        clusters.sort(key=lambda c: (-sum(r.score for r in c["rows"]) - len(c["kinds"]), -len(c["rows"])))
        rows = []
        for k, c in enumerate(clusters[:most]):
            lead = max(c["rows"], key=lambda r: (r.score, r.kind == "contributions", r.kind == "method", len(r.snippet)))
            rows.append((pdf["job"].iat[0], k, sum(r.score for r in c["rows"]), len(c["rows"]), lead.snippet, sorted(c["tokens"])[:6]))
        return pd.DataFrame(rows, columns=["job", "cluster", "score", "size", "lead", "keywords"])

    df = found.where(F.col("score") >= least_score).withColumn("tokens", T.tokens(F.col("snippet")))
    df = df.select(F.col("job").cast("string").alias("job"), "ord", "pos", "kind", "snippet", F.col("score").cast("long").alias("score"), "tokens")
    out = df.groupBy("job").applyInPandas(run, schema)
    return out.where(F.size("keywords") >= 2).withColumn("title", T.title_of(F.col("lead")))


def structured_or_fallback(structured: DataFrame, other: DataFrame) -> DataFrame:
    """CTR-06: a job's structured contributions, or the others where it has none."""
    return structured.unionByName(other.join(structured.select("job").distinct(), "job", "left_anti"))


def concepts(x: Column, table) -> Column:
    """CTR-10: formula concepts whose markers a lower-cased text holds."""
    return F.filter(F.array(*(F.when(T.any_contains(x, ms), F.lit(c)) for c, ms in table)), lambda v: v.isNotNull())


def match_scores(contributions: DataFrame, clusters: DataFrame) -> DataFrame:
    """MTH-09, MTH-10, MTH-11, CTR-08: score, confidence, coverage and fidelity of each contribution and cluster of a job.
    contributions: job, contribution_id, title, keywords, hints; clusters: job, cluster_id, text. The job is the key."""
    df = contributions.join(clusters, "job")
    hay, words = F.lower("text"), F.size(F.filter("keywords", lambda k: F.contains(F.lower("text"), F.lower(k))))
    title = F.size(F.filter(T.tokens(F.col("title")), lambda k: F.contains(hay, k)))
    hint = F.least(F.size(F.filter(T.tokens(F.array_join("hints", " ")), lambda k: F.contains(hay, k))), F.lit(3))
    steps = T.steps(F.col("title"), F.col("hints"))
    own = T.tokens(F.col("text"))
    done = F.filter(steps, lambda s: F.size(F.array_intersect(T.tokens(s), own)) >= 2)
    df = df.withColumns({"steps": F.size(steps), "steps_done": F.size(done)})
    df = df.withColumn("score", 5 * words + 2 * title + hint + 3 * F.col("steps_done"))
    share = S.ratio(F.col("steps_done"), F.col("steps"))
    paper = F.lower(F.concat_ws(" ", "title", F.array_join("hints", " ")))
    idea = concepts(paper, V.PAPER_CONCEPTS)
    formula = S.ratio(F.size(F.array_intersect(idea, concepts(hay, V.CODE_CONCEPTS))), F.size(idea))
    snippet = S.recall(own, T.tokens(paper))
    df = df.withColumns({"snippet_fidelity": snippet, "formula_fidelity": F.greatest(formula, snippet)})
    confidence = F.least(0.55 + 0.03 * F.col("score") + 0.12 * share + 0.12 * F.col("snippet_fidelity"), F.lit(0.97))
    coverage = F.least(0.12 + 0.05 * F.col("score") + 0.24 * share + 0.2 * F.col("snippet_fidelity") + 0.14 * F.col("formula_fidelity"), F.lit(1.0))
    df = df.withColumns({"confidence": S.python_round(confidence), "coverage": S.python_round(coverage)})
    kind = F.when(F.col("coverage") >= 0.85, "FULL").when(F.col("coverage") >= 0.6, "PARTIAL").when(F.col("score") >= 3, "APPROXIMATED").otherwise("MISSING")
    return df.withColumn("coverage_type", kind)


def assign(scores: DataFrame) -> DataFrame:
    """SEQ-02: clusters of a job in order take their best contribution; of equals one not used yet, then the greater id."""
    schema = "job string, cluster_id string, contribution_id string, score long"

    def run(pdf):
        used, rows = set(), []
        for cluster, part in pdf.groupby("cluster_id", sort=True):
            part = part[part["score"] > 0]
            if len(part):
                best = max(part.itertuples(index=False), key=lambda r: (r.score, r.contribution_id not in used, r.contribution_id))
                used.add(best.contribution_id)
                rows.append((best.job, cluster, best.contribution_id, best.score))
        return pd.DataFrame(rows, columns=["job", "cluster_id", "contribution_id", "score"])

    df = scores.select(F.col("job").cast("string").alias("job"), F.col("cluster_id").cast("string").alias("cluster_id"), F.col("contribution_id").cast("string").alias("contribution_id"), F.col("score").cast("long").alias("score"))
    return df.groupBy("job").applyInPandas(run, schema)


def reading_order(files: DataFrame) -> DataFrame:
    """SRT-06, SRT-07: a cluster's files by token overlap with the contribution, a tag in the path, then path; the first
    is the entry point. files: job, cluster_id, path, tokens, wanted, tags."""
    shared = F.size(F.array_intersect("tokens", "wanted"))
    tagged = F.exists("tags", lambda t: F.contains(F.lower("path"), t)).cast("int")
    w = Window.partitionBy("job", "cluster_id").orderBy(F.desc("shared"), F.desc("tagged"), "path")
    return files.withColumns({"shared": shared, "tagged": tagged}).withColumn("place", F.row_number().over(w))


def merge_details(contributions: DataFrame, details: DataFrame) -> DataFrame:
    """SEQ-05: each detail finding (job, ord, snippet, refs) goes to the contribution of its job that shares most tokens
    with it, two at least (the earliest of equals); a contribution with details is one step more complex, 5 at most."""
    c = contributions.withColumn("c_tokens", F.array_union(T.tokens(F.col("title")), "keywords"))
    d = details.withColumn("d_tokens", T.tokens(F.col("snippet")))
    pairs = d.join(c.select("job", F.col("place").alias("c_place"), "c_tokens"), "job")
    pairs = pairs.withColumn("n", F.size(F.array_intersect("d_tokens", "c_tokens"))).where("n >= 2")
    w = Window.partitionBy("job", "ord").orderBy(F.desc("n"), "c_place")
    best = pairs.withColumn("r", F.row_number().over(w)).where("r = 1")
    rows = F.array_sort(F.collect_list(F.struct("ord", "snippet", "refs")))
    got = best.groupBy("job", F.col("c_place").alias("place")).agg(rows.alias("d"))
    out = contributions.join(got, ["job", "place"], "left")
    hints = F.coalesce(F.slice(F.transform("d", lambda x: x["snippet"]), 1, 3), F.array().cast("array<string>"))
    refs = F.array_distinct(F.concat("evidence_refs", F.coalesce(F.flatten(F.transform("d", lambda x: x["refs"])), F.array().cast("array<string>"))))
    more = F.least(F.col("complexity") + F.col("d").isNotNull().cast("int"), F.lit(5))
    return out.withColumns({"hints": hints, "evidence_refs": refs, "complexity": more}).drop("d")


def trace_anchors(anchors: DataFrame, most: int = 4) -> DataFrame:
    """CTR-09, SRT-09: a cluster's best anchors for a contribution. anchors: job, cluster_id, contribution_id, path,
    start, snippet, keywords; 3 for each keyword in the snippet, 4 for each shared concept, 2 for each keyword in the path."""
    low = F.lower("snippet")
    words = F.size(F.filter("keywords", lambda k: F.contains(low, F.lower(k))))
    ideas = F.size(F.array_intersect(concepts(low, V.CODE_CONCEPTS), concepts(F.lower(F.array_join("keywords", " ")), V.PAPER_CONCEPTS)))
    paths = F.size(F.filter("keywords", lambda k: F.contains(F.lower("path"), F.lower(k))))
    df = anchors.withColumn("score", 3 * words + 4 * ideas + 2 * paths).where("score > 0")
    w = Window.partitionBy("job", "cluster_id", "contribution_id").orderBy(F.desc("score"), F.desc("path"), F.desc("start"))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def with_suggestions(own: DataFrame, suggested: DataFrame) -> DataFrame:
    """CTR-07: suggested contributions (a landed table) first, then a job's own; merged by title."""
    both = suggested.withColumn("ord", F.col("ord") - 1_000_000).unionByName(own)
    return merge_by_title(both)
