"""Review state: statuses, buckets, projections of links, client views and job requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import ranking

# Build phases in order, and verdicts that a refinement may give.
PHASES = ("queued", "resolving_source", "mapping_files", "building_diffs", "building_claims", "linking", "rendering", "publishing")
VERDICTS = ("supports", "partially_supports", "contradicts")
RINGS = (("github_fork", 0), ("readme_base_declaration", 0), ("readme_declaration", 1), ("framework_signature", 1), ("metadata_url", 1), ("paper_mention", 2))


def semantic_status(diff_type: Column, match_type: Column, language: Column, large: Column) -> Column:
    """REV-07: what can be said of a pair of files: the first rule that applies."""
    faint = match_type.isin("low_confidence", "ambiguous")
    return (
        F.when(large, "large_file").when((diff_type == "added") & ~faint, "new_file").when(diff_type == "deleted", "deleted_file")
        .when((diff_type != "added") & (language != "python"), "unsupported_language").otherwise("fallback_text")
    )


def bucket(diff_type: Column, match_type: Column, status: Column, language: Column, primary=V.PRIMARY_LANGUAGES) -> Column:
    """REV-08: the bucket of a pair of files, by order of priority."""
    return (
        F.when(status == "large_file", "large_files").when(match_type == "ambiguous", "ambiguous").when(match_type == "low_confidence", "low_confidence").when(diff_type == "added", "added")
        .when(diff_type == "deleted", "deleted").when(~language.isin(*primary), "other_languages").otherwise("primary")
    )


def queue(entries: DataFrame) -> DataFrame:
    """SRT-03: place of each entry of a job: linked first, then significance, changed lines and path."""
    rank = S.significance_rank(F.col("significance"))
    w = Window.partitionBy("job").orderBy((F.col("linked_claims") > 0).desc(), rank.desc(), F.desc("changed_lines"), "path")
    return entries.withColumn("place", F.row_number().over(w))


def project_statuses(claims: DataFrame, links: DataFrame, refining: bool = False) -> DataFrame:
    """AGG-07, REV-05: claim and contribution status. claims: job, contribution_key, claim_id; links: claim_id, accepted."""
    best = links.groupBy("claim_id").agg(F.bool_or("accepted").alias("mapped"))
    df = claims.join(best, "claim_id", "left")
    waiting = F.col("mapped").isNotNull() if refining else F.lit(False)
    df = df.withColumn("status", F.when(F.coalesce("mapped", F.lit(False)), "mapped").when(waiting, "refining").otherwise("unmapped"))
    by = df.groupBy("job", "contribution_key")
    s = F.col("status")
    group = by.agg(F.when(F.bool_and(s == "mapped"), "mapped").when(F.bool_or(s == "mapped"), "partially_mapped").when(F.bool_or(s == "refining"), "refining").otherwise("unmapped").alias("contribution_status"))
    return df.join(group, ["job", "contribution_key"])


def refine(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """REV-10, FLT-14: links whose hunk has a verdict of support; unknown verdicts and hunks count for nothing."""
    known = verdicts.where(F.col("verdict").isin(*VERDICTS)).select("claim_id", "hunk_id", "verdict")
    df = links.join(known, ["claim_id", "hunk_id"], "left")
    return df.withColumn("accepted", F.col("verdict").isin("supports", "partially_supports").eqNullSafe(True))


def apply_projection(entries: DataFrame, links: DataFrame) -> DataFrame:
    """REV-11: entries with their new link counts (0 where none), sorted anew."""
    counts = links.where("accepted").groupBy("job", "file_id").agg(F.count_distinct("claim_id").alias("n"))
    df = entries.drop("place").join(counts, ["job", "file_id"], "left").withColumn("linked_claims", F.coalesce("n", F.lit(0))).drop("n")
    return queue(df.withColumn("significance", S.significance(F.col("changed_lines"), F.col("linked_claims"))))


def demote_weak(mappings: DataFrame) -> DataFrame:
    """FLT-08, CTR-11: weak mappings become MISSING with a coverage of 0.1 at most; those without anchors go."""
    weak = S.weak_mapping(F.col("comparable"), F.col("anchors"), F.col("snippet_fidelity"), F.col("formula_fidelity"), F.col("coverage"))
    df = mappings.withColumn("weak", weak).where(~F.col("weak") | (F.col("anchors") > 0))
    return df.withColumns({"coverage": F.when(F.col("weak"), F.least("coverage", F.lit(0.1))).otherwise(F.col("coverage")), "coverage_type": F.when(F.col("weak"), "MISSING").otherwise(F.col("coverage_type"))})


def focus(mappings: DataFrame, condition: Column | None = None) -> DataFrame:
    """WIN-11, CLI-04: the mapping that each job opens with, by comparable anchors, anchors, coverage and confidence."""
    df = mappings if condition is None else mappings.where(condition)
    order = [F.desc("comparable"), F.desc("anchors"), F.desc("coverage"), F.desc("confidence"), "cluster_id", "contribution_id"]
    return ranking.first_per_key(df, ["job"], order)


def status_view(sessions: DataFrame) -> DataFrame:
    """REV-15, CLI-10: status and percent of a build (job, build_status, phase, done, total)."""
    stage = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")) - 1
    inside = F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0)
    percent = F.when(F.col("build_status") == "ready", 100.0).otherwise(S.clamp01((stage + inside) / len(PHASES)) * 100)
    return sessions.withColumn("percent", percent).withColumn("available", F.col("build_status") == "ready")


def reusable_job(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """FLT-12, WIN-04, STM-04: the newest job with a request's source that has not failed; null if there is none."""
    live = jobs.where(F.col("status").isin("queued", "running", "succeeded"))
    newest = live.groupBy("paper_source").agg(F.max_by("job", F.struct("created_at", "job")).alias("reused_job"))
    return requests.join(newest, "paper_source", "left")


def submit(requests: DataFrame) -> DataFrame:
    """API-01, STR-02, STR-03, HSH-02: request rows with kind, stable id and queued state; an empty source raises."""
    source = F.btrim("paper_source")
    df = requests.withColumn("paper_source", source).withColumn("kind", T.paper_kind(source))
    job = S.stable_digest(24, paper_source=source, repo_url=F.coalesce("repo_url", F.lit("")))
    return df.select(job.alias("job"), "paper_source", "repo_url", "kind", F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.current_timestamp().alias("created_at"))


def lineage_rings(candidates: DataFrame) -> DataFrame:
    """CLI-06, SRT-15: ring of each candidate by strategy, and order inside a job."""
    ring = F.lit(3)
    for name, value in reversed(RINGS):
        ring = F.when(F.col("strategy") == name, value).otherwise(ring)
    w = Window.partitionBy("job").orderBy("ring", F.desc("confidence"), "repo_url")
    return candidates.withColumn("ring", ring).withColumn("ring_place", F.row_number().over(w))


def revision(files: DataFrame) -> DataFrame:
    """HSH-05: digest of each repository's files (repo_url, path, text) as sorted canonical JSON."""
    row = F.struct(F.col("path").alias("p"), F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"), F.col("path").alias("relative_path")).alias("j"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["j"]))
    return files.groupBy("repo_url").agg(F.left(F.sha2(listed.cast("binary"), 256), F.lit(16)).alias("revision"))


def cache_key(**parts: Column) -> Column:
    """HSH-07, HSH-08: digest of named parts, 32 hex digits."""
    return S.stable_digest(32, **parts)


def coerce_contribution(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSN-03, STR-46: contributions from a model's reply, however it is wrapped; missing lists are empty, complexity is
    clamped to 1..5 (2 where missing), confidence to 0..0.99 (0.45 where missing); items without a title go."""
    kind = "array<struct<title:string,section:string,keywords:array<string>,impl_hints:array<string>,implementation_complexity:string,confidence:string,repo_url:string>>"
    df = payloads.withColumn("_i", F.from_json(T.json_block(F.col(column)), kind))
    df = df.select(*payloads.columns, F.posexplode("_i").alias("ord", "i")).where(F.btrim(F.coalesce("i.title", F.lit(""))) != "")
    none = F.array().cast("array<string>")
    complexity = F.coalesce(F.col("i.implementation_complexity").try_cast("int"), F.lit(2))
    confidence = F.coalesce(F.col("i.confidence").try_cast("double"), F.lit(0.45))
    return df.select(
        *[c for c in payloads.columns if c != column], "ord", "i.title", F.coalesce("i.section", F.lit("")).alias("section"),
        F.coalesce("i.keywords", none).alias("keywords"), F.coalesce("i.impl_hints", none).alias("hints"),
        F.greatest(F.lit(1), F.least(F.lit(5), complexity)).alias("complexity"),
        F.greatest(F.lit(0.0), F.least(F.lit(0.99), confidence)).alias("confidence"), T.repo_key(F.col("i.repo_url")).alias("repo_url"),
    )


def context_summary(files: DataFrame, most: int = 10) -> DataFrame:
    """STR-51, AGG-05: each repository's most frequent top folders and imports (ties by name), as text."""
    def top(df, name):
        counts = df.groupBy("repo_url", "v").agg(F.count("*").alias("n"))
        w = Window.partitionBy("repo_url").orderBy(F.desc("n"), "v")
        rows = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("v", F.lit(" ("), "n", F.lit(")")).alias("t")))), lambda x: x["t"]), ", ")
        return rows.groupBy("repo_url").agg(listed.alias(name))

    dirs = files.where(F.contains("path", F.lit("/"))).select("repo_url", F.get(F.split("path", "/"), F.lit(0)).alias("v"))
    mods = files.select("repo_url", F.explode(T.imports(F.col("text"))).alias("v"))
    df = top(dirs, "dirs").join(top(mods, "imports"), "repo_url", "full_outer")
    return df.withColumn("summary", F.concat(F.lit("folders: "), F.coalesce("dirs", F.lit("-")), F.lit("\nimports: "), F.coalesce("imports", F.lit("-"))))


def all_warnings(*stages: DataFrame) -> DataFrame:
    """AGG-14: distinct warnings of each job over stages (job, warnings), in order of stage."""
    every = None
    for k, s in enumerate(stages):
        part = s.select("job", F.lit(k).alias("k"), F.posexplode("warnings").alias("pos", "w"))
        every = part if every is None else every.unionByName(part)
    rows = F.array_sort(F.collect_list(F.struct("k", "pos", "w")))
    return every.groupBy("job").agg(F.array_distinct(F.transform(rows, lambda x: x["w"])).alias("warnings"))


def job_list(jobs: DataFrame) -> DataFrame:
    """API-02, SRT-11: jobs, newest first."""
    return jobs.orderBy(F.desc("created_at"), "job")


def result_of(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """API-03, API-04: each job with its result and how to answer for it."""
    df = jobs.join(results, "job", "left")
    code = F.when(F.col("result").isNotNull(), 200).when(F.col("status").isin("queued", "running"), 202).when(F.col("status") == "failed", 409).otherwise(404)
    return df.withColumn("code", code)


def file_of(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """API-06, CLI-02: wanted (job, file_id) rows with their entry and the first bucket that holds it."""
    first = entries.groupBy("job", "file_id").agg(F.min_by(F.struct(*[c for c in entries.columns if c not in ("job", "file_id")]), "bucket_place").alias("e"))
    return wanted.join(first, ["job", "file_id"], "left").select("job", "file_id", "e.*")


def cluster_files(anchors: DataFrame) -> DataFrame:
    """CLI-08, CLI-09, AGG-17: files of each cluster by number of anchors, then path; how many can be compared."""
    df = anchors.groupBy("cluster_id", "path").agg(F.count("*").alias("n"), F.count_if("comparable").alias("comparable"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "path")
    return df.withColumn("place", F.row_number().over(w))


def linked_hunks(hunks: DataFrame) -> DataFrame:
    """CLI-11: hunks of each file that hold the selected claim; hunks: file_id, claim_ids, selected."""
    return hunks.groupBy("file_id").agg(F.count_if(F.array_contains("claim_ids", F.col("selected"))).alias("n"))


def checklist(x: Column) -> Column:
    """CLI-12: non-empty sentences of what a contribution says."""
    return F.filter(F.flatten(F.transform(F.filter(x, lambda v: v.isNotNull()), T.sentences)), lambda v: v != "")
