"""Readers: file trees, archives, feeds, search payloads and fixtures as DataFrames. Fetching over a network and
git happen before loading; what they land is read here."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import fixed_values as V
from strandline.functions import text as T

# Files that describe a repository's dependencies and citations.
SUPPORTING_FILES = (
    "requirements.txt", "requirements-dev.txt", "pyproject.toml", "setup.py", "CITATION.cff", "CITATION.bib",
    ".gitmodules", ".git/config",
)


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01: (path, length, content) of all files below a folder, paths relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_replace(F.col("path"), f"^.*/{name}/", "")
    return df.select(relative.alias("path"), "length", "content")


def lossy_text(content: Column) -> Column:
    """SRC-06: UTF-8 text with malformed bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def strict_text(content: Column) -> Column:
    """Text of valid UTF-8, null otherwise."""
    return F.try_validate_utf8(content.cast("string"))


def snapshot(files: DataFrame, repo: str = "repo_url", most: int = V.MAX_FILES, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """SRC-02, SRC-05: the first `most` included files of each repository by path, of at most `max_bytes`, as text;
    a file left out for its size or encoding takes no place."""
    w = Window.partitionBy(repo).orderBy("path")
    df = files.where(T.included_file(F.col("path"))).where(F.col("length") <= max_bytes)
    df = df.withColumn("text", strict_text(F.col("content"))).where("text is not null")
    return df.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select(repo, "path", "ord", "text")


def supporting(files: DataFrame) -> DataFrame:
    """SRC-04: the files that describe a repository, whatever the snapshot filter says."""
    return files.where(F.col("path").isin(*SUPPORTING_FILES)).withColumn("text", strict_text(F.col("content")))


def one_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """SRC-03: texts of wanted (repo_url, path) rows, null where there is no such file."""
    return wanted.join(files, [c for c in ("repo_url", "path") if c in wanted.columns], "left").withColumn("text", strict_text(F.col("content")))


def mirror_key(url: Column) -> Column:
    """SRC-07: folder name of a mirror."""
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 16)


def first_commit(commits: DataFrame) -> DataFrame:
    """SRC-08: subject and files of each repository's first commit; commits: repo_url, ts, subject, files."""
    return commits.groupBy("repo_url").agg(F.min_by(F.struct("subject", "files"), "ts").alias("c")).select("repo_url", "c.subject", "c.files")


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """SRC-09: title, abstract and authors of a feed's entry; rows without title or abstract are dropped."""
    def at(path: str) -> Column:
        return F.btrim(F.regexp_replace(F.xpath_string(F.col(xml), F.lit(path)), r"\s+", " "))

    name = "*[local-name()='entry'][1]/*[local-name()='{}']"
    feed = "/*[local-name()='feed']/"
    df = feeds.withColumns(
        {
            "title": at(feed + name.format("title")),
            "abstract": at(feed + name.format("summary")),
            "authors": F.xpath(F.col(xml), F.lit(feed + name.format("author") + "/*[local-name()='name']/text()")),
        }
    )
    return df.where((F.col("title") != "") & (F.col("abstract") != ""))


MEMBERS = "source string, name string, text string"


def tar_members(archives: DataFrame, key: str = "source", suffix: str = ".tex") -> DataFrame:
    """SRC-10, SRC-11: text members of tar archives (content binary). What is no archive is one member of its own."""
    def run(frames):
        for pdf in frames:
            rows = []
            for k, raw in zip(pdf[key], pdf["content"]):
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                        for m in tar:
                            if m.isfile() and m.name.endswith(suffix):
                                rows.append((k, m.name, tar.extractfile(m).read().decode("utf-8", "ignore")))
                except tarfile.TarError:
                    rows.append((k, "", raw.decode("utf-8", "ignore")))
            yield pd.DataFrame(rows, columns=["source", "name", "text"])

    return archives.select(F.col(key).alias(key), "content").mapInPandas(run, MEMBERS)


def primary_tex(members: DataFrame) -> DataFrame:
    """SRC-11: the member of each archive with the highest score: length, and bonuses for the parts of a document."""
    text = F.col("text")
    score = F.length(text) + 100_000 * F.contains(text, F.lit("\\documentclass")).cast("int") + 50_000 * F.contains(text, F.lit("\\begin{document}")).cast("int")
    best = F.max_by(F.struct("name", "text"), F.struct(score, F.col("name"), text)).alias("m")
    return members.groupBy("source").agg(best).select("source", "m.name", "m.text")


def repository_metadata(payloads: DataFrame) -> DataFrame:
    """SRC-16: fork parent, notes and README from landed JSON (repo_url, repository, readme); a missing README is ''."""
    repo = F.from_json("repository", "parent struct<html_url:string>, description string")
    readme = F.from_json("readme", "content string, encoding string")["content"]
    return payloads.select(
        "repo_url", repo["parent"]["html_url"].alias("fork_parent"), F.coalesce(repo["description"], F.lit("")).alias("notes"),
        F.coalesce(F.unbase64(F.regexp_replace(readme, r"\s", "")).cast("string"), F.lit("")).alias("readme"),
    )


def search_hits(payloads: DataFrame) -> DataFrame:
    """SRC-18: (strategy, query, ord, repo_url, description, owner, created_at) of landed search payloads."""
    item = "html_url string, description string, created_at string, owner struct<login:string>, repository struct<html_url:string>"
    items = F.from_json("payload", f"items array<struct<{item.replace(' string', ':string').replace(' struct', ':struct')}>>")["items"]
    df = payloads.select("strategy", "query", F.posexplode(items).alias("ord", "i"))
    return df.select(
        "strategy", "query", "ord", T.repo_key(F.coalesce("i.html_url", "i.repository.html_url")).alias("repo_url"), F.col("i.description").alias("description"),
        F.lower("i.owner.login").alias("owner"), F.try_to_timestamp("i.created_at").alias("created_at"),
    ).where("repo_url is not null")


def fixture(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-13, SRC-17, SRC-21: multi-line JSON fixtures, one document a file."""
    return spark.read.schema(schema).option("multiLine", "true").json(folder)


def landed_pages(wanted: DataFrame, pages: DataFrame, most: int = 200_000) -> DataFrame:
    """SRC-19: the first `most` characters of the landed page (url, html) of each wanted address (url), its text, and null
    where none was fetched; an address is looked up without its fragment."""
    bare = F.regexp_replace("url", r"#.*$", "")
    found = pages.select(bare.alias("_key"), "html").groupBy("_key").agg(F.left(F.max("html"), F.lit(most)).alias("html"))
    return wanted.withColumn("_key", bare).join(found, "_key", "left").drop("_key").withColumn("text", T.strip_html(F.col("html")))


def pdf_pages(files: DataFrame, most: int = 12) -> DataFrame:
    """SRC-12: (path, page, title, text) of the first `most` pages of PDF files (path, content); what is no readable PDF
    has no rows. See sources.pdf for what the decoder knows."""
    from strandline.sources import pdf

    def run(frames):
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"]):
                title, texts = pdf.read(bytes(raw)) if raw is not None else ("", [])
                rows += [(path, k, title, text) for k, text in enumerate(texts[:most])]
            yield pd.DataFrame(rows, columns=["path", "page", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, title string, text string")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, warning: str) -> DataFrame:
    """SRC-15: the primary row where there is one, else the fallback's with a warning put first."""
    value = [c for c in primary.columns if c not in (key, "warnings")]
    p, f = primary.alias("p"), fallback.alias("f")
    missing = F.col("p.warnings").isNull()
    warned = F.concat(F.array(F.lit(warning)), F.coalesce(F.col("f.warnings"), F.array().cast("array<string>")))
    return p.join(f, key, "full_outer").select(
        key, *(F.coalesce(F.col(f"p.{c}"), F.col(f"f.{c}")).alias(c) for c in value), F.when(missing, warned).otherwise(F.col("p.warnings")).alias("warnings")
    )


def by_kind(requests: DataFrame, branches: dict) -> DataFrame:
    """SRC-14: each request goes to the branch of its kind (a function DataFrame -> DataFrame); branches share columns."""
    kind = T.paper_kind(F.col("source"))
    out = None
    for name, branch in branches.items():
        part = branch(requests.where(kind == name))
        out = part if out is None else out.unionByName(part)
    return out


def artifacts(spark: SparkSession, folder: str, sessions: DataFrame, schema: str, key: str = "cache_key") -> DataFrame:
    """SRC-22: stored payloads of sessions that are ready (cache_key, build_status); written by sinks.write_artifacts."""
    stored = spark.read.text(folder).withColumn("p", F.from_json("value", schema)).select(key, "p.*")
    return stored.join(sessions.where("build_status = 'ready'").select(key).distinct(), key, "left_semi")


def primary_language(files: DataFrame, languages: tuple[str, ...] = ("python",)) -> DataFrame:
    """FLT-11: files in the configured languages."""
    return files.where(T.language(F.col("path")).isin(*languages))
