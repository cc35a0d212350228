"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents;
the last returns the encoded samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut
from strandline.llm.line_dedup import line_dedup
from strandline.llm.mixing import mix_documents
from strandline.llm.near_dedup import near_dedup
from strandline.llm.quality_rules import quality_filter
from strandline.llm.sp_sampling import sample_encode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs.select(*COLUMNS))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more documents share; n_chars is counted anew. A document whose
    lines all go stays, with an empty text."""
    kept = line_dedup(docs, min_docs=10, min_chars=1, columns=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup(docs.select(*COLUMNS), percent=80, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each row, with their inclusion probabilities."""
    return sample_encode(docs, samples=2)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# Similarity components, balanced and perturbed sampling are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table; each but the last is checkpointed, as the next reads it repeatedly."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
