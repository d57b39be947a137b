"""Corpus pipeline: quality rules, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
The first four return the columns of ``documents``; the last returns packed pieces.  A stage's
result is to be written before the next stage is made from it: that one deletes what earlier
stages wrote for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import blocknames, hyperlang, lshforest, packing, perplexity
from tidewater.llm.common import stage_of, stage_output
from tidewater.llm.queries import END_ID, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside their language's perplexity band."""
    with stage_of(docs, first=True):
        return perplexity.quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a likely language."""
    with stage_of(docs):
        return hyperlang.language_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest doc_id of equal texts."""
    with stage_of(docs):
        return blocknames.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group that links of similarity 0.8 or more hold together."""
    with stage_of(docs):
        return lshforest.one_per_class(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    with stage_of(docs):
        return packing.pack_documents(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("packing", packed),
]

#: Perplexity, hyperdimensional profiles and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stage_output(docs) if k else docs, sf_dir)
    return docs
