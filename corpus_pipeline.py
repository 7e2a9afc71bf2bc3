"""A corpus pipeline of four stages: toxicity, exact dedup, near dedup, packing.

Each stage works on all that the one before it kept and writes its result as Parquet in the shared
folder, so a lost executor costs no more than its tasks. All but the last keep whole rows with the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismark.llm import common
from prismark.llm.exact_dedup import deduplicate
from prismark.llm.near_dedup import Threshold, keep_first
from prismark.llm.packing import pack, word_vocabulary
from prismark.llm.toxicity import keep_ordinary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold."""
    return keep_ordinary(docs, common.table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the one with the largest doc_id."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups (shingles of five words, similarity 0.8 or more) keeps the document with the least doc_id."""
    return keep_first(docs, Threshold(4, 5, 5))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return pack(docs, word_vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL cannot express the toxicity stage's model or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.collected(spark)
    return docs
