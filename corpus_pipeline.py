"""The corpus pipeline: toxic documents go, then exact and near copies; sources are mixed, and texts encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheafline.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from sheafline.llm.common import Workspace, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs, Workspace(spark, "exact"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return ngram_join.one_of_each(docs, Workspace(spark, "near"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_documents(docs, Workspace(spark, "mixing"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of a round trip."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # smaller blocks than by itself: the workers still hold what earlier stages have left
    return bpe.round_trip(docs, Workspace(spark, "encoding"), path, public_tokenizers.PATTERN, block_bytes=4 << 20)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_level_bpe", encoding_stage),
]
#: The learnt, randomised and tokenizing stages can't be written in SQL; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.write(docs, f"{k}-{name}")
    return docs
