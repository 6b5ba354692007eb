"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, exact_dedup, language_id, language_model, mixing, ngram_join, periodic, ranking, token_counts, token_files, topk, toxicity
from .common import Workspace, read


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(read(spark, sf_dir, "documents"), Workspace(spark, "op1"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(read(spark, sf_dir, "documents"), Workspace(spark, "op3"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read(spark, sf_dir, "documents"), Workspace(spark, "op6"), path, public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"), Workspace(spark, "op8"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"), Workspace(spark, "op9"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), Workspace(spark, "op10"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_byte_level_bpe": op6_byte_level_bpe,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ranking_ties": ranking.op11_ranking_ties,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_exact_top_k": topk.op13_exact_top_k,
}
ORACLES = {"op8_embedding_near_dedup": embedding_dedup.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_ranking_ties": ranking.ORACLE, "op13_exact_top_k": topk.ORACLE}
