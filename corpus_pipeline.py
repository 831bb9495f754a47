"""Corpus pipeline: filter, deduplicate, mix and tokenize the documents.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns a frame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackledger.llm import mixing, pieces, quality, simhash, toxicity
from trackledger.llm.common import cut, table
from trackledger.llm.queries import MIX_SEED, piece_model_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under its threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores at or over its threshold go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays: the smallest id."""
    return simhash.keep_one_per_group(docs, width=5, rule=simhash.Similar(0.8))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that all sources have equal weight; the order is shuffled."""
    return mixing.mix(docs, seed=MIX_SEED)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, per document copy."""
    found = pieces.token_digests(docs, piece_model_path(), into="pieces_found")
    return found.select("doc_id", "lang", "source", "pieces_found.*")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifiers and the tokenizer cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
