"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm import codes, licenses, lines, mixing, phrases, pieces, quality, simhash, tokencounts, toxicity, urls, vectors, webp
from trackledger.llm.common import crc_mod, table

MIX_SEED = 42


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokencounts.count_tokens(docs, ranks, public_tokenizers.PATTERN, rule="majority")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.token_digests(docs, piece_model_path(), into="found").select("doc_id", "found.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, seed=MIX_SEED, copy_col="copy_no", order_col="shuffle_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return judged(toxicity.score_toxicity(docs, labels), 4, 2, toxicity.THRESHOLD)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return judged(quality.score_quality(docs, labels), 5, 0, quality.THRESHOLD)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return webp.media_digests(docs).select("doc_id", "media.*")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def judged(scored: DataFrame, modulus: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        # A row without an id never trains.
        F.coalesce(crc_mod(F.col("doc_id"), modulus) == held_out, F.lit(True)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_embeddings": op8_embeddings,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_phrases": op11_phrases,
    "op12_codes": op12_codes,
    "op13_lines": op13_lines,
}
