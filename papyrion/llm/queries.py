"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.bpe import bpe_round_trip
from papyrion.llm.conversations import repaired_conversations
from papyrion.llm.embedding_dedup import embedding_dedup
from papyrion.llm.exact_dedup import exact_dedup
from papyrion.llm.language_id import identify_pages, language_id
from papyrion.llm.license_scan import scan_licenses
from papyrion.llm.mixing import mix_sources
from papyrion.llm.pii import find_pii
from papyrion.llm.quality import document_quality
from papyrion.llm.simhash import simhash_dedup
from papyrion.llm.token_counts import quantiles, token_counts, totals_at
from papyrion.llm.token_output import token_output
from papyrion.llm.whitening import whitened_vectors
from papyrion.sources.tables import table
from papyrion.workspace import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: No source is repeated more often than this.
MAX_REPEATS = 4.0
#: Context limits and shares of documents that ``token_limits`` reports.
CONTEXT_LIMITS = [128, 512, 1024, 2048, 4096, 8192, 32768, 131072]
SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup(table(spark, folder, "documents"))


def op4_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output(spark, table(spark, folder, "documents"), WORD_BPE)


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), BYTE_BPE)


def token_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The same histogram's answers for some context limits and quantiles: (kind, at, value, tokens kept under that limit)."""
    bars = materialize(token_counts(table(spark, folder, "documents"), BYTE_BPE), "histogram")
    limits = totals_at(bars, CONTEXT_LIMITS).select(F.lit("limit").alias("kind"), F.col("context_limit").cast("double").alias("at"), F.col("truncated_docs").alias("value"), F.col("kept_tokens").alias("tokens"))
    found = quantiles(bars, SHARES).select(F.lit("quantile").alias("kind"), F.col("share").alias("at"), F.col("n_tokens").alias("value"), F.lit(None).cast("long").alias("tokens"))
    return limits.unionByName(found)


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), BYTE_BPE, max_repeats=MAX_REPEATS)


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_round_trip(table(spark, folder, "documents"), BYTE_BPE)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


def language_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator on web pages, with markup, suffix and domain evidence."""
    found = identify_pages(table(spark, folder, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("__lang").alias("lang"), F.col("__probability").alias("probability"), F.col("__accepted").alias("accepted"))


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(table(spark, folder, "embeddings"))


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    return document_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_vectors(table(spark, folder, "embeddings"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired_conversations(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_language_id": op3_language_id,
    "language_pages": language_pages,
    "op4_token_output": op4_token_output,
    "op5_token_counts": op5_token_counts,
    "token_limits": token_limits,
    "op6_source_mixing": op6_source_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_quality": op11_quality,
    "op12_whitening": op12_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
}
