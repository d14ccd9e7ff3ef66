"""A corpus through five stages; each stage's rows are written as Parquet and read by the next.

Every stage keeps columns of any name as they are, takes whole texts however long, and gives an
empty result for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrion.llm.bpe import bpe_round_trip
from papyrion.llm.exact_dedup import drop_copies
from papyrion.llm.language_id import accepted_documents
from papyrion.llm.mixing import mixed_corpus
from papyrion.llm.near_copies import drop_near_copies
from papyrion.llm.queries import BYTE_BPE, MAX_REPEATS
from papyrion.sources.tables import table
from papyrion.workspace import materialize

#: Pieces of words that a worker remembers: the stages share the executors' memory.
CACHE = 50_000


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty.

    Null and empty texts, and texts without letters, are rejected; null declarations and sources
    say nothing; repeated rows stay as they are; an empty table stays empty.
    """
    return accepted_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal but for white space: the smallest id, null ids last.

    Null texts count as empty; of repeated rows one stays.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8): the smallest id.

    Null and empty texts are equal; rows without an id link with nothing and stay, repeated ones once.
    """
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, at least once.

    A null source is a source of its own; null and empty texts have no tokens and go with their
    block; repeated rows share their fate; a corpus without tokens is passed once.
    """
    return mixed_corpus(docs, BYTE_BPE, max_repeats=MAX_REPEATS, cache=CACHE)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every use of a document; null and empty texts have no tokens."""
    return bpe_round_trip(docs, BYTE_BPE, cache=CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("source_mixing", source_mixing),
    ("bpe", bpe),
]

#: Tokenised stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
