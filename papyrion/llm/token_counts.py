"""Exact token counts by an histogram of document lengths.

Each document is encoded once and only its length goes on: lengths are counted map-side and
then as a whole, and running sums over the histogram (in ranges, so that no task holds all
lengths) answer totals, quantiles and totals under truncation for every context limit.

Null and empty texts have length 0.  An empty table gives an empty histogram, zero totals and
null quantiles.  Repeated rows count each time; ids and other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.prefix import running_sums
from papyrion.llm.vocabulary import CACHE, small_groups, token_counter
from papyrion.workspace import materialize


def counter(path: str, limit: int):
    """mapInArrow function that replaces the last column, a text, by its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_counter(path, limit)
        for batch in batches:
            counts = [n for group in small_groups(x.as_py() for x in batch.column(batch.num_columns - 1)) for n in tokens.count(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def document_lengths(docs: DataFrame, path: str, text_col: str = "text", keep: list | None = None, cache: int = CACHE) -> DataFrame:
    """The columns ``keep`` and n_tokens (long), one row per document; a worker remembers the counts of about twice ``cache`` pieces."""
    named = docs.select(*(keep or []), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    return named.mapInArrow(counter(path, cache), f"{schema}{', ' if schema else ''}n_tokens long")


def length_histogram(lengths: DataFrame, width: int = 1024) -> DataFrame:
    """A row per length: n_tokens, n_docs, docs_to, tokens_to, docs_over, docs_from, tokens_from, truncated_total.

    ``docs_to``/``tokens_to`` count documents up to this length, ``docs_over`` longer ones,
    ``docs_from``/``tokens_from`` are the suffix sums (this length and longer), and
    ``truncated_total`` is the corpus size if every document is cut to this length.
    """
    bars = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("n", F.col("n_docs") * F.col("n_tokens"))
    back = bars.withColumns({"__back": -F.col("n_tokens"), "__all": F.lit(0)})
    sums = running_sums(back, ["__all"], "__back", F.floor(F.col("__back") / width), ["n_docs", "n"])
    total = bars.agg(F.sum("n_docs").alias("__docs"), F.sum("n").alias("__tokens"))
    out = sums.join(F.broadcast(total)).select(
        "n_tokens", "n_docs",
        (F.col("__docs") - F.col("n_docs_to") + F.col("n_docs")).alias("docs_to"),
        (F.col("__tokens") - F.col("n_to") + F.col("n")).alias("tokens_to"),
        (F.col("n_docs_to") - F.col("n_docs")).alias("docs_over"),
        F.col("n_docs_to").alias("docs_from"),
        F.col("n_to").alias("tokens_from"),
    )
    return out.withColumn("truncated_total", F.col("tokens_to") + F.col("n_tokens") * F.col("docs_over"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs, tokens, truncated_docs, kept_tokens) for any limits, between the lengths too."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    sums = [F.struct(F.lit(c).alias("context_limit"), F.coalesce(F.sum(d), F.lit(0)).alias("docs"), F.coalesce(F.sum(n * d), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(n > c, d).otherwise(0)), F.lit(0)).alias("truncated_docs"), F.coalesce(F.sum(F.least(n, F.lit(c)) * d), F.lit(0)).alias("kept_tokens")) for c in limits]
    return histogram.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    total = F.col("docs_to") + F.col("docs_over")
    found = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("docs_to") >= F.lit(q) * total, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return histogram.agg(F.array(*found).alias("x")).select(F.inline("x"))


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The length histogram of a corpus with its suffix sums."""
    return length_histogram(document_lengths(docs, path, text_col))
