"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's ``approx_top_k`` sketch, merged in two levels) proposes the
digests that many rows share.  Their exact counts and winners are verified by a map-side
combined aggregation, and these at most ``heavy`` rows are broadcast: rows of a heavy digest
are settled without a shuffle.  No remaining digest can hold more than about
``3.5 / tracked`` of the rows, so they are dealt by digest and ranked in a window.

Texts are equal when identical after each run of ASCII white space becomes one space; null
counts as empty.  Of equal texts the smallest id stays (null ids come last); of repeated rows
one stays.  An empty table gives an empty result.  Extra columns of the input are ignored by
``exact_dedup`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.rows import id_key, keep_rows, text_key
from papyrion.workspace import materialize

#: White-space runs other than one plain space; that one would be replaced by itself.
RUNS = r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"


def normalized(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table (rid, id, k2, digest): one row per document; rid orders repeated rows."""
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).cast("long").alias("id"),
            text_key(F.col(text_col)).alias("k2"),
            F.unhex(F.sha2(normalized(F.col(text_col)), 256)).alias("digest"),
        ),
        "digests",
    )


def heavy_digests(rows: DataFrame, heavy: int, tracked: int, shards: int = 64) -> DataFrame:
    """At most ``heavy`` candidate digests, by a Misra-Gries summary that is merged by shard and then as a whole."""
    named = rows.select(F.hex("digest").alias("d"), F.pmod(F.spark_partition_id(), F.lit(shards)).alias("shard"))
    by_shard = named.groupBy("shard").agg(F.expr(f"approx_top_k_accumulate(d, {tracked})").alias("s"))
    top = by_shard.groupBy(F.col("shard") < 0).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {heavy})").alias("top"))
    return top.select(F.explode("top").alias("x")).where("x.count > 1").select(F.unhex("x.item").alias("digest"))


def _ranked(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """rows with keep_id, group_size and first (this row stays)."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
    candidates = heavy_digests(rows, heavy, tracked)
    winners = materialize(
        rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("w"), F.count("*").alias("group_size")),
        "winners",
    )
    settled = rows.join(F.broadcast(winners), "digest").select("rid", "id", "k2", "digest", F.col("w.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("w.rid")).alias("kept"))
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.select("*", F.min(order).over(group).alias("w"), F.count("*").over(group).alias("group_size"))
    return settled.unionByName(rest.select("rid", "id", "k2", "digest", F.col("w.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("w.rid")).alias("kept")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000, tracked: int = 2048) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per document."""
    rows = _ranked(digests(docs, id_col, text_col), heavy, tracked)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000, tracked: int = 2048) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = _ranked(digests(docs, id_col, text_col), heavy, tracked)
    keys = rows.groupBy(id_key(F.col("id")).alias("k1"), "k2").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    keys = materialize(keys, "keys")
    return keep_rows(docs, keys, keys.where("kept"), id_col, text_col)
