"""Carry decisions about rows back to the rows themselves without a row id.

A row is known by its id and a 64-bit hash of its whole text.  Rows that agree in both are
repeated rows; the table of keys says how many there are, so the usual key (one row) needs one
anti join with the keys that go, and only repeated rows are regrouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.workspace import materialize

#: Stands for a null id in keys.
NO_ID = -(2**63)
#: Bits that a key sets in a filter, and words of 64 bits that a filter has for each key and in all, so it has 2 MB at most.
HASHES, PER_KEY, MOST_WORDS = 3, 0.25, 1 << 18


def id_key(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def text_key(column: Column) -> Column:
    """XXH64 of the text; null is empty."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def whole(rows: DataFrame) -> Column:
    """All columns of a table as one struct, so that no name of ours meets one of theirs."""
    return F.struct(*columns(rows))


def columns(rows: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in rows.columns]


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of a table has, whatever their case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sieved(rows: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key isn't), by the columns ``names`` of both.

    The filter (Bloom's) is broadcast and its size is bounded, so rows that it tells apart stay where
    they lie however many keys there are; only the others need meet the keys in a join.
    """
    words = 1 << (min(MOST_WORDS, max(64, math.ceil(keys.count() * PER_KEY))) - 1).bit_length()
    (bits,) = fresh(rows, "bits")
    named = ", ".join(map(quoted, names))
    spots = [f"pmod(xxhash64({named}, {k}), {64 * words}L)" for k in range(HASHES)]
    ones = keys.select(F.explode(F.array(*map(F.expr, spots))).alias("s")).select(F.expr("s div 64 AS w"), F.expr("shiftleft(1L, int(s % 64)) AS b"))
    zeros = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    found = ones.unionByName(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    parts = found.groupBy(F.expr("w div 1024").alias("part")).agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"].alias("b"))
    whole_ = parts.agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "b")))["b"]).alias(bits))
    filter_ = F.broadcast(materialize(whole_, "filter"))
    held = F.expr(" AND ".join(f"shiftright(get({bits}, int({s} div 64)), int({s} % 64)) & 1 = 1" for s in spots))
    return rows.join(filter_, held, "left_semi"), rows.join(filter_, held, "left_anti")


def keep_rows(docs: DataFrame, keys: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (k1, k2), all columns, each repeated row once.

    ``keys`` (k1, k2, n) are the keys of all rows.  The keys that go, usually far fewer than
    those that stay, are written; rows that a filter of them lets pass stay where they lie, and
    the others are anti-joined, so texts that stay hardly move.  Of repeated rows that differ in
    other columns any one stays.  The tables may be empty.
    """
    kept = kept.select("k1", "k2")
    many = materialize(keys.where("n > 1").join(kept, ["k1", "k2"], "left_semi").select("k1", "k2"), "many")
    gone = materialize(keys.select("k1", "k2").join(kept, ["k1", "k2"], "left_anti").unionByName(many), "gone")
    if gone.isEmpty():
        return docs.select(*columns(docs))
    a, b = fresh(docs, "k1", "k2")
    keyed = docs.withColumns({a: id_key(F.col(quoted(id_col))), b: text_key(F.col(quoted(text_col)))})
    many, gone = many.toDF(a, b), gone.toDF(a, b)
    some, stay = sieved(keyed, gone, [a, b])
    out = stay.unionByName(some.join(gone, [a, b], "left_anti"))
    if not many.isEmpty():
        out = out.unionByName(sieved(keyed, many, [a, b])[0].join(many, [a, b], "left_semi").dropDuplicates([a, b]))
    return out.select(*columns(docs))
