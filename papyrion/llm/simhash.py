"""Near duplicates by SimHash fingerprints, compared bit-sliced.

A document's words (ASCII white space apart, A-Z lower-cased) give word shingles, repeats
included; each shingle's XXH64 votes on 64 bits, and a bit is 1 if more than half of the
votes set it.  Fewer words than a shingle: the whole sequence is the only shingle; no words
(null, empty or blank text): fingerprint zero, which is linked like any other.

Equal fingerprints become one class before anything is compared.  Two fingerprints within
``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` bit blocks, so each class
is filed under every choice of that many blocks and only files with a shared key are compared
(``bitslice``); every unit returns a spanning forest of its links, never all pairs.  The
components are those of all links.

Rows without an id have a fingerprint, but link with nothing and get a null component.
Repeated rows each get a row.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.bitslice import near, union
from papyrion.llm.buckets import each_unit, units
from papyrion.llm.rows import NO_ID, id_key, keep_rows, text_key
from papyrion.llm.vocabulary import forget
from papyrion.operators.components import connected_components
from papyrion.workspace import materialize


def fingerprint(text: str | None, words: int = 3, seed: int = 42, step: int = 8192) -> int:
    """The 64-bit fingerprint of a whole text, in memory that doesn't grow beyond the text's words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    n = max(1, len(parts) - words + 1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    del parts
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:n], ends[-n:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, step):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + step].tolist(), last[at : at + step].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            marks = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], names=["id", "k2", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """Written table (id, k2, fp), one row per document."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("k2"), F.col(text_col).cast("string").alias("t"))
    return materialize(named.mapInArrow(_fingerprints(words), "id long, k2 long, fp long"), "fingerprints")


def masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks that must agree within the radius."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for chosen in combinations(part, blocks - radius):
        mask = sum(chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _links(radius: int):
    def work(table: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = table.column("fp").to_numpy().view(np.uint64)
        reps = table.column("rep").to_numpy()
        labels = np.arange(len(codes))
        for i, j in near(codes, low, high, radius):
            union(labels, i, j)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(reps[labels[moved]]), pa.array(reps[moved])], names=["src", "dst"])

    return work


def links(classes: DataFrame, radius: int = 3, blocks: int = 5, block: int = 2048) -> DataFrame:
    """(src, dst) between classes (rep, fp): a spanning forest of each unit's links within the radius."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(blocks, radius))])
    filed = classes.select("rep", "fp", F.inline(keys))
    return units(filed, ["t", "key"], "fp", block).select("t", "key", "__i", "__j", "__side", "fp", "rep").mapInArrow(each_unit(["t", "key"], _links(radius)), "src long, dst long")


def _components(marks: DataFrame, radius: int, blocks: int) -> DataFrame:
    """marks (id, k2, fp) with component."""
    classes = materialize(marks.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    forest = materialize(links(classes, radius, blocks), "links")
    joined = connected_components(forest)
    named = classes.join(joined, classes.rep == joined.vertex, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "named")
    return marks.join(named, "fp", "left").select("id", "k2", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), one row per document."""
    found = _components(fingerprints(docs, id_col, text_col, words), radius, blocks)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Rows without an id stay (repeated ones once).  Of rows that share the component's id one stays.
    """
    found = _components(fingerprints(docs, id_col, text_col, words), radius, blocks)
    return keep_rows(docs, *_first_of_each(found), id_col, text_col)


def _first_of_each(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, kept) of rows (id, k2, component): the component's smallest id, one text of it; rows without an id stay."""
    best = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    keys = materialize(found.groupBy(id_key(F.col("id")).alias("k1"), "k2").agg(F.count("*").alias("n"), F.bool_or(best).alias("best")), "keys")
    named = keys.where(F.col("best") & (F.col("k1") != NO_ID)).groupBy("k1").agg(F.min("k2").alias("k2"))
    return keys, named.unionByName(keys.where(F.col("k1") == NO_ID).select("k1", "k2"))
