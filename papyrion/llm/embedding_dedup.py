"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the leading principal directions is learned on a bounded sample (about
``sample`` vectors, chosen by a hash of their ids) so that the signs of the rotated coordinates are balanced and
lose little (ITQ, Gong and Lazebnik 2011).  The 64-bit codes are cut into ``tables`` substrings.
A vector is filed under each of its substrings as it is and with one of its two least certain
bits (the coordinates nearest to zero) turned over; codes that share a key are compared
bit-sliced, and pairs within ``radius`` bits are reranked with the original vectors in double
precision.  All pairs of codes less than ``tables`` bits apart are found, and most of those that
differ in uncertain bits of a substring; a pair is counted only under the first key that it shares.
``tables=64, radius=64`` compares all pairs of a label and is exact.  Large table entries are
cut into blocks and each pair of blocks is a unit of its own.

Equal vectors of a label are one class with a multiplicity, so copies are never paired.  Units
return link counts and a spanning forest, never all pairs.

Vectors link only within a label and with vectors of their own length.  Null labels and vectors
that are null, empty, zero or hold null or non-finite components link with nothing; so do rows
without an id, whose component is null.  Repeated rows are different vectors.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.bitslice import near, union
from papyrion.llm.buckets import each_unit, units
from papyrion.operators.components import connected_components
from papyrion.workspace import materialize

BITS = 64


def learn_rotation(sample: np.ndarray, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): the signs of (x - mean) @ directions are the code of a unit vector x."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    lead = vectors[:, ::-1][:, : min(dims, BITS)]
    projected = centred @ lead
    parts = []
    for _ in range(-(-BITS // lead.shape[1])):
        rotation = np.linalg.qr(rng.normal(size=(lead.shape[1],) * 2))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = (left @ right).T
        parts.append(lead @ rotation)
    return mean, np.concatenate(parts, axis=1)[:, :BITS]


def unit_rows(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors of a list column as unit rows in double precision, cut or padded to ``dims``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dims if dims is not None else (int(sizes.max()) if len(sizes) else 0)
    if len(sizes) and (sizes == width).all():
        rows = flat.reshape(len(sizes), width)
    else:
        rows = np.zeros((len(sizes), width))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k, size in enumerate(sizes):
            rows[k, : min(size, width)] = flat[at[k] : at[k + 1]][:width]
    largest = np.abs(rows).max(axis=1, initial=0, keepdims=True)
    rows = rows / np.where(largest > 0, largest, 1)  # squares can't overflow
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def codes(rows: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    bits = ((rows - mean) @ directions >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def uncertain(rows: np.ndarray, mean: np.ndarray, directions: np.ndarray, tables: int) -> list[np.ndarray]:
    """Two masks for each vector, with the least and the second least certain bit of each table's substring (none, if it has one bit)."""
    margin = np.abs((rows - mean) @ directions)
    out = [np.zeros(len(rows), np.uint64) for _ in range(2)]
    for k in range(tables):
        a, b = BITS * k // tables, BITS * (k + 1) // tables
        order = margin[:, a:b].argsort(axis=1)
        for mask, place in zip(out, order.T, strict=False):
            mask |= np.uint64(1) << (a + place).astype(np.uint64)
    return out


def _coder(mean: np.ndarray, directions: np.ndarray, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column(batch.num_columns - 1), len(mean)) if batch.num_rows else np.zeros((0, len(mean)))
            made = [codes(rows, mean, directions) if batch.num_rows else np.zeros(0, np.uint64), *uncertain(rows, mean, directions, tables)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in made)], names=[*batch.schema.names, "code", "turn1", "turn2"])

    return run


def table_masks(tables: int) -> list[int]:
    cuts = [BITS * k // tables for k in range(tables + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(threshold: float, radius: int, masks: list[int], most: int = 1 << 14):
    own = np.array(masks, np.uint64)

    def work(table: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, one, two = (table.column(c).to_numpy().view(np.uint64) for c in ("code", "turn1", "turn2"))
        rep, many = table.column("rep").to_numpy(), table.column("n").to_numpy()
        which, turned = table.column("t").to_numpy(), table.column("turned").to_numpy()
        rows = unit_rows(table.column("v"))
        labels, found = np.arange(len(code)), np.zeros(len(code), np.int64)
        turns = [np.zeros_like(code), one, two]
        key = (code ^ np.choose(turned, turns)) & own[which]
        for left, right in near(code, low, high, radius, tile=1 << 14):
            for at in range(0, len(left), most):
                i, j = left[at : at + most], right[at : at + most]
                differ, here, t = code[i] ^ code[j], np.arange(len(i)), which[i]
                met, least = np.zeros((len(i), len(own)), bool), np.full(len(i), np.uint64(0xFFFFFFFFFFFFFFFF))
                for mine in turns:  # the keys of i, by table, that are keys of j too
                    both = np.zeros_like(met)
                    for other in turns:
                        both |= ((differ ^ mine[i] ^ other[j])[:, None] & own) == 0
                    met |= both
                    least = np.where(both[here, t], np.minimum(least, (code[i] ^ mine[i]) & own[t]), least)
                first = (met.argmax(axis=1) == t) & (key[i] == key[j]) & (key[i] == least)
                i, j = i[first], j[first]
                linked = np.einsum("ij,ij->i", rows[i], rows[j]) >= threshold
                i, j = i[linked], j[linked]
                np.add.at(found, i, many[j])
                np.add.at(found, j, many[i])
                union(labels, i, j)
        some = np.flatnonzero(found)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rep[some], rep[moved]])), pa.array(np.concatenate([np.full(len(some), None, object), rep[labels[moved]].astype(object)]), pa.int64()), pa.array(np.concatenate([found[some], np.zeros(len(moved), np.int64)]))],
            names=["rep", "to", "links"],
        )

    return work


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, tables: int = 8, radius: int = 26, sample: int = 4096, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # as wide as they are, for the shuffle
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.hash("v", "label")})
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = materialize(classes, "classes")
    share = min(1.0, sample / max(1, classes.count()))
    learned = classes.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 31)) < int(share * (1 << 31))).select("v").toArrow().column(0)
    size = int(np.median([len(x) for x in learned])) if len(learned) else 1
    mean, directions = learn_rotation(unit_rows(learned, size))
    fields = classes.select("rep", "n", "label", "v")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.schema.fields)
    coded = materialize(fields.mapInArrow(_coder(mean, directions, tables), f"{kinds}, code long, turn1 long, turn2 long"), "codes")
    masks = table_masks(tables)
    forms = [F.col("code"), F.col("code").bitwiseXOR(F.col("turn1")), F.col("code").bitwiseXOR(F.col("turn2"))][: 2 if tables == BITS else 3]
    keys = [F.struct(F.lit(t).alias("t"), F.lit(turned).alias("turned"), form.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks) for turned, form in enumerate(forms)]
    filed = coded.withColumn("dims", F.size("v")).select("rep", "n", "label", "dims", "v", "code", "turn1", "turn2", F.inline(F.array(*keys)))
    filed = filed.withColumn("g", F.xxhash64("label", "dims", "t", "key"))  # equal keys of two groups would only add tests
    pieces = units(filed.select("g", "label", "dims", "t", "rep", "n", "code", "turn1", "turn2", "turned", "v"), ["g", "label", "dims", "t"], "rep", block)
    pieces = pieces.withColumn("label", F.xxhash64("label")).select("g", "label", "dims", "t", "__i", "__j", "__side", "rep", "n", "code", "turn1", "turn2", "turned", "v")
    found = materialize(pieces.mapInArrow(each_unit(["g", "label", "dims", "t"], _links(threshold, radius, masks), least=1 << 12), "rep long, to long, links long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("to is not null"), "rep", "to")
    named = classes.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("vertex"), "left")
    named = materialize(named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "named")
    ids = rows.select("id", F.when(F.col("ok"), F.col("h1")).alias("h1"), "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return ids.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
