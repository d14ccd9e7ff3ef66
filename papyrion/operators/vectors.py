"""Vector search by blocks: exact products, an inverted file for dense vectors, pruned late interaction.

Two tables meet in units: each side of a group is dealt into blocks of bounded size by a hash of
its ids, each row goes to the units of its block, and a unit (two blocks) is one cogrouped task.
A unit keeps k rows for each of its queries, and a ranking by query takes the best of these.  No
query or vector passes the driver; it holds centroids, whose number is a parameter, and the
bounded sample that they are learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.workspace import Table, materialize

#: Rows of a block of vectors and of queries.
BLOCK, ASKED = 8192, 1024
#: Cells of an index at most, and rows of the sample for each.
MOST_CELLS, SAMPLE = 4096, 64


def best_by_query(scored: DataFrame, k: int) -> DataFrame:
    """scored (query_id, id, score) with rank, the k best of each query; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def meet(left: DataFrame, right: DataFrame, group: list[str], ids: tuple[str, str], sizes: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(left block, right block)`` for all pairs of blocks of a group; both sides are written tables.

    A group of n rows is dealt into ceil(n / size) blocks.  The counts by group are written, so
    they are broadcast only while they are small.
    """
    def dealt(rows: DataFrame, id_col: str, own: str, other: str, first: bool) -> DataFrame:
        here = F.pmod(F.xxhash64(id_col), F.col(own)).cast("int")
        there = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        both = rows.join(counts, group).withColumn("__here", here).withColumn("__there", there)
        names = ("__i", "__j") if first else ("__j", "__i")
        return both.withColumnsRenamed(dict(zip(("__here", "__there"), names, strict=True))).drop("__l", "__r")

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        return rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    counts = materialize(blocks(left, "__l", sizes[0]).join(blocks(right, "__r", sizes[1]), group), "blocks")
    keys = [*group, "__i", "__j"]
    a, b = dealt(left, ids[0], "__l", "__r", True), dealt(right, ids[1], "__r", "__l", False)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: work(x.combine_chunks(), y.combine_chunks()), schema)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their norm plus 1e-9."""
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return unit(flat(column)[0].reshape(-1, dims)) if len(column) and dims else np.zeros((0, dims))


def _top(order: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row of scores; ties by ``order``."""
    rounded = scores.round(9)
    if len(order) > 4 * k:  # sort only what can be among them
        least = np.partition(rounded, len(order) - k)[len(order) - k]
        some = np.flatnonzero(rounded >= least)
        return some[np.lexsort((order[some], -rounded[some]))[:k]]
    return np.lexsort((order, -rounded))[:k]


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order, whatever their type."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _schema(queries: DataFrame, rows: DataFrame) -> str:
    return f"query_id {_kind(queries, 'query_id')}, id {_kind(rows, 'id')}, score double"


def _scored(asked: pa.ChunkedArray, ids: pa.ChunkedArray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of (place of a query, places of its ids, scores)."""
    q = np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)
    at = np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in found)])
    return pa.table({"query_id": asked.take(pa.array(q)), "id": ids.take(pa.array(at)), "score": pa.array(np.concatenate([np.zeros(0), *(s for _, _, s in found)]))})


def _best_products(dims: int, k: int):
    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            order = _order(vectors["id"])
            for q, row in enumerate(matrix(queries["q"], dims) @ matrix(vectors["v"], dims).T):
                at = _top(order, row, k)
                found.append((q, at, row[at]))
        return _scored(queries["query_id"], vectors["id"], found)

    return work


def complete(column: str, dims: int) -> Column:
    """Whether a vector has this length and no null or non-finite component."""
    v = F.col(column)
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def usual_size(rows: DataFrame, column: str) -> int:
    """The most frequent length of a vector column (the longest of equally frequent ones); 0 without any."""
    found = rows.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return found[0]["n"] if found else 0


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors (id, v) by cosine of each query (query_id, q), by products of blocks.

    Vectors and queries of another length than most queries have, or with null or non-finite components, meet nothing.
    """
    q = materialize(queries.select("query_id", "q"), "queries")
    dims = usual_size(q, "q")
    v = materialize(vectors.select("id", "v").where(complete("v", dims)).withColumn("g", F.lit(0)), "vectors")
    q = q.where(complete("q", dims)).withColumn("g", F.lit(0))
    return best_by_query(meet(v, q, ["g"], ("id", "query_id"), (block, asked), _best_products(dims, k), _schema(q, v)), k)


# Centroids


def centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Unit centroids of a sample of unit vectors by spherical k-means; cells that lose all rows start again at far rows."""
    rng = np.random.default_rng(seed)
    out = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds if len(out) else 0):
        scores = sample @ out.T
        at = scores.argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, at, sample)
        empty = np.bincount(at, minlength=len(out)) == 0
        sums[empty] = sample[scores.max(axis=1).argsort()[: empty.sum()]]
        out = unit(sums)
    return out


def sampled(rows: DataFrame, n: int, most: int, order: Column, column: str, dims: int) -> np.ndarray:
    """About ``most`` of ``n`` rows' vectors, chosen by a hash, as unit rows on the driver."""
    share = min(1.0, 1.2 * most / max(1, n))
    found = rows.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).select(column).limit(2 * most).toArrow()
    return matrix(found.column(0), dims)


class CellIndex:
    """An inverted file: vectors (id, v) in a table partitioned by the cell of their nearest centroid.

    The number of cells is about the square root of that of the vectors, at most ``MOST_CELLS``.
    Centroids come from a sample of about ``SAMPLE`` rows for each; all rows are filed.  Vectors
    of another length than most, or with null or non-finite components, are left out.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None):
        rows = vectors.select("id", "v")
        self.dims = usual_size(rows, "v")
        rows = rows.where(complete("v", self.dims))
        n = rows.count()
        cells = cells or max(1, min(MOST_CELLS, int(n**0.5)))
        self.centroids = centroids(sampled(rows, n, SAMPLE * cells, F.xxhash64("id", F.lit(7)), "v", self.dims), cells)
        filed = rows.mapInArrow(self._nearest(1), f"id {_kind(rows, 'id')}, v {_kind(rows, 'v')}, cell int")
        self.table = Table(filed.hint("rebalance", "cell"), "cells", partition_by=["cell"])

    def _nearest(self, probes: int):
        """mapInArrow function that adds a row's nearest cells (a row for each)."""
        middles, dims = self.centroids, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = matrix(batch.column(1), dims) @ middles.T
                most = min(probes, len(middles))
                cells = scores.argmax(axis=1)[:, None] if most == 1 else np.argpartition(-scores, most - 1, axis=1)[:, :most]
                at = pa.array(np.repeat(np.arange(batch.num_rows), most))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(cells.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

        return run

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, q) from the ``probes`` cells nearest to each; from all cells the result is exact.

        Only the probed cells' folders are read, once for all queries.
        """
        q = queries.select("query_id", "q").where(complete("q", self.dims))
        routed = materialize(q.mapInArrow(self._nearest(probes or len(self.centroids)), f"query_id {_kind(q, 'query_id')}, q {_kind(q, 'q')}, cell int") if len(self.centroids) else q.withColumn("cell", F.lit(0)), "routed")
        cells = [r[0] for r in routed.select("cell").distinct().collect()]  # at most the number of centroids
        found = meet(self.table.df.where(F.col("cell").isin(cells)), routed, ["cell"], ("id", "query_id"), (block, asked), _best_products(self.dims, k), _schema(routed, self.table.df))
        return best_by_query(found, k)


# Late interaction: documents and queries are arrays of token vectors


def _tokens(column: pa.ChunkedArray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """Token vectors of a column by their length: (unit rows, the row that each belongs to); and the number of rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    inner = lists.flatten()
    values, sizes = flat(inner)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = (unit(values[begin[at][:, None] + np.arange(size)]), owner[at])
    return out, len(lists)


def max_by_owner(scores: np.ndarray, owner: np.ndarray, n: int, empty: float) -> np.ndarray:
    """Largest score by row and owner, owners ascending; ``empty`` where an owner has none."""
    out = np.full((len(scores), n), empty)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[:, owner[first]] = np.maximum.reduceat(scores, first, axis=1)
    return out


def _best_sums(k: int):
    def work(docs: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if docs.num_rows and queries.num_rows:
            order = _order(docs["id"])
            theirs, n = _tokens(docs["vs"])
            ours, m = _tokens(queries["qs"])
            for q in range(m):
                total = np.zeros(n)
                for size, (rows, owner) in ours.items():
                    if size in theirs:
                        total += max_by_owner(rows[owner == q] @ theirs[size][0].T, theirs[size][1], n, 0.0).sum(axis=0)
                at = _top(order, total, k)
                found.append((q, at, total[at]))
        return _scored(queries["query_id"], docs["id"], found)

    return work


def token_arrays(column: str) -> Column:
    """An array of token vectors without those that are null, empty or hold nulls; null is empty."""
    good = F.filter(column, lambda v: v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull()))
    return F.coalesce(good, F.filter(F.array(), lambda _: F.lit(True)).cast("array<array<double>>")).cast("array<array<double>>")


def late_topk(docs: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024, asked: int = 64) -> DataFrame:
    """(query_id, id, score, rank) by the sum over a query's vectors of the best cosine among a document's, exactly, by blocks.

    docs (id, vs), queries (query_id, qs).  A document without vectors of a query vector's length adds nothing for it.
    """
    d = materialize(docs.select("id", token_arrays("vs").alias("vs"), F.lit(0).alias("g")), "docs")
    q = materialize(queries.select("query_id", token_arrays("qs").alias("qs"), F.lit(0).alias("g")), "queries")
    return best_by_query(meet(d, q, ["g"], ("id", "query_id"), (block, asked), _best_sums(k), _schema(q, d)), k)


class LateIndex:
    """Late interaction with pruning: token vectors filed under centroids with residual codes, in blocks of documents.

    For each token of a document the index has its centroid, its residual in a byte for each
    dimension, the residual's length, and the error that the bytes leave.  A search goes to the
    documents with tokens in the ``probes`` cells nearest to each query token.  Centroid scores
    give bounds on each document's sum (a token is no farther from its centroid than its residual
    is long); documents whose upper bound is below the k-th best lower bound go; the bytes narrow
    the bounds of the others, and what is left is scored with the original vectors.  The bounds use all
    tokens of a document and always hold, so only documents that no query token's cells lead to can
    be missed, and with all cells probed the result is exact.

    Documents without token vectors of the usual length aren't in the index; query vectors of other lengths are ignored.
    """

    def __init__(self, docs: DataFrame, cells: int | None = None, block: int = 4096):
        rows = docs.select("id", token_arrays("vs").alias("vs"))
        tokens = rows.select("id", F.posexplode("vs").alias("pos", "v"))
        self.dims = usual_size(tokens, "v")
        fits = complete("v", self.dims)
        n = tokens.where(fits).count()
        cells = cells or max(1, min(MOST_CELLS, int(n**0.5)))
        self.centroids = centroids(sampled(tokens.where(fits), n, SAMPLE * cells, F.xxhash64("id", "pos"), "v", self.dims), cells)
        whole = F.filter("vs", lambda v: (F.size(v) == self.dims) & F.forall(v, lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
        rows = rows.withColumn("vs", whole).where(F.size("vs") > 0)
        many = max(1, -(-rows.count() // block))
        coded = rows.mapInArrow(self._coder(), f"id {_kind(rows, 'id')}, vs array<array<double>>, cells array<int>, far array<double>, scale array<double>, err array<double>, code binary")
        self.table = Table(coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).repartition("block"), "late", partition_by=["block"])
        self.blocks = many

    def _coder(self):
        middles, dims = self.centroids, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    vectors = unit(flat(batch.column(1).flatten())[0].reshape(-1, dims))
                    sizes = np.diff(batch.column(1).offsets.to_numpy())
                    cell = (vectors @ middles.T).argmax(axis=1)
                    rest = vectors - middles[cell]
                    scale = np.abs(rest).max(axis=1) / 127 + 1e-300
                    code = np.rint(rest / scale[:, None]).astype(np.int8)
                    err = np.linalg.norm(rest - code * scale[:, None], axis=1)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (cell.astype(np.int32), np.linalg.norm(rest, axis=1), scale, err)]
                    ends = np.cumsum(sizes)
                    bytes_ = pa.array([code[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, bytes_], names=["id", "vs", "cells", "far", "scale", "err", "code"])

        return run

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, asked: int = 256) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, qs); exact if all cells are probed."""
        q = materialize(queries.select("query_id", token_arrays("qs").alias("qs")), "queries")
        q = materialize(q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))), "routed")
        found = meet(self.table.df, q, ["block"], ("id", "query_id"), (1 << 30, asked), self._pruned(k, probes), _schema(q, self.table.df))
        return best_by_query(found, k)

    def _pruned(self, k: int, probes: int | None):
        middles, dims = self.centroids, self.dims
        most = min(probes or len(middles), len(middles))

        def work(docs: pa.Table, queries: pa.Table) -> pa.Table:
            if not docs.num_rows or not queries.num_rows or not most:
                return _scored(queries["query_id"], docs["id"], [])
            order = _order(docs["id"])
            sizes = np.diff(docs["cells"].combine_chunks().offsets.to_numpy())
            owner = np.repeat(np.arange(len(order)), sizes)
            cells, far, scale, err = (docs[c].combine_chunks().flatten().to_numpy() for c in ("cells", "far", "scale", "err"))
            code = np.frombuffer(b"".join(docs["code"].to_pylist()), np.int8).reshape(-1, dims)
            values = flat(docs["vs"].combine_chunks().flatten())[0].reshape(-1, dims)
            ours, m = _tokens(queries["qs"])
            rows, mine = ours.get(dims, (np.zeros((0, dims)), np.zeros(0, np.int64)))
            found = []
            for q in range(m):
                asked = rows[mine == q]
                if not len(asked):
                    continue
                scores = asked @ middles.T
                probed = np.ones_like(scores, bool)
                if most < len(middles):
                    probed = scores >= np.partition(scores, len(middles) - most, axis=1)[:, [len(middles) - most]]
                met = np.flatnonzero(np.bincount(owner[probed.any(axis=0)[cells]], minlength=len(order)))

                def bounds(low: np.ndarray, high: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
                    return tuple(max_by_owner(x, of, n, -np.inf).sum(axis=0) for x in (low, high))

                def kept(some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    if len(some) <= k:
                        return some
                    return some[high >= np.partition(low, len(low) - k)[len(low) - k] - 1e-8]  # above what rounding to nine digits moves

                def part(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    at = np.flatnonzero(np.isin(owner, some))
                    return at, np.searchsorted(some, owner[at])

                at, of = part(met)
                near = scores[:, cells[at]]
                met = kept(met, *bounds(near - far[at], near + far[at], of, len(met)))
                at, of = part(met)
                near = scores[:, cells[at]] + asked @ (code[at] * scale[at][:, None]).T
                met = kept(met, *bounds(near - err[at], near + err[at], of, len(met)))
                at, of = part(met)
                total = max_by_owner(asked @ unit(values[at]).T, of, len(met), 0.0).sum(axis=0)
                best = _top(order[met], total, k)
                found.append((q, met[best], total[best]))
            return _scored(queries["query_id"], docs["id"], found)

        return work
