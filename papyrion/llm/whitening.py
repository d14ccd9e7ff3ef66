"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors are read in fixed point (x = floor(256 c), as long), so sums and deviations are exact.
The fit list holds each different x once.  Its covariance is never formed: each Spark pass over
the written list computes Yᵀ(YQ) for the centred rows Y and a block Q of a few columns, task by
task, and Spark adds the tasks' small products up.  On the driver, QR keeps the block orthonormal
and Rayleigh-Ritz reads eigenvalues off the span of the blocks seen since the last restart; the
next block is made of the residuals, and a full basis restarts from the Ritz vectors.  The
iteration ends only when a fresh pass over the Ritz vectors certifies all k components: each
residual at most ``tolerance`` times the largest eigenvalue.

What the driver and each task hold is bounded by the dimension times the basis (``blocks`` blocks
of k + ``extra`` columns), not by the rows.

Rows whose vector is null or holds null or non-finite entries are dropped; so are vectors that
haven't the most frequent length (the longest of equally frequent ones).  Components without
variance (up to 1e-12 of the trace) are left out, so a fit list of one vector, of empty vectors, or none
gives no rows.  Repeated rows are rows of their own in the result and one in the fit list.  A
deviation beyond the range of a long is null.  Null ids are kept, other columns are ignored.
Equal eigenvalues have any basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.workspace import Table

SCALE = 256
LONGEST = 2**63


def fixed_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors in fixed point, without those that have null or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows of int64."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dims)


def _summed(rows: DataFrame, kind: str, work: Callable[[pa.Array, np.ndarray | None], np.ndarray]) -> np.ndarray:
    """The sum over all batches of arrays of one size; a row for each element and task is added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = work(batch.column(0), total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], names=["i", "v"])

    found = rows.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows, np.int64 if kind == "long" else np.float64)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


class Fit:
    """Moments and leading components of the different x vectors of a written list."""

    def __init__(self, fixed: DataFrame, k: int = 4, extra: int = 12, blocks: int = 8, tolerance: float = 1e-13, most: int = 1000):
        sizes = fixed.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
        self.dims = dims = sizes[0]["size"] if sizes else 0
        self.rows = fixed.where(F.size("x") == dims)
        self.list = Table(self.rows.select("x").distinct(), "fit")
        self.passes = 0

        def sums(column: pa.Array, total: np.ndarray | None) -> np.ndarray:
            x = matrix(column, dims)
            one = np.concatenate([[len(x)], x.sum(axis=0)])
            return one if total is None else total + one

        first = _summed(self.list.df, "long", sums) if dims else np.zeros(1, np.int64)
        self.n, self.sums = (int(first[0]), first[1:]) if len(first) else (0, np.zeros(dims, np.int64))
        largest = self.list.df.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0] if self.n and dims else 0
        self.largest = int(largest or 0)
        self.mean = self.sums / max(1, self.n)
        self.values, self.vectors, self.trace, self.residual = np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0
        if self.n > 1 and dims:
            self._iterate(k, extra, blocks, tolerance, most)
        self.error = self._identity_error() if len(self.values) else 0.0

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q for a block q, by one pass over the list; the trace of V comes along."""
        dims, mean = self.dims, self.mean

        def work(column: pa.Array, total: np.ndarray | None) -> np.ndarray:
            y = matrix(column, dims) - mean
            one = np.concatenate([(y.T @ (y @ q)).ravel(), [np.einsum("ij,ij->", y, y)]])
            return one if total is None else total + one

        found = _summed(self.list.df, "double", work) / self.n
        self.passes += 1
        self.trace = float(found[-1])
        return found[:-1].reshape(q.shape)

    def _iterate(self, k: int, extra: int, blocks: int, tolerance: float, most: int) -> None:
        k = min(k, self.dims)
        width = min(self.dims, k + extra)
        block = np.linalg.qr(np.random.default_rng(0).normal(size=(self.dims, width)))[0]
        basis = images = np.zeros((self.dims, 0))
        while True:
            if self.passes >= most:
                raise RuntimeError(f"no certified components after {most} passes; the residual is {self.residual:g} of the largest eigenvalue")
            fresh = basis.shape[1] == 0
            basis, images = np.hstack([basis, block]), np.hstack([images, self.product(block)])
            small = basis.T @ images
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
            ritz, image = basis @ turn, images @ turn
            if self.trace <= 0 or values[0] <= 0:
                return
            residuals = image - ritz * values
            self.residual = float(np.linalg.norm(residuals[:, :k], axis=0).max() / values[0])
            if self.residual <= tolerance:
                if fresh:  # one block and its image of this very pass: the certificate
                    kept = values[:k] > 1e-12 * self.trace
                    self.values, self.vectors = values[:k][kept], ritz[:, :k][:, kept]
                    return
                block, basis, images = np.linalg.qr(ritz)[0], np.zeros((self.dims, 0)), np.zeros((self.dims, 0))
                continue
            left = residuals
            for _ in range(2):
                left = left - basis @ (basis.T @ left)
            left = left[:, np.linalg.norm(left, axis=0) > 1e-14 * values[0]]
            if left.shape[1]:
                q, r = np.linalg.qr(left)
                q = q[:, np.abs(np.diag(r)) > 1e-14 * values[0]]
                q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
                left = q[:, : max(0, min(self.dims, blocks * width) - basis.shape[1])]
            if left.shape[1]:
                block = left
            else:  # the basis is full, or holds the space: restart from the Ritz vectors
                block, basis, images = np.linalg.qr(ritz)[0], np.zeros((self.dims, 0)), np.zeros((self.dims, 0))

    def _whitener(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def _identity_error(self) -> float:
        """Largest absolute entry of the covariance of the whitened list less the identity."""
        dims, mean, turn = self.dims, self.mean, self._whitener()

        def work(column: pa.Array, total: np.ndarray | None) -> np.ndarray:
            w = (matrix(column, dims) - mean) @ turn
            one = np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
            return one if total is None else total + one

        k = turn.shape[1]
        found = _summed(self.list.df, "double", work) / self.n
        square, mean_w = found[: k * k].reshape(k, k), found[k * k :]
        return float(np.abs(square - np.outer(mean_w, mean_w) - np.eye(k)).max())

    def apply(self) -> DataFrame:
        """(id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
        dims, mean, turn, n, sums, k = self.dims, self.mean, self._whitener(), self.n, self.sums, len(self.values)
        explained, error = self.values / (self.trace or 1.0), self.error
        exact = self.dims * (self.n * self.largest + int(np.abs(sums).max(initial=0))) ** 2 < LONGEST

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), dims)
                far = n * x - sums if exact else n * x.astype(object) - sums.astype(object)
                deviation = (far * far).sum(axis=1)
                deviation = pa.array([v if v < LONGEST else None for v in deviation.tolist()], pa.int64())
                white = (x - mean) @ turn
                rows, m = np.repeat(np.arange(len(x)), k), len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), deviation.take(pa.array(rows)),
                     pa.array(white.ravel()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        kind = self.rows.schema["id"].dataType.simpleString()
        return (self.rows if k else self.rows.limit(0)).mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened_vectors(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): the k leading whitened coordinates of every vector."""
    return Fit(fixed_rows(vectors, id_col, vector_col), k).apply().withColumnRenamed("id", id_col)
