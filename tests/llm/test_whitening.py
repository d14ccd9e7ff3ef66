"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.llm.whitening import Fit, fixed_rows, whitened_vectors

DATA = "/root/testdata/sf0.01"


def plain(rows, k=4):
    """{id: (n, deviation, whitened up to sign)} and explained, from the formed covariance."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {i: (n, sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True)), (np.array(v) - s / n) @ vectors / np.sqrt(values)) for i, v in x.items()}
    return out, values / np.trace(y.T @ y / n)


def test_against_numpy(spark):
    docs = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    want, explained = plain(rows)
    got = whitened_vectors(docs.repartition(7)).collect()
    assert len(got) == 4 * len(want)
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(4):
        mine, theirs = (np.array([f(i) for i in want]) for f in (lambda i: by[i, c + 1].whitened, lambda i: want[i][2][c]))
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-9
        assert all(abs(by[i, c + 1].explained / explained[c] - 1) < 1e-9 for i in want)
    assert all((by[i, 1].n, by[i, 1].deviation) == want[i][:2] for i in want)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("dims", [3, 200])
def test_restarts_and_small_dimensions(spark, dims):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(400)]
    fit = Fit(fixed_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), k=4, extra=4, blocks=5)
    _, explained = plain(rows, 4)
    assert fit.residual <= 1e-13 and np.allclose(fit.values / fit.trace, explained, rtol=1e-10) and len(fit.values) == min(4, dims)


def test_awkward_rows(spark):
    schema = "vec_id long, embedding array<double>, x int, id string"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [0.5, 0.25]), (6, [0.5, 0.25]), (None, [0.0, -0.001]), (8, [1.0, 2.0, 3.0]), (9, [])]
    got = whitened_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 2, 3), (6, 1, 3), (6, 1, 3), (6, 2, 3), (6, 2, 3)]
    assert {r.deviation for r in got if r.vec_id is None} == {sum((3 * a - s) ** 2 for a, s in zip((0, -1), (256 + 128 + 0, 0 + 64 - 1), strict=True))}
    one = spark.createDataFrame([(*r, 1, "x") for r in [(1, [1.0, 0.0])] * 3], schema)
    assert whitened_vectors(one).collect() == [] and whitened_vectors(one.limit(0)).collect() == [] and whitened_vectors(one.withColumn("embedding", F.array().cast("array<double>"))).collect() == []
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 1, "x") for k in range(20)], schema)
    assert {r.component for r in whitened_vectors(flat).collect()} == {1}
    huge = spark.createDataFrame([(k, [float(k) * 1e9, 1.0], 1, "x") for k in range(20)], schema)
    assert {r.deviation for r in whitened_vectors(huge).collect() if r.vec_id == 0} == {None}
