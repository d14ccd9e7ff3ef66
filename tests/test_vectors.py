"""Vector search against brute force: exact blocks, the inverted file, pruned late interaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.operators.vectors import CellIndex, LateIndex, exact_topk, late_topk

DATA = "/root/testdata/sf0.1"


def best(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, {})[r.rank] = r.id
    return {q: [ids[k] for k in sorted(ids)] for q, ids in out.items()}


def unit(x):
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-9)


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(ids)) / len(ids) for q, ids in want.items()])


def test_inverted_file(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    rows = v.collect()
    x, ids = unit(np.array([r.v for r in rows], float)), np.array([r.id for r in rows])
    want = {i: ids[np.lexsort((ids, -(x @ x[k]).round(9)))[:10]].tolist() for k, i in enumerate(ids.tolist()) if i % 100 == 0}
    index = CellIndex(v.repartition(5), cells=40)
    assert best(index.search(q, block=100, asked=7).collect()) == want  # all cells, small blocks
    assert best(exact_topk(v, q, block=300, asked=6).collect()) == want
    assert recall(best(index.search(q, probes=28).collect()), want) >= 0.9  # these vectors have nearly no clusters: half of the cells give 0.85
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(50, 24))
    near = (middles[rng.integers(0, 50, 3000)] + 0.4 * rng.normal(size=(3000, 24))).tolist()
    c = spark.createDataFrame(list(enumerate(near)), "id long, v array<double>")
    asked = c.where("id % 60 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    clusters = CellIndex(c)
    assert recall(best(clusters.search(asked, probes=6).collect()), best(exact_topk(c, asked).collect())) >= 0.9
    plan = index.search(q, probes=4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("FlatMapCoGroups") == 1


def clustered(n, tokens, dims, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(60, dims))
    return [(k, (middles[rng.integers(0, 60, size=tokens)] + 0.3 * rng.normal(size=(tokens, dims))).tolist()) for k in range(n)]


def max_sums(docs, queries, k):
    out = {}
    for q, qs in queries:
        score = [(-round(float(sum((unit(np.array(vs)) @ unit(np.array(t))).max() for t in qs)), 9), i) for i, vs in docs]
        out[q] = [i for _, i in sorted(score)[:k]]
    return out


def test_pruned_late_interaction(spark):
    docs, queries = clustered(600, 9, 16, 1), [(f"q{k}", vs[:4]) for k, vs in clustered(25, 6, 16, 2)]
    d, q = spark.createDataFrame(docs, "id long, vs array<array<double>>").repartition(4), spark.createDataFrame(queries, "query_id string, qs array<array<double>>")
    want = max_sums(docs, queries, 10)
    index = LateIndex(d, cells=60, block=150)
    assert index.blocks == 4 and best(index.search(q, asked=9).collect()) == want
    assert best(late_topk(d, q, block=100, asked=4).collect()) == want
    assert recall(best(index.search(q, probes=2).collect()), want) >= 0.9


def test_pruned_late_interaction_on_the_table(spark):
    parts = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    d = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), parts.alias("vs"))
    q = d.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vs").alias("qs"))
    want = best(late_topk(d, q).collect())
    index = LateIndex(d)
    assert best(index.search(q).collect()) == want and recall(best(index.search(q, probes=8).collect()), want) >= 0.9


@pytest.mark.parametrize("probes", [None, 1])
def test_awkward_vectors(spark, probes):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0])], "id long, v array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = best(CellIndex(v).search(q, 3, probes).collect())
    assert got[1][:2] == [1, 2] and set(got) == {1, 2, 7}
    assert CellIndex(v.limit(0)).search(q, 3).count() == 0 and CellIndex(v).search(q.limit(0), 3).count() == 0
    d = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 0.0]]), (3, []), (4, None), (5, [None, [None, 1.0], [1.0], [0.0, 1.0]]), (5, [[0.0, 1.0]])], "id long, vs array<array<double>>")
    asked = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 1.0]]), ("b", []), ("c", None)], "query_id string, qs array<array<double>>")
    found = best(LateIndex(d).search(asked, 3, probes).collect())
    assert found["a"][0] == 1 and set(found) == {"a"}
    assert LateIndex(d.limit(0)).search(asked, 3).count() == 0 and LateIndex(d).search(asked.limit(0)).count() == 0
    whole = late_topk(d, asked, 10).collect()
    assert {(r.id, round(r.score)) for r in whole if r.query_id == "a"} == {(1, 2), (2, 1), (3, 0), (4, 0), (5, 1)}
