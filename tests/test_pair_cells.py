"""Pairs by cells against all pairs."""

import random

import pytest

from papyrion.operators import dependencies


def made(seed=5):
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(3)}", k, f"t{rng.randrange(6)}") for k in range(60) for _ in range(rng.randrange(1, 4))]
    return rows + rows[:5] + [("p0", 99, None), (None, 98, "t1"), ("p0", None, "t1")]


def brute(rows):
    good = {r for r in rows if None not in r}
    return {(p, a, b) for p, a, s in good for q, b, t in good if p == q and s == t and a < b}


@pytest.mark.parametrize("cell", [2, 1000])
def test_overlap_pairs_once_and_whole(spark, monkeypatch, cell):
    monkeypatch.setattr(dependencies, "CELL", cell)
    rows = made()
    terms = spark.createDataFrame(rows, "paper string, artifact long, term string")
    found = [tuple(r) for r in dependencies.overlap_pairs(terms).collect()]
    assert sorted(found) == sorted(brute(rows))
    edges = [(a, a + s) for a in range(60) for s in (1, 5, -1, 0)] + [(None, 3), (3, 999)]
    new = dependencies.new_overlap_pairs(terms, spark.createDataFrame(edges, "source long, target long"))
    assert sorted(tuple(r) for r in new.collect()) == sorted(p for p in brute(rows) if p[1:] not in edges)


def test_subword_pairs_of_cells(spark):
    rows = [("p", 1, "a b"), ("p", 2, "b"), ("p", 3, "b"), ("p", 1, "b"), ("q", 4, "a b c"), ("p", 5, "c"), ("p", 6, "b c"), ("p", 7, None)]
    found = dependencies.subword_pairs(spark.createDataFrame(rows, "paper string, artifact long, term string"))
    assert sorted(tuple(r) for r in found.collect()) == [("p", 1, 2), ("p", 1, 3), ("p", 1, 6), ("p", 2, 6), ("p", 3, 6), ("p", 5, 6)]


@pytest.mark.parametrize("pairs", [dependencies.overlap_pairs, dependencies.subword_pairs])
def test_pairs_are_not_shuffled(spark, pairs):
    plan = pairs(spark.createDataFrame(made(), "paper string, artifact long, term string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" not in plan[: plan.index("Generate")] and "Join" not in plan[: plan.index("Generate")]


def known_pairs(terms):
    return dependencies.new_overlap_pairs(terms, terms.selectExpr("artifact AS source", "artifact + 1 AS target"))


@pytest.mark.parametrize("pairs", [dependencies.overlap_pairs, dependencies.subword_pairs, known_pairs])
def test_a_task_holds_the_pairs_of_one_artifact_with_a_cell(spark, pairs):
    """Generators in one loop would hold a cell's members times another's."""
    plan = pairs(spark.createDataFrame(made(), "paper string, artifact long, term string"))._jdf.queryExecution().executedPlan().toString()
    inner, outer = plan.index("Generate explode(right"), plan.index("Generate explode(left")
    assert "Coalesce" in plan[inner:outer]
