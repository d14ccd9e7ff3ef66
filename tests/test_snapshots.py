"""Commits of papers: what readers see before, between and after them."""

import pytest
from pyspark.sql import functions as F

from papyrion.operators.snapshots import Snapshots, persist_results

TABLES = {"artifacts": "paper string, id string, content string", "states": "paper string, stage string"}


def seen(store, table="artifacts", at=None):
    return sorted(map(tuple, store.read(table, at).collect()))


def rows(spark, *values):
    return spark.createDataFrame(list(values), TABLES["artifacts"])


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "papers"), TABLES)


def test_only_commits_are_seen(spark, store):
    papers = spark.createDataFrame([("p",), ("q",), (None,)], "paper string")
    assert seen(store) == [] and store.commits() == []
    store.write(papers, {"artifacts": rows(spark, ("p", "1", "old"), ("q", "1", "old"), (None, "1", "x"))})
    staged = store.stage(papers.where("paper = 'p'"), {"artifacts": rows(spark, ("p", "2", "new"))})
    assert seen(store) == [("p", "1", "old"), ("q", "1", "old")]  # a task or driver that dies here leaves the old rows
    assert store.commit(staged) == 1
    assert seen(store) == [("p", "2", "new"), ("q", "1", "old")] and seen(store, at=0) == [("p", "1", "old"), ("q", "1", "old")]
    store.write(papers.where("paper = 'q'"), {"artifacts": rows(spark).limit(0)})
    assert seen(store) == [("p", "2", "new")]  # a paper whose new version has no rows


def test_failing_task_leaves_the_old_rows(spark, store):
    papers = spark.createDataFrame([("p",)], "paper string")
    store.write(papers, {"artifacts": rows(spark, ("p", "1", "old"))})
    broken = rows(spark, ("p", "1", "new"), ("p", "2", "new")).withColumn("content", F.when(F.col("id") == "2", F.raise_error(F.lit("lost executor"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost executor"):
        store.write(papers, {"artifacts": broken})
    assert seen(store) == [("p", "1", "old")] and len(store.commits()) == 1
    assert store.vacuum() == 1 and seen(store) == [("p", "1", "old")]


def test_two_writers(spark, store):
    other = Snapshots(spark, store.root, TABLES)
    a, b = (store.stage(spark.createDataFrame([(p,)], "paper string"), {"artifacts": rows(spark, (p, "1", p))}) for p in "ab")
    before = other.commits
    other.commits = lambda at=None: before(at) if at is not None else []  # it listed the records before the other's commit
    assert store.commit(a) == 0 and other.commit(b) == 1
    assert seen(store) == [("a", "1", "a"), ("b", "1", "b")]


def test_compaction_and_vacuum(spark, store):
    for k in range(4):
        store.write(spark.createDataFrame([("p",), (f"q{k}",)], "paper string"), {"artifacts": rows(spark, ("p", str(k), "x"), (f"q{k}", "1", "y"))})
    want = seen(store)
    assert store.compact() == 4 and [r["full"] for _, r in store.commits()] == [True] and seen(store) == want
    assert store.vacuum() == 4 and seen(store) == want
    store.write(spark.createDataFrame([("p",)], "paper string"), {"artifacts": rows(spark, ("p", "9", "z"))})
    assert [r for r in seen(store) if r[0] == "p"] == [("p", "9", "z")] and len(seen(store)) == len(want)


def test_results_and_failures(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "papers"))
    kinds = "paper string, error string, n_definitions int, n_terms int"
    artifacts = spark.createDataFrame([("p", "1", "lemma", "a", 1), ("p", "1", "lemma", "b", 2), ("q", "1", "lemma", "c", 1)], "paper string, id string, kind string, content string, ord int")
    edges = artifacts.limit(0).selectExpr("paper", "kind AS edge_kind", "id AS source", "id AS target", "ord")
    new = {"artifacts": artifacts, "edges": edges, "definitions": spark.createDataFrame([("p", "t", "x"), ("q", "t", "x")], "paper string, term string, text string")}
    results = spark.createDataFrame([("p", None, 1, 1), ("q", None, 1, None), ("r", "no source", 1, 1), ("s", None, 1, 1)], kinds)
    assert persist_results(store, results, new, "defs") == (0, 1)
    assert seen(store) == [("p", "1", "lemma", "b")] and seen(store, "definitions") == [("p", "t", "x")]
    assert [(r[0], r[2], r[4]) for r in seen(store, "states")] == [("p", "complete", None), ("q", "failed", "no term map"), ("r", "failed", "no source"), ("s", "failed", "empty graph")]
    assert [r[0] for r in seen(store, "states", at=0)] == ["p"]
    broken = new | {"artifacts": artifacts.withColumn("content", F.raise_error(F.lit("broken off")))}
    with pytest.raises(Exception, match="broken off"):
        persist_results(store, results, broken, "defs")
    assert seen(store) == [("p", "1", "lemma", "b")]
    states = {r[0]: r[2:] for r in seen(store, "states")}
    assert states["p"][:2] == ("failed", 2) and "broken off" in states["p"][2]
    persist_results(store, results.where("paper = 'q'"), new, "graph")
    assert seen(store) == [("p", "1", "lemma", "b"), ("q", "1", "lemma", "c")] and seen(store, "definitions") == [("p", "t", "x")]


def test_paper_that_lost_all_statements(spark):
    from papyrion.operators.store import put_artifacts

    old = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "paper string, id string")
    new = spark.createDataFrame([("q", "2", 1)], "paper string, id string, ord int")
    written = spark.createDataFrame([("p",), ("q",)], "paper string")
    assert sorted(map(tuple, put_artifacts(old, new, "ord", True, written).collect())) == [("q", "2"), ("r", "1")]
    assert sorted(map(tuple, put_artifacts(old, new, "ord", True).collect())) == [("p", "1"), ("q", "2"), ("r", "1")]


def test_results_of_a_batch_are_computed_once(spark, tmp_path):
    store, count = Snapshots(spark, str(tmp_path / "papers")), spark.sparkContext.accumulator(0)

    def counted(row):
        count.add(1)
        return row

    plain = spark.createDataFrame([("p", None, 1, 1), ("q", "broken", 1, 1)], "paper string, error string, n_definitions int, n_terms int")
    lines = spark.createDataFrame([("p", "1", "theorem", "text", 1)], "paper string, id string, kind string, content string, ord int")
    edges = lines.selectExpr("paper", "'reference' AS edge_kind", "id AS source", "id AS target", "ord")
    assert persist_results(store, spark.createDataFrame(plain.rdd.map(counted), plain.schema), {"artifacts": lines, "edges": edges}, "graph") == (0, 1)
    assert seen(store) == [("p", "1", "theorem", "text")] and {r.paper: r.stage for r in store.read("states").collect()} == {"p": "complete", "q": "failed"}
    assert count.value == 2  # before, every table that was written computed them anew
