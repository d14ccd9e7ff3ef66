"""Matching where many works share a title, and rows of small files dealt to many tasks."""

from papyrion.operators import matching
from papyrion.plans import texts


def test_works_of_one_title_stand_as_one(spark, monkeypatch):
    written = {}

    def counted(df, name="table"):
        out = materialize(df, name)
        written[name] = out.count()
        return out

    materialize = matching.materialize
    monkeypatch.setattr(matching, "materialize", counted)
    refs = spark.createDataFrame([(k, 'J. Doe, "On the theory of things", Journal of Things, 2001.') for k in range(20)] + [(20, 'A. Poe, "On the theory of things", 2001.')], "key long, text string")
    works = spark.createDataFrame([(w, "On the Theory of Things", ["A. Poe" if w == 7 else "Doe, John"], f"2101.{w:05d}") for w in range(3, 303)], "work long, title string, authors array<string>, arxiv_id string")
    got = {r.key: (r.arxiv_id, r.author_overlap) for r in matching.match_references(refs, works).collect()}
    assert got == {k: ("2101.00003", 1.0) for k in range(20)} | {20: ("2101.00007", 1.0)}
    assert written["works"] == 2


def test_candidates_are_made_in_many_tasks(spark):
    refs = spark.createDataFrame([(1, "Doe, J., On the theory of things. \\textit{Some Journal} 12, 1980.")], "key long, text string").coalesce(1)
    got = matching.title_candidates(refs, "key", "text")
    assert f"RoundRobinPartitioning({matching.PARTS})" in got._jdf.queryExecution().executedPlan().toString()


def test_macros_are_read_once_in_many_tasks(spark):
    plan = texts.tex_macros(spark, "/root/testdata/sf0.001")
    assert plan.rdd.getNumPartitions() >= 32
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    body = tree[tree.index("array_join") :]
    assert body.index("regexp_extract_all") < body.index("[one,two,op,three,arg,bad,body]")  # read outside of the loop over names


def test_labels_do_not_pass_through_the_driver(spark):
    plan = texts.sentence_mentions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
