"""The lexical search deals documents to tasks."""

from papyrion.operators import retrieval


def test_sums_are_made_where_the_document_is(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id", "concat_ws(' ', 'a', if(id % 2 = 0, 'b', 'c'), concat('w', id % 7)) AS text")
    queries = spark.createDataFrame([(1, "a b"), (2, "c w3 w3"), (3, "nothing")], "query_id long, text string")
    whole = retrieval.bm25(docs, queries).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(retrieval, "SUMS", 50)
    cut = retrieval.bm25(docs, queries)
    assert cut.orderBy("query_id", "rank").collect() == whole and len(whole) == 20
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id#" in line and ", id#" in line]  # before, all sums were shuffled


def test_structured_sums_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "OVERLAPS", 100)
    fields = spark.createDataFrame([(k, ["ring", "field"]) for k in range(500)], "id long, tokens array<string>").coalesce(1)
    asked = spark.createDataFrame([("q", "ring"), ("q", "field"), ("r", "ring")], "query_id string, token string")
    got = retrieval.structured_overlap(fields, asked)
    assert got.rdd.getNumPartitions() == 15 and got.count() == 1000


def test_tokens_are_counted_where_the_text_is(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id", "concat_ws(' ', 'a', if(id % 2 = 0, 'b', 'c'), 'a', concat('w', id % 7)) AS text")
    wanted = spark.createDataFrame([("a",), ("b",), ("w3",)], "token string")
    plans = []
    written = retrieval.materialize
    monkeypatch.setattr(retrieval, "TEXTS", 400, raising=False)
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    got = {(r.id, r.token): (r.tf, r.dl) for r in retrieval.postings(docs, wanted).collect()}
    assert got[0, "a"] == (2, 4) and got[0, "b"] == (1, 4) and got[1, None] == (2, 4) and len(got) == 300 + 150 + 43 + 300 - 21
    assert "REPARTITION_BY_NUM" in plans[0]
    assert not [line for line in plans[0].splitlines() if "Exchange hashpartitioning(id#" in line and "token" in line]  # before, counts of (id, token) were shuffled
