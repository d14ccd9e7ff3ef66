"""Index documents, queries, context and numbering on literals."""

from pyspark.sql import functions as F

from papyrion.operators import indexing
from papyrion.sources.tables import numbered


def test_queries_and_qrels(spark):
    q = spark.createDataFrame([("a", "By Theorem 2", "s", "explicit", ["x"]), (None, "α b", None, "", []), ("c", "", None, None, None), ("d", "z", None, "fuzzy", None)], "query_id string, query_text string, query_style string, reference_precision string, explicit_refs array<string>")
    got = {r.query_text: r for r in indexing.prepared_queries(q, explicit_only=True).collect()}
    assert set(got) == {"By Theorem 2", "α b"} and got["α b"].normalized == "\\alpha b" and len(got["α b"].query_id) == 64 and got["By Theorem 2"].n_words == 3
    nodes = spark.createDataFrame([("n1", "Theorem", "2.1"), ("n2", "lemma", "2.1")], "id string, kind string, number string")
    asked = spark.createDataFrame([("q", [("theorem", "2.1")])], "query_id string, refs array<struct<kind:string,number:string>>")
    assert [tuple(r) for r in indexing.build_qrels(nodes, asked).collect()] == [("q", "n1")]


def test_context_and_display(spark):
    text = "Intro f here.\n\nLet $f$ be a map.\n\nA group is abelian."
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(indexing.context_paragraph(F.lit(text), F.lit("$f$"))) == "Let $f$ be a map."
    assert one(indexing.context_paragraph(F.lit(text), F.lit("Group"))) == "A group is abelian."
    assert one(indexing.context_paragraph(F.lit(text), F.lit("absent"))) == ""
    assert one(indexing.offset_of(F.lit("ab\ncd\nef"), F.lit(3), F.lit(2))) == 7
    assert one(indexing.display_name(F.lit("lemma"), F.lit("l"), F.lit("i"), F.lit(False))) == "Lemma"


def test_numbered(spark):
    df = spark.range(100).select(F.format_string("k%03d", 99 - F.col("id")).alias("k")).repartition(7)
    assert sorted((r.k, r.n) for r in numbered(df, "k").collect()) == [(f"k{i:03d}", i + 1) for i in range(100)]
