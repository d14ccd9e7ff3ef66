"""Operators on small literals with the expected rows, and brute force where there is no SQL."""

import random

from pyspark.sql import functions as F

from papyrion.operators import definitions, dependencies, graph, layout, matching, mentions, provider, queue, retrieval
from papyrion.operators.components import connected_components
from papyrion.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_queue(spark):
    q = spark.createDataFrame([(x,) for x in ("2406.01082v1", "2406.01082v2", "2305.14545v3", "2305.14545v4", "9999.00001", "1.1v9", "1.1v10")], "arxiv_id string")
    assert {r.arxiv_id for r in queue.latest_versions(q).where("kept").collect()} == {"2406.01082v2", "2305.14545v4", "9999.00001", "1.1v10"}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, o int")
    assert rows(queue.upsert(old.withColumn("o", F.lit(None).cast("int")), new, ["k"], F.col("o")).select("k", "v")) == [("a", 1), ("b", 4), ("c", 5)]
    fresh = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2026-01-01T00:00:00Z",), ("junk",), (None,)], "t string")
    assert [r.x for r in fresh.select(queue.should_refresh(F.col("t"), F.lit("2025-01-01").cast("timestamp")).alias("x")).collect()] == [True, False, True, True]


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 190), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(n, n + 40)] + [(5000, 6000 + k) for k in range(100)] + [(7, 7)]
        label = {x: x for e in edges if e[0] != e[1] for x in e}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if a != b and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        got = connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long"))
        assert {r.vertex: r.component for r in got.collect()} == label
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_citation_graph(spark):
    e = spark.createDataFrame([("a1", "a2"), ("a2", "a3"), ("b1", "b2"), ("x1", None)], "src string, dst string")
    assert [(r.size, r.n_edges) for r in graph.top_components(e, 5, 2).orderBy("rank").collect()] == [(3, 2), (2, 1)]
    refs = spark.createDataFrame([("n1", "Thm-A_1"), ("n1", "thm:a 1"), ("t", "Thm-A_1"), ("n1", "zz")], "source string, label string")
    labels = spark.createDataFrame([("Thm-A_1", "t"), ("x:1", "u"), ("x-1", "v")], "label string, node_id string")
    assert rows(graph.resolve_labels(refs, labels)) == [("n1", "Thm-A_1", "t"), ("n1", "thm:a 1", "t")]
    edges = spark.createDataFrame([("a", "b", "k1", 1), ("a", "b", "k2", 0)], "source string, target string, kind string, o int")
    assert graph.dedup_edges(edges, "o").first().kind == "k2"


def test_candidates(spark):
    terms = spark.createDataFrame([("p", "n1", "common_term"), ("p", "n2", "common_term"), ("p", "n2", "union closed"), ("p", "n3", "approximate union closed")], "paper string, artifact string, term string")
    assert rows(dependencies.overlap_pairs(terms)) == [("p", "n1", "n2")]
    assert rows(dependencies.subword_pairs(terms)) == [("p", "n2", "n3")]
    nodes = spark.createDataFrame([("p", "n1", 1), ("p", "n2", 10), ("p", "n3", 20)], "paper string, id string, line int")
    assert rows(dependencies.directed(dependencies.overlap_pairs(terms), nodes)) == [("p", "n2", "n1")]
    assert len(rows(dependencies.all_pairs(nodes))) == 3 and rows(dependencies.under_cap(dependencies.all_pairs(nodes), 2)) == []


def test_definitions(spark):
    known = spark.createDataFrame([("abelian group", 0), ("group", 1), ("f-closed family", 2)], "key string, ord int")
    asked = spark.createDataFrame([("finite abelian group",), ("g-closed family",)], "term string")
    assert rows(definitions.base_by_suffix(asked, known)) == [("finite abelian group", "abelian group")]
    assert ("g-closed family", "f-closed family") in rows(definitions.base_by_parameter(asked, known))
    d = spark.createDataFrame([("muchlonger", "t", 0), ("short", "t", 1), ("x", "", 2), ("a", "u", 3), ("bb", "u", 4), ("ccc", "u", 5)], "term string, definition_text string, ord int")
    assert rows(definitions.merge_redundant(d)) == [("t", "short", ["muchlonger"], 2), ("u", "a", ["bb", "ccc"], 3)]
    texts = spark.createDataFrame([(1, "an abelian group is a (group)."), (2, "groups")], "text_id int, text string")
    terms = spark.createDataFrame([(1, "group"), (2, "abelian group"), (3, "an abelian group is a (group) . x"), (4, "an abelian group is a ( group )")], "term_id int, term string")
    assert rows(definitions.contained_terms(texts, terms)) == [(1, 1), (1, 2), (1, 4)]


def test_matching(spark):
    assert matching.title_form("A \\textbf{Test} $x$-Theorem") == "a test theorem" and matching.author_form("Doe, John") == "john doe"
    df = spark.createDataFrame([(["John Doe", "Alice Smith"], ["Doe, J.", "Smith, Alice"])], "a array<string>, b array<string>")
    names = df.select(matching.last_names("a").alias("a"), matching.last_names("b").alias("b")).first()
    assert set(names.a) == {"doe", "smith"} and names.b[-1] == "smith"
    refs = spark.createDataFrame([(1, 'J. Doe, "A study of things in the plane", 2001.'), (2, "https://x.org/data"), (3, "A. Roe, \\emph{On the shape of all waves}, Springer, 1999.")], "id int, ref string")
    got = {r.id: r.title for r in matching.title_candidates(refs, "id", "ref").where("place = 1").collect()}
    assert got[1] == "A study of things in the plane" and "waves" in got[3] and 2 not in got
    pairs = spark.createDataFrame([("q", "a", 0.95, 1.0, 0, 0), ("q", "b", 0.95, 1.0, 8, 1), ("q", "c", 0.5, 1.0, 99, 2)], "k string, c string, title_score double, author_overlap double, cited int, ord int")
    assert matching.best_matches(pairs, "k", "c", 0.92, 0.1).first().c == "b"
    s = spark.createDataFrame([("abc", "abc"), ("", "a"), ("abcd", "bcde")], "a string, b string").select(matching.similarity("a", "b").alias("s")).collect()
    assert [r.s for r in s] == [1.0, 0.0, 0.75]


def test_retrieval_metrics(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query_id string, id string, rank int")
    qrels = spark.createDataFrame([("q", "b"), ("q", "x")], "query_id string, id string")
    queries = spark.createDataFrame([("q",), ("z",)], "query_id string")
    m = {r.query_id: r for r in retrieval.query_metrics(results, qrels, queries).collect()}
    assert abs(m["q"].ndcg - (1 / 1.5849625007) / (1 + 1 / 1.5849625007)) < 1e-9 and m["q"].recall == 0.5 and m["q"].hit == 1 and m["q"].first_rank == 2
    assert m["z"].ndcg is None and m["z"].n_relevant == 0
    over = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 2.0)], "query_id string, id string, overlap double")
    scored = results.withColumn("score", F.lit(1.0))
    assert {(r.id, r.score) for r in retrieval.filter_boost(scored, over, 1.0, 0.5).collect()} == {("b", 2.0), ("a", 1.0)}
    late = retrieval.late_interaction(spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 0.0]])], "id int, vs array<array<double>>"), spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 1.0]])], "query_id string, qs array<array<double>>"))
    assert [(r.id, round(r.score)) for r in late.orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_provider_calls_only_misses(spark):
    prompts = spark.createDataFrame([(1, "s", "a", "m"), (2, "s", "b", "m"), (3, "s", "b", "m")], "i int, system string, user string, model string")
    cache = prompts.where("i = 1").select(provider.prompt_key(F.col("system"), F.col("user"), F.col("model")).alias("prompt_key"), F.lit('{"x": 1}').alias("reply"))
    got = {r.i: (r.reply, r.status) for r in provider.with_replies(prompts, cache, lambda users: [f'{{"x": "{u}"}}' for u in users]).collect()}
    assert got == {1: ('{"x": 1}', "cached"), 2: ('{"x": "b"}', "called"), 3: ('{"x": "b"}', "called")}
    assert {r.status for r in provider.with_replies(prompts, cache).collect()} == {"cached", "unresolved"}


def test_pages_and_layout(spark):
    assert mentions.read_page("<p>a&amp;b<script>x</script> <a href='#t'>c</a>") == ("a&b c", ["#t"])
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    lines = spark.createDataFrame([("p", 1, 1, "Theorem 1.1. Let us go", (0.0, 0.0, 10.0, 10.0)), ("p", 1, 2, "on and on", (0.0, 10.0, 10.0, 20.0)), ("p", 1, 9, "Theorem 2. Far", (0.0, 900.0, 10.0, 910.0))], f"paper string, page int, line_no int, text string, box {box}")
    labels = layout.label_lines(lines)
    assert {(r.kind, r.number) for r in labels.collect()} == {("theorem", "1.1"), ("theorem", "2")}
    hits = spark.createDataFrame([("p", 1, "n", "theorem", (5.0, 15.0, 8.0, 18.0))], f"paper string, page int, id string, kind string, box {box}")
    assert layout.nearest_labels(hits, labels).first().number == "1.1"
    nodes = spark.createDataFrame([("p", "n", "theorem", ["let", "us", "go"])], "paper string, id string, kind string, words array<string>")
    assert layout.similar_labels(nodes, labels).first().number == "1.1"
    files = spark.createDataFrame([("p", "a.tex", 1, 9), ("p", "b.tex", 12, 20)], "paper string, file string, first int, last int")
    want = spark.createDataFrame([("p", 3), ("p", 10), ("p", 30)], "paper string, line int")
    assert rows(layout.source_lines(want, files)) == [("p", 3, "a.tex", 3), ("p", 10, "b.tex", 1)]


def test_cursors_and_streams(spark, tmp_path):
    c = spark.createDataFrame([("a", 5), ("b", 1)], "k string, t int")
    seen = spark.createDataFrame([("a", 3), ("b", 9), ("c", 2)], "k string, t int")
    assert rows(events.advance_cursor(c, seen, "k", "t")) == [("a", 3), ("b", 1), ("c", 2)]
    for k in range(3):
        spark.createDataFrame([("x", k, f"v{k}"), (f"y{k}", k, "w")], "key string, seq int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.file_stream(spark, str(tmp_path / "in"), "key string, seq int, v string")
    q = events.upsert_stream(stream, "key", "seq", str(tmp_path / "state"), str(tmp_path / "cp"))
    last = spark.read.parquet(str(tmp_path / "state" / str(q.lastProgress["batchId"])))
    assert rows(last) == [("x", 2, "v2"), ("y0", 0, "w"), ("y1", 1, "w"), ("y2", 2, "w")]
