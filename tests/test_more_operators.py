"""Operators that the queries don't reach, on literals, skewed tables and brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from papyrion.operators import classify, definitions, dependencies, latex, layout, matching, queue, replies, retrieval, store
from papyrion.sources import files
from papyrion.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reference_strings():
    refs = [
        ('J. Doe, "A Great Paper", Journal of Things, 2021.', "A Great Paper", ["J. Doe"]),
        (r"J. Doe and A. Roe, \emph{A Great Paper}, 2021.", "A Great Paper", ["J. Doe", "A. Roe"]),
        (r"T. Abe, The stability of the family of $A_2$-type arrangements. \\textit{J. Math. Kyoto Univ.} \\textbf{46} (2006), no. 3, 617--639.", "The stability of the family of $A_2$-type arrangements", ["T. Abe"]),
        ("M.~Baker, S.~Norine, Harmonic morphisms and hyperelliptic graphs. International Math.~Research Notices 15 (2009), 2914--2955.", "Harmonic morphisms and hyperelliptic graphs", ["M. Baker", "S. Norine"]),
        (r"O.~Kallenberg, Foundations of Modern Probability, Second Edition, \\emph{Springer,} 2002.", "Foundations of Modern Probability", ["O. Kallenberg"]),
        (r"Pfeiffer, G., R{\\\"o}hrle, G., 2005. Special involutions and bulky parabolic subgroups in finite {C}oxeter groups. J. Aust. Math. Soc. 79~(1), 141--147.", "Special involutions and bulky parabolic subgroups in finite Coxeter groups", ["Pfeiffer, G.", "Rohrle, G."]),
    ]
    for ref, title, authors in refs:
        assert title in [t[0] for t in matching.title_forms(ref)], ref
        assert matching.reference_authors(ref) == authors, ref
    page = r"B.~McKay. \\newblock Combinatorial data. \\newblock http://cs.anu.edu.au/people/bdm/data, Dec. 2011."
    assert matching.title_forms(page) == [] and matching.reference_authors(page) == []


def test_similar_titles_match_brute_force(spark):
    rng = random.Random(4)
    words = ["graph", "stable", "of", "the", "prime", "sums", "on", "tori", "a", "note", "varieties"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    other = []
    for t in base:
        c = list(t)
        for _ in range(rng.randrange(0, 5)):
            c[rng.randrange(len(c))] = rng.choice("abcde ")
        other.append(" ".join("".join(c).split()))
    want = {(x, y) for x in set(base) for y in set(other) if x and y and SequenceMatcher(a=x, b=y).ratio() >= 0.92}
    a = spark.createDataFrame([(k, t) for k, t in enumerate(base)], "key int, form string")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(other)], "work int, title_form string")
    got = matching.similar_titles(a, b).join(b, "work").select("form", "title_form").distinct()
    assert set(map(tuple, got.collect())) == want and len(want) > 20


def test_matches_against_a_catalogue(spark):
    works = spark.createDataFrame([(1, "A Great Paper", ["John Doe", "Alice Roe"], "1111.2222"), (2, "A Great Papers", ["Ann Poe"], "3333.4444"), (3, "Other things on the shape of waves", ["X Y"], "5555.6666")], "work int, title string, authors array<string>, arxiv_id string")
    refs = spark.createDataFrame([("a", 'J. Doe, "A Great Paper", 2021.'), ("b", "J. Doe, Some paper, arXiv:1234.5678v2"), ("c", 'A. Poe, "A Great Paper", 2021.'), ("d", "https://x.org/data"), ("e", '"Other things on the shape of waves", 2001.'), ("f", None)], "key string, text string")
    got = {r.key: (r.method, r.arxiv_id) for r in matching.match_references(refs, works).collect()}
    assert got == {"a": ("search", "1111.2222"), "b": ("direct_regex", "1234.5678"), "c": ("search", "3333.4444"), "d": ("none", None), "e": ("search", "5555.6666"), "f": ("none", None)}
    known = spark.createDataFrame([("a", "none", None, None, None, 9), ("c", "none", None, None, None, 1)], "key string, method string, arxiv_id string, title_score double, author_overlap double, ts int")
    after = {r.key: (r.method, r.ts) for r in matching.backfill_matches(refs, known, works, F.lit(5), F.lit(10)).collect()}
    assert after["a"] == ("none", 9) and after["c"] == ("search", 10) and len(after) == 6


def test_following_matches_brute_force_on_a_hot_key(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(3000), rng.choice(["view", "buy"])) for _ in range(2500)]
    df = spark.createDataFrame([(k, t, t, e) for k, t, e in data], "key string, s long, e long, kind string")
    want = sorted((k, t, min((u for j, u, f in data if j == k and f == "buy" and u > t), default=None) or -1) for k, t, e in data if e == "view")
    for width in (None, 100, 100_000):
        got = dependencies.next_after(df, "key", "s", "e", "kind", "view", "buy", width).select("key", "s", F.coalesce("next_start", F.lit(-1)))
        assert rows(got) == want


def test_papers_over_the_cap_make_no_pairs(spark):
    terms = [("hot", f"n{k}", "common") for k in range(3000)] + [("p", f"n{k}", "t") for k in range(4)]
    df = spark.createDataFrame(terms, "paper string, artifact string, term string")
    assert dependencies.capped_overlap_pairs(df, 6).groupBy("paper").count().collect() == [("p", 6)]
    nodes = spark.createDataFrame([("hot", f"n{k}", k) for k in range(3000)] + [("p", f"n{k}", k) for k in range(4)], "paper string, id string, line int")
    assert dependencies.all_pairs(nodes, 6).count() == 6


def test_contained_terms_match_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(60)] + [(99, None), (100, "")]
    terms = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for k in range(80)] + [(200, "absent"), (201, "")]
    got = definitions.contained_terms(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(terms, "term_id int, term string"))
    assert set(map(tuple, got.collect())) == {(i, j) for i, t in texts for j, w in terms if t and w and f" {w} " in f" {t} "}


def test_dense_search_in_blocks(spark):
    rng = random.Random(7)
    data = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(400)] + [(900, None), (901, [1.0])]
    v = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    q = v.where("id % 10 = 0 and id < 400").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    whole = rows(retrieval.dense_topk(v, q, 5).select("query_id", "id", "rank"))
    assert rows(retrieval.dense_topk(v, q, 5, block=7).select("query_id", "id", "rank")) == whole and len(whole) == 200
    slow = v.join(q).select("query_id", "id", retrieval.cosine(F.col("v"), F.col("q")).alias("s")).where("s is not null").collect()
    for i in (0, 70, 390):
        best = sorted(((-round(r.s, 9), r.id) for r in slow if r.query_id == i))[:5]
        assert [x for _, x in best] == [b for a, b, _ in sorted(whole, key=lambda r: r[2]) if a == i]
    assert retrieval.dense_topk(v, q.limit(0)).count() == 0


def test_state_by_parts(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([("x", k, f"v{k}"), (f"y{k}", k, "w")], "key string, seq int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.file_stream(spark, str(tmp_path / "in"), "key string, seq int, v string")
    target = str(tmp_path / "state")
    events.upsert_parts(stream, "key", "seq", target, str(tmp_path / "cp"), parts=8)
    assert rows(events.state(spark, target, stream.schema)) == [("x", 3, "v3"), ("y0", 0, "w"), ("y1", 1, "w"), ("y2", 2, "w"), ("y3", 3, "w")]
    assert max(map(len, events.state_paths(spark, target).values())) <= 2


def test_upserts_keep_times_below_a_second(spark):
    new = spark.sql("SELECT 'a' k, 1 v, TIMESTAMP '2024-01-01 00:00:00.2' t UNION ALL SELECT 'a', 2, TIMESTAMP '2024-01-01 00:00:00.9' UNION ALL SELECT 'a', 3, TIMESTAMP '2024-01-01 00:00:00.5'")
    assert queue.upsert(new.limit(0), new, ["k"], F.col("t")).first().v == 2


def test_blocks_of_plain_tex():
    tex = r"a \proclaim{Theorem 1.} body \demo P \enddemo more \endproclaim z \proclaim{Lem 2} open \demo Q \enddemo end \bye tail"
    got = latex.parse_environments(latex._Blocks(tex).rewritten())
    assert [(r["kind"], " ".join(r["content"].split())) for r in got] == [("theorem", "body more"), ("proof", "P"), ("lemma", "open end"), ("proof", "Q")]
    assert latex._Blocks(r"x \demo never closed").rewritten() == r"x \demo never closed" and latex._Blocks("").rewritten() == ""


def test_files_that_are_no_utf8_or_have_no_suffix(spark, tmp_path):
    for name, data in (("p/a.tex", b"x\xff\\begin{y}"), ("q/main", b"\\documentclass{a} body"), ("q/notes", b"plain"), ("q/pic.png", b"\\documentclass")):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(data)
    got = {r.paper: r.text for r in files.combined_tex(spark, str(tmp_path / "src")).collect()}
    assert got["p"].endswith("x\\begin{y}") and "documentclass{a}" in got["q"] and "plain" not in got["q"] and "pic" not in got["q"]
    import gzip

    rows_ = [("g", gzip.compress(b"no tex at all")), ("h", gzip.compress(b"\\begin{document}"))]
    found = {r.archive: r.error for r in files.archive_members(spark.createDataFrame(rows_, "path string, content binary")).collect()}
    assert found["g"] and not found["h"]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/">%s<entry><id>http://x/abs/1</id><title>%s</title><summary>s</summary></entry></feed>'
    total = "<o:totalResults>7</o:totalResults>"
    assert files.feed_page(feed % (total, "T"))[:2] == (1, 7) and files.feed_page(feed % ("", "T")) == (0, 0, []) and files.feed_page(feed % (total, "Error")) == (0, 0, []) and files.feed_page("<bad") == (0, 0, [])


def test_failures_and_leaks(spark):
    def code(kind, message):
        return spark.range(1).select(classify.processing_error(F.lit(kind), F.lit(message)).alias("e")).first().e.code

    assert code("ArxivExtractorError", "Zip archive is corrupted") == "source_zip_corrupt" and code("ValueError", "empty or invalid graph") == "graph_empty"
    assert code("APIError", "odd") == "llm_api_error" and code("TimeoutError", "") == "llm_timeout" and code("KeyError", "x") == "unexpected_error"


def test_lines_by_rare_words(spark):
    lines = spark.createDataFrame([("p", 1, k, t) for k, t in enumerate(["Every compact manifold here", "has a common word", "and a common word"])], "paper string, page int, line_no int, text string")
    nodes = spark.createDataFrame([("p", 1, "n", "Every \\emph{compact} manifold"), ("p", 1, "m", "common word")], "paper string, page int, id string, text string")
    assert rows(layout.best_lines(nodes, lines)) == [("p", 1, "n", 0)]


def test_retried_provider():
    calls = []

    def flaky(message):
        calls.append(message)
        if len(calls) < 3 or message == "bad":
            raise OSError
        return message.upper()

    waits = []
    assert replies.retrying(flaky, seed=1, sleep=waits.append)(["a", "bad"]) == ["A", None]
    assert calls.count("a") == 3 and calls.count("bad") == 4 and len(waits) == 5 and max(waits) <= 10


def test_documents_are_written(spark, tmp_path):
    docs = spark.createDataFrame([("data/a.json", '{"é": 1}'), ("data/b.json", "{}")], "path string, json string")
    assert rows(store.write_documents(docs, f"file://{tmp_path}")) == [("data/a.json", 9), ("data/b.json", 2)]
    assert (tmp_path / "data" / "a.json").read_text("utf-8") == '{"é": 1}' and len(list((tmp_path / "data").iterdir())) == 2


def test_intermediate_tables_need_a_shared_folder(monkeypatch, spark):
    from papyrion import workspace

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"applicationId": "none", "master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        workspace.shared_folder(Cluster())


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "t.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE papers (paper_id TEXT, n INTEGER)")
        c.executemany("INSERT INTO papers VALUES (?, ?)", [(f"p{k}", k if k % 3 else None) for k in range(1000)])
        c.execute("CREATE TABLE empty_table (paper_id TEXT)")
    got = files.sqlite_rows(spark, path, "papers", "paper_id string, n bigint", parts=3)
    assert {(r.paper_id, r.n) for r in got.collect()} == {(f"p{k}", k if k % 3 else None) for k in range(1000)}
    assert files.sqlite_rows(spark, path, "empty_table", "paper_id string").count() == 0
    with pytest.raises(ValueError):
        files.sqlite_rows(spark, path, "papers; DROP", "paper_id string")


def test_pages_until_the_target():
    from papyrion.operators import commands

    seen = []

    def pages(month):
        for n in (3, 4):
            seen.append(month)
            yield n

    assert commands.until_target(["m3", "m2", "m1"], pages, 10) == (10, ["m3"]) and seen == ["m3", "m3", "m2"]
    assert commands.until_target([], pages, 5) == (0, [])


def test_source_lines_are_dealt_by_paper(spark):
    """Small as the tables look, files aren't sent to the driver and lines aren't multiplied; results equal those of every step."""
    ranges = [("p", "a.tex", 1, 9), ("p", "b.tex", 12, 20), ("p", "c.tex", 30, 30), ("q", "d.tex", 4, 6), ("q", None, 8, 9), ("p", "e.tex", None, 50), ("p", "f.tex", 60, None), (None, "g.tex", 1, 9)]
    asked = [(p, n) for p in "pqr" for n in (-9, -4, -3, 0, 1, 5, 9, 10, 11, 12, 20, 21, 24, 25, 30, 31, 58)] + [("p", None), (None, 3), ("p", 5)]
    good = [r for r in ranges if None not in (r[0], r[2], r[3])]
    brute = {}
    for p, n in asked:
        steps = [(k, f, k - a + 1) for k in range(n, n + 6) for q, f, a, z in good if q == p and a <= k <= z] if n is not None else []
        if steps:
            brute[p, n] = min(steps, key=lambda s: s[0])[1:]
    out = layout.source_lines(spark.createDataFrame(asked, "paper string, line int"), spark.createDataFrame(ranges, "paper string, file string, first int, last int"))
    found = [(r.paper, r.line, r.file, r.local) for r in out.collect()]
    assert len(found) == len(brute) and {x[:2]: x[2:] for x in found} == brute
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan
    from papyrion.plans import texts

    assert "Broadcast" not in texts.combined_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
