"""Patterns made from values, and patterns over adversarial texts."""

import time

import pytest
from pyspark.sql import functions as F

from papyrion.functions.text import html_text, quoted
from papyrion.operators.citations import label_mentions, query_context
from papyrion.operators.indexing import context_paragraph
from papyrion.operators.matching import cached_matches, match_key

AWKWARD = ["\\Ext", "\\End(V)", "\\Eis", "\\Q", "\\E", "a\\Eb", "$x$", "[a]", "(b", "x^2+1", "#", "a.b", "*", "{", "é", "x|y", "\\"]


def test_quoted_matches_itself_only(spark):
    df = spark.createDataFrame([(a, b) for a in AWKWARD for b in AWKWARD], "a string, b string")
    assert all(r.m == (r.a == r.b) for r in df.select("a", "b", F.regexp_like("b", F.concat(F.lit("^"), quoted(F.col("a")), F.lit("$"))).alias("m")).collect())


@pytest.mark.parametrize("term", ["\\Ext", "\\End(V)", "\\Eis", "\\Q", "$\\Ext$", "(a]", "C++"])
def test_context_of_awkward_terms(spark, term):
    bare = term.strip("$")
    df = spark.createDataFrame([(f"nothing\n\nwe use {bare} here\n\n{bare}", term), ("none", term)], "t string, term string")
    assert [r.p for r in df.select(context_paragraph(F.col("t"), F.col("term")).alias("p")).collect()] == [f"we use {bare} here", ""]


def test_mentions_of_awkward_labels(spark):
    labels = ["A\\E", "[K$1]", "Q(x", "12"]
    pars = spark.createDataFrame([("d", k, f"Before this. As shown in [{x}] we see. After that.") for k, x in enumerate(labels)], "doc string, par int, text string")
    found = label_mentions(pars, spark.createDataFrame([("d", x) for x in labels], "doc string, label string")).collect()
    assert {(r.par, r.label) for r in found} >= set(enumerate(labels))


def test_open_brackets_are_linear(spark):
    texts = ["<" * 1_000_000, "<a" * 500_000, "<>" * 500_000, "<" * 1000 + "b>c<d", "no", "", "a<b>c</b><"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    got = [(r.h, r.q) for r in df.select(html_text(F.col("t")).alias("h"), query_context(F.lit(None).cast("string"), F.lit(""), F.lit(""), F.col("t")).alias("q")).collect()]
    assert time.time() - began < 30
    assert [len(h) for h, _ in got[:3]] == [1_000_000] * 3 and [h for h, _ in got[3:]] == ["c<d", "no", "", "a c <"]


def test_spellings_share_a_key(spark):
    import hashlib
    import json

    rows = [("On \\emph{Café} sets", ["Müller, Jörg", "Bo"]), ("on cafe   SETS.", ["jorg muller", " ", "B.o."]), ("on cafe sets", None)]
    df = spark.createDataFrame(rows, "title string, authors array<string>")
    keys = [r.k for r in df.select(match_key(F.col("title"), F.col("authors")).alias("k")).collect()]
    plain = [hashlib.sha256(json.dumps({"title": "on cafe sets", "authors": a}, sort_keys=True).encode()).hexdigest() for a in (["jorg muller", "bo"], ["jorg muller", "b o"], [])]
    assert keys == plain
    cache = spark.createDataFrame([(plain[0], 3, "yes"), (plain[2], 1, "old")], "cache_key string, ts int, reply string")
    assert [r.reply for r in cached_matches(df, cache, F.lit(2)).orderBy(F.desc("reply")).collect()] == ["yes", None, None]
