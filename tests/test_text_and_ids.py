"""Column functions on the literals of the data model."""

from pyspark.sql import functions as F

from papyrion.functions import ids, text
from papyrion.operators import classify


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_terms(spark):
    cases = {"$\\varphi$": "varphi", "\\varphi": "varphi", "f": "f", "$f$": "f", "{\\phi}": "phi", "\\AlphaBeta": "alphabeta", "term (note)": "term", "F_23": "F_23"}
    for term, want in cases.items():
        assert one(spark, text.normal_term(F.lit(term))) == want, term


def test_tokens_and_canonical(spark):
    assert one(spark, text.tokens(F.lit("Let \\Alpha_1 = Foo, \\{x"))) == ["let", "\\Alpha", "_", "1", "=", "foo", ",", "\\{", "x"]
    assert one(spark, text.canonical(F.lit("a$b$(c)=d"))) == "ab ( c ) = d"
    assert one(spark, text.sentences(F.lit("One two.  Three?\nFour"))) == ["One two.", "Three?", "Four"]


def test_labels_types_and_dialects(spark):
    assert one(spark, text.normal_label(F.lit("Thm-A_1"))) == one(spark, text.normal_label(F.lit("thm:a 1"))) == "thm:a:1"
    assert one(spark, text.type_of_title(F.lit("Main Thm."))) == "theorem" and one(spark, text.type_of_title(F.lit("Foobar"))) == "unknown"
    assert one(spark, text.dialect(F.lit("\\documentclass{x} \\demo"))) == "latex" and one(spark, text.dialect(F.lit("\\proclaim{x}"))) == "ams_tex"
    assert one(spark, text.dialect(F.lit("x \\bye"))) == "plain_tex" and one(spark, text.dialect(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, text.type_hint(F.lit("see Lemma 3"))) == "lemma" and one(spark, text.type_hint(F.lit("nothing"))) is None


def test_macros_and_cleaning(spark):
    tex = "\\newcommand{\\cF}{\\mathcal{F}}\n\\def\\Hom{Hom}\n\\newcommand{\\two}[1]{#1}\\newcommand{\\arg}{a#1}\n\\begin{document}\\newcommand{\\no}{x}"
    assert one(spark, text.macros(F.lit(tex))) == {"cF": "\\mathcal{F}", "Hom": "Hom"}
    assert one(spark, text.clean_latex(F.lit("\\section*{Intro}\\label{a} \\begin{claim}x\\end{claim}"))) == "Introx"
    assert one(spark, text.strip_comments(F.lit("a % b\nc \\% d"))) == "a \nc \\% d"


def test_references_and_subwords(spark):
    refs = one(spark, text.numbered_refs(F.lit("By Theorem 2.1 and Lemma 3, see Prop 4")))
    assert [(r.kind, r.number) for r in refs] == [("theorem", "2.1"), ("lemma", "3"), ("proposition", "4")]
    sub = lambda a, b: one(spark, text.is_subword(F.lit(a), F.lit(b)))
    assert sub("union closed", "approximate union closed") and not sub("a", "a") and not sub("", "a")


def test_replies_and_buckets(spark):
    assert one(spark, text.json_from_reply(F.lit('<think>{"a": 0}</think> ok {"a": 1}'))) == '{"a": 1}'
    assert one(spark, text.json_from_reply(F.lit('```json\n{"a": {"b": 2}}\n```'))) == '{"a": {"b": 2}}'
    assert [one(spark, text.length_bucket(F.lit(n))) for n in (6, 7, 20, 21)] == ["0-6", "7-12", "13-20", "21+"]
    assert one(spark, text.unicode_to_tex(F.lit("α ≤ b"))) == "\\alpha \\leq b"


def test_ids(spark):
    assert one(spark, ids.parse_id(F.lit("http://arxiv.org/abs/2406.01082v3"))) == "2406.01082"
    assert one(spark, ids.base_id(F.lit("math.AG/0601001v2"))) == "math.AG/0601001"
    assert [one(spark, ids.version_of(F.lit(x))) for x in ("1.2v10", "1.2")] == [10, 0]
    assert one(spark, ids.id_in_reference(F.lit("preprint arXiv:1234.5678v2, 2012"))) == "1234.5678v2"
    assert {one(spark, ids.work_id(F.lit(x))) for x in ("W123", "w123", "https://openalex.org/W123?x=1")} == {"https://openalex.org/W123"}
    assert one(spark, ids.cursor_clause(F.lit("2020-01-02 03:04:05").cast("timestamp"))).endswith("20200102030405]")
    assert one(spark, ids.month_clause(F.to_date(F.lit("2024-02-10")))) == "submittedDate:[202402010000 TO 202402292359]"
    assert one(spark, ids.is_valid_id(F.lit("math.AG/0601001"))) and not one(spark, ids.is_valid_id(F.lit("x y")))
    assert one(spark, ids.id_of_file(ids.file_of(F.lit("2401.00001v2")))) == "2401.00001v2"
    assert one(spark, ids.is_url_reference(F.lit("see https://x.org"))) and not one(spark, ids.is_url_reference(F.lit("https://doi.org/10.1")))


def test_classification(spark):
    assert one(spark, classify.error_code(F.lit("X"), F.lit("HTTP 429 too many requests"))).code == "rate_limited"
    assert one(spark, classify.error_code(F.lit(None).cast("string"), F.lit("?"))).code == "unknown"
    assert one(spark, classify.payload_kind(F.lit(b"<html>reCAPTCHA</html>"))) == "recaptcha"
    assert one(spark, classify.is_leaky(F.lit("by Theorem 2"), F.lit("zorn"))) and not one(spark, classify.is_leaky(F.lit("compact spaces are closed"), F.lit("zorn")))
    works = spark.createDataFrame([("w1", "a", 0, "A"), ("w1", "b", 1, "A"), ("w1", "a", 2, "A"), (None, "c", 3, "C")], "id string, target string, ord int, title string")
    assert sorted((str(r.id), r.targets) for r in classify.merge_citing(works).collect()) == [("None", ["c"]), ("w1", ["a", "b"])]
