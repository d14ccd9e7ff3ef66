"""TeX parsing, linking and references, and the readers."""

import gzip
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from papyrion.operators import latex
from papyrion.sources import files, sinks


def test_environments():
    tex = "\\begin{theorem}\\label{thm:a}\nA.\n\\end{theorem}\n\\begin{proof}P\\end{proof}\n\\begin{Def}\\label{d}x\\end{Def}\n\\begin{lemma} open\n\\begin{thm}y\\end{thm}"
    got = latex.parse_environments(tex)
    assert [(r["kind"], r["label"], r["content"]) for r in got] == [("theorem", "thm:a", "\\label{thm:a}\nA."), ("proof", None, "P"), ("definition", "d", "\\label{d}x"), ("theorem", None, "y")]
    assert got[0]["id"] == "theorem:thm:a" and got[0]["line_start"] == 1 and got[0]["col_start"] == 1 and got[0]["line_end"] == 3
    assert latex.declared_names("\\newtheorem{mythm}[thm]{Main Theorem}\\newtheorem{weird}{Foobar}\\newtheorem*{rmk}{Remark}") == {"mythm": "theorem", "rmk": "remark"}
    nested = latex.parse_environments("\\begin{lem}a\\begin{lem}b\\end{lem}c\\end{lem}")
    assert len(nested) == 1 and nested[0]["content"].endswith("c")
    assert [r["kind"] for r in latex.parse_environments("\\newtheorem{z}{Lemma}\n\\begin{z*}q\\end{z*}")] == ["lemma"]
    source = "ab\ncd\n\\begin{claim}x\n\\end{claim}"
    r = latex.parse_environments(source)[0]
    assert (r["line_start"], r["col_start"], r["line_end"]) == (3, 1, 4)


def test_proofs_and_references(spark):
    tex = "\\begin{theorem}\\label{l1}A\\end{theorem}\\begin{lemma}\\label{l2}B \\ref{l1} \\cite[p. 2]{K1,K2} [Rou01, Thm. 2]\\end{lemma}\n\\begin{proof}near\\end{proof}\\begin{proof}[of \\ref{l1}]far\\end{proof}"
    docs = spark.createDataFrame([("p", tex), ("q", None)], "paper string, text string")
    nodes, edges = latex.statement_graph(docs)
    assert {r.id: r.proof for r in nodes.collect()} == {"theorem:l1": "far", "lemma:l2": "near"}
    assert [tuple(r) for r in edges.collect()] == [("p", "lemma:l2", "theorem:l1")]
    refs = latex.references(nodes.withColumn("text", F.col("content")), ["paper", "id"]).where("kind = 'external'").collect()
    assert [(r.target, r.note) for r in refs] == [("K1", "p. 2"), ("K2", "p. 2")]
    bib = latex.bibliography(spark.createDataFrame([("p", "\\bibitem[Rou01]{R}A. Rouq, T. arXiv:0601.0001v2\n\\bibitem{K1}B \\end{x}", 1, 0), ("p", "@a{K1, title={no}}", 2, 0)], "paper string, text string, priority int, file_ord int"))
    assert {r.key: r.arxiv_id for r in bib.collect()} == {"R": "0601.0001v2", "Rou01": "0601.0001v2", "K1": None}
    found = latex.manual_citations(nodes.withColumn("text", F.col("content")), bib, ["paper", "id"]).collect()
    assert ("lemma:l2", "Rou01") in [(r.id, r.token) for r in found]


def test_ams_tex(spark):
    tex = "\\proclaim{Theorem 1.} Body \\demo{Proof} P \\enddemo \\endproclaim"
    df = latex.normalized(spark.createDataFrame([("p", tex), ("q", "\\documentclass{a} \\demo")], "paper string, text string"))
    got = {r.paper: r for r in df.collect()}
    assert got["q"].text == "\\documentclass{a} \\demo" and got["p"].dialect == "ams_tex"
    assert [r["kind"] for r in latex.parse_environments(got["p"].text)] == ["theorem", "proof"]


def test_files(spark, tmp_path):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name in ("a.tex", "../evil.tex"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as zf:
        zf.writestr("b.tex", "zip")
    rows = [("t", data.getvalue()), ("z", z.getvalue()), ("g", gzip.compress(b"\\begin{document}")), ("bad", b"\x1f\x8bxx"), ("p", b"\\documentclass{a}")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.archive, r.path): r for r in files.archive_members(df).collect()}
    assert ("t", "a.tex") in got and ("t", "../evil.tex") not in got and got["z", "b.tex"].text == "zip" and got["bad", None].error
    assert {r.path: r.k for r in df.select("path", files.file_kind(F.col("content")).alias("k")).collect()} == {"t": "gzip", "z": "zip", "g": "gzip", "bad": "gzip", "p": "tex"}
    for name in ("x/b.tex", "x/a.tex", "y/sub/c.tex"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(name)
    tex = {r.paper: r.text for r in files.combined_tex(spark, str(tmp_path / "src")).collect()}
    assert tex["x"].index("x/a.tex") < tex["x"].index("x/b.tex") and "y/sub/c.tex" in tex["y"]


def test_feed_and_graph(spark, tmp_path):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A
 b</title><summary>S</summary><author><name>X</name></author><author><name>Y</name></author><category term="math.CO" scheme="http://arxiv.org/schemas/atom"/></entry><entry><id>u</id></entry></feed>"""
    got = files.feed_papers(spark.createDataFrame([(xml,), ("<bad",), (None,)], "xml string")).collect()
    assert len(got) == 1 and got[0].arxiv_id == "2401.00001v1" and got[0].title == "A b" and got[0].authors == ["X", "Y"] and got[0].primary_category == "math.CO"
    (tmp_path / "a.json").write_text('{"graph": {"nodes": [{"id": "n"}], "edges": []}}')
    (tmp_path / "b.json").write_text('{"nodes": [{"id": "m"}], "edges": [{"source": "m", "target": "n"}]}')
    nodes, edges = files.graph_files(spark, str(tmp_path), "id: string", "source: string, target: string")
    assert {r.id for r in nodes.collect()} == {"n", "m"} and edges.count() == 1
    n = spark.createDataFrame([("p", "a"), ("p", "b")], "paper string, id string")
    e = spark.createDataFrame([("p", "a", "b", "used_in")], "paper string, source string, target string, dependency_type string")
    assert '"source":"b","target":"a"' in sinks.graph_json(n, e).first().json
    sinks.report(n, str(tmp_path / "md"), "md")
    assert spark.read.text(str(tmp_path / "md")).count() == 4
