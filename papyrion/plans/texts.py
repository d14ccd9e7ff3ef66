"""Queries of the text, TeX, citation, matching and layout operators, on texts rendered from the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions import ids, text
from papyrion.operators import citations, classify, indexing, latex, layout, matching, mentions
from papyrion.plans.catalog import query
from papyrion.sources.tables import table


def _parts(spark, folder) -> DataFrame:
    return table(spark, folder, "part").withColumnsRenamed({"p_partkey": "k", "p_name": "name", "p_brand": "brand", "p_type": "type", "p_size": "size"})


#: Tasks of queries that work long on each row of a small file.
PARTS = 64


def _joined(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])


def _c(name: str):
    return (F.col(name),)


# TeX


@query(r"""
    SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'latex' WHEN 1 THEN 'ams_tex' WHEN 2 THEN 'plain_tex' ELSE 'unknown' END AS dialect,
           CASE WHEN p_size % 3 = 0 THEN 'theorem' WHEN p_size % 3 = 1 THEN 'corollary' ELSE 'unknown' END AS kind,
           'Intro ' || p_name || ' ' || p_brand || ' end' AS cleaned
    FROM part""")
def tex_scalars(spark, folder):
    p = _parts(spark, folder)
    head = F.when(F.col("size") % 4 == 0, "\\documentclass{article}").when(F.col("size") % 4 == 1, "\\input AmsTeX \\Demo").when(F.col("size") % 4 == 2, "x \\bye").otherwise("plain words")
    title = F.when(F.col("size") % 3 == 0, "Main Theorem of Lemmas").when(F.col("size") % 3 == 1, "Cor. 2").otherwise("Question")
    body = _joined("\\section*{Intro} \\begin{lemma}\\label{a}", _c("name"), " \\item \\label{b} ", _c("brand"), " end\\end{lemma}")
    return p.select("k", text.dialect(head).alias("dialect"), text.type_of_title(title).alias("kind"), text.clean_latex(body).alias("cleaned"))


@query("""
    SELECT p_partkey AS k, CAST(p_size % 7 + 1 AS INTEGER) AS line_start, 3 AS col_start, CAST(p_size % 7 + 2 AS INTEGER) AS line_end, 10 AS col_end,
           CAST((p_size % 7) * 2 + 2 AS INTEGER) AS start_offset, CASE WHEN p_size % 2 = 0 THEN 'lemma' ELSE 'theorem' END AS kind FROM part""")
def tex_positions(spark, folder):
    declared = F.when(F.col("size") % 2 == 0, "lem").otherwise("thm")
    doc = F.concat(F.repeat(F.lit("x\n"), (F.col("size") % 7).cast("int")), F.lit("ab\\begin{"), declared, F.lit("}body\n\\end{"), declared, F.lit("}"))
    found = latex.environments(_parts(spark, folder).select("k", doc.alias("text")), "k").join(_parts(spark, folder).select("k", doc.alias("t")), "k")
    return found.select("k", "line_start", "col_start", "line_end", "col_end", indexing.offset_of(F.col("t"), F.col("line_start"), F.col("col_start")).cast("int").alias("start_offset"), "kind")


@query("""
    SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'theorem' WHEN 1 THEN 'definition' END AS kind FROM part WHERE p_size % 3 < 2""")
def declared_environments(spark, folder):
    title = F.when(F.col("size") % 3 == 0, "Main Theorem").when(F.col("size") % 3 == 1, "Working Definition").otherwise("Foobar")
    doc = F.concat(F.lit("\\newtheorem{mine}[equation]{"), title, F.lit("}\n\\newtheorem{mine}{Lemma}\n\\begin{mine}"), F.col("name"), F.lit("\\end{mine}"))
    doc = F.when(F.col("size") % 3 == 2, F.concat(F.lit("\\newtheorem{mine}{"), title, F.lit("}\\begin{mine}"), F.col("name"), F.lit("\\end{mine}"))).otherwise(doc)
    return latex.environments(_parts(spark, folder).select("k", doc.alias("text")), "k").select("k", "kind")


@query("""
    SELECT p_partkey AS k, 'one=' || p_name || ';two=x {' || p_size || '} y;op=lim' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ';three=late' END AS macros FROM part""")
def tex_macros(spark, folder):
    late = F.when(F.col("size") % 2 == 0, "").otherwise("\\def\\three{late}")
    doc = F.concat(_joined("\\newcommand{\\one}{", _c("name"), "}\n\\newcommand{\\two}{old}\\renewcommand{\\two}{x {", _c("size"), "} y}\\newcommand{\\arg}[1]{#1}\\def\\bad{a #1}\n\\DeclareMathOperator{\\op}{lim}"), late, F.lit("\n\\begin{document}\\newcommand{\\body}{no}"))
    pairs = F.array_sort(F.transform(F.map_entries(text.macros(doc)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    names = F.array(*[F.lit(x) for x in ("one", "two", "op", "three", "arg", "bad", "body")])
    # the pairs are bound to a variable, so the macros are read once and not for each name
    order = F.flatten(F.transform(F.array(pairs), lambda found: F.transform(names, lambda n: F.get(F.filter(found, lambda p: F.startswith(p, F.concat(n, F.lit("=")))), F.lit(0)))))
    return _parts(spark, folder).repartition(PARTS).select("k", F.array_join(F.filter(order, lambda x: x.isNotNull()), ";").alias("macros"))


@query(r"""
    SELECT p_partkey AS k, 'the ' || p_name || ' holds here' AS paragraph, CASE WHEN p_size % 2 = 0 THEN 'with $x$ too' ELSE 'X first and x second' END AS single,
           '<b>' || p_name || '</b>: ' || p_type AS needs, CASE WHEN p_size % 2 = 0 THEN 'Reference: ' || p_brand ELSE 'Theorem' END AS shown FROM part""")
def display_columns(spark, folder):
    body = _joined("opening lines\n\nthe ", _c("name"), " holds here\n\nlater ", _c("name"), " again")
    other = F.when(F.col("size") % 2 == 0, "no letter\n\nwith $x$ too\n\nx").otherwise("nothing\n\nX first and x second\n\nx")
    needs = indexing.prerequisites_preview(F.create_map("name", "type"))
    shown = indexing.display_name(F.lit("theorem"), F.col("brand"), F.col("name"), F.col("size") % 2 == 0)
    return _parts(spark, folder).select("k", indexing.context_paragraph(body, F.col("name")).alias("paragraph"), indexing.context_paragraph(other, F.lit("x")).alias("single"), needs.alias("needs"), shown.alias("shown"))


@query(r"""
    SELECT p_partkey AS k, 'a\`b<br>' || repeat('word' || (p_size % 10) || ' xy ', 26) || 'word' || (p_size % 10) || '...' AS preview, p_name AS short FROM part""")
def content_previews(spark, folder):
    body = F.concat(F.lit("a`b\n"), F.repeat(F.concat(F.lit("word"), (F.col("size") % 10).cast("string"), F.lit(" xy ")), 40))
    return _parts(spark, folder).select("k", text.preview(body).alias("preview"), text.preview(F.col("name")).alias("short"))


@query("""
    SELECT p_brand AS paper, 'K' || p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'A. Author, ' || p_name || '. arXiv:2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE 'B. Author, ' || p_name || '.' END AS full_reference,
           CASE WHEN p_size % 2 = 0 THEN '2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS arxiv_id FROM part""")
def bibliography_entries(spark, folder):
    number = F.lpad(F.col("k").cast("string"), 5, "0")
    entry = F.concat(F.lit("\\bibitem{K"), F.col("k").cast("string"), F.lit("} "), F.when(F.col("size") % 2 == 0, F.concat(F.lit("A. Author,\n  "), "name", F.lit(". arXiv:2101."), number)).otherwise(F.concat(F.lit("B. Author, "), "name", F.lit("."))), F.lit("\n"))
    p = _parts(spark, folder).select(F.col("brand").alias("paper"), "k", entry.alias("text"))
    bbl = p.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text")).withColumns({"priority": F.lit(1), "file_ord": F.lit(0)})
    bib = bbl.select("paper", F.lit("@article{Other, title={not used}}").alias("text"), F.lit(2).alias("priority"), F.lit(1).alias("file_ord"))
    return latex.bibliography(bbl.withColumn("text", F.concat("text", F.lit("\\end{thebibliography}"))).unionByName(bib))


@query("""
    SELECT p_partkey AS k, 'K' || (p_partkey % 5) AS token FROM part WHERE p_size % 2 = 0 UNION SELECT p_partkey, 'K7' FROM part WHERE p_size % 3 = 0""")
def bracket_citations(spark, folder):
    body = F.concat(F.lit("see "), F.when(F.col("size") % 2 == 0, F.concat(F.lit("[K"), (F.col("k") % 5).cast("string"), F.lit(", Thm. 2]"))).otherwise("[Z9]"), F.when(F.col("size") % 3 == 0, " or (cf. K7)").otherwise(" or (K9x)"))
    nodes = _parts(spark, folder).select(F.lit("p").alias("paper"), "k", body.alias("text"))
    bib = nodes.sparkSession.range(10).select(F.lit("p").alias("paper"), F.concat(F.lit("K"), F.col("id").cast("string")).alias("key"))
    return latex.manual_citations(nodes, bib, ["paper", "k"]).select("k", "token")


@query("""
    WITH p AS (SELECT *, p_partkey % 3 AS r FROM part)
    SELECT p_partkey AS k, 'external' AS kind, 'K' || p_size AS target, CASE WHEN r = 1 THEN 'p. 2' END AS note FROM p WHERE r > 0
    UNION ALL SELECT p_partkey, 'internal', 'thm:' || p_size, NULL FROM p WHERE r < 2""")
def tex_references(spark, folder):
    r = F.col("k") % 3
    inner, outer = _joined("by \\Cref{thm:", _c("size"), "} we"), F.concat(F.lit("\\citep"), F.when(r == 1, "[p. 2]").otherwise(""), F.lit("{K"), F.col("size").cast("string"), F.lit("}"))
    body = F.concat_ws(" ", F.when(r < 2, inner), F.when(r > 0, outer))
    return latex.references(_parts(spark, folder).select("k", body.alias("text")), ["k"]).select("k", "kind", "target", "note")


@query("""
    SELECT p_partkey AS paper, 'theorem:a' AS id, CASE WHEN p_size % 2 = 0 THEN 'by label' ELSE 'near' END AS proof FROM part
    UNION ALL SELECT p_partkey, 'lemma:b', CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'by label' END FROM part""")
def labelled_proofs(spark, folder):
    label = F.when(F.col("size") % 2 == 0, "a").otherwise("b")
    near = F.when(F.col("size") % 2 == 0, "").otherwise("\n\\begin{proof}near\\end{proof}")
    doc = F.concat(F.lit("\\begin{theorem}\\label{a}A\\end{theorem}"), near, F.lit("\\begin{lemma}\\label{b}B\\end{lemma}\\begin{proof}[Proof of \\ref{"), label, F.lit("}]by label\\end{proof}"))
    return latex.link_proofs(latex.environments(_parts(spark, folder).select(F.col("k").alias("paper"), doc.alias("text")))).select("paper", "id", "proof")


@query("""
    SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'theorem' ELSE 'proposition' END AS kind, 'Stated ' || p_name AS content, 'Shown ' || p_type AS proof FROM part""")
def ams_blocks(spark, folder):
    title = F.when(F.col("size") % 2 == 0, "Theorem 1.").otherwise("Prop 2")
    doc = F.concat(F.lit("\\input amstex \\proclaim{"), title, F.lit("} Stated "), F.col("name"), F.lit(" \\demo Shown "), F.col("type"), F.when(F.col("size") % 3 == 0, "\\enddemo \\bye").otherwise("\\enddemo\\endproclaim \\bye"))
    rows = latex.normalized(_parts(spark, folder).select(F.col("k").alias("paper"), doc.alias("text")))
    return latex.link_proofs(latex.environments(rows)).select(F.col("paper").alias("k"), "kind", "content", "proof")


@query(r"""
    WITH c AS (SELECT l_orderkey AS paper, l_linenumber AS k, CAST(l_partkey AS VARCHAR) AS n, (l_linenumber + l_partkey) % 5 AS t FROM lineitem),
    m AS (SELECT *, CASE t WHEN 0 THEN '\begin{thm}[part ' || n || ']\label{t:' || n || '} é ' || n || ' \end{thm}' WHEN 1 THEN '\begin{lem}a\begin{lem}' || n || '\end{lem}c\end{lem}'
            WHEN 2 THEN '\begin{claim}p' || n || '\begin{proof}q\end{claim}r\begin{remark}s' || n || '\end{remark}t\end{proof}' WHEN 3 THEN '\begin{Def}x \begin{cor*} y' || chr(10) || n || '\end{cor*}'
            ELSE '\end{fact}' || chr(10) || '\begin{figure}\begin{example} 5\% ' || n || '\end{example}\end{figure}' END || chr(10) AS cell FROM c),
    a AS (SELECT *, row_number() OVER w AS place, sum(length(cell)) OVER w - length(cell) AS base FROM m WINDOW w AS (PARTITION BY paper ORDER BY k, n ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT paper, string_agg(cell, '' ORDER BY place) AS doc FROM a GROUP BY paper),
    b AS (SELECT paper, place, base, cell, 'theorem' AS kind, 'part ' || n AS option, 't:' || n AS label, rtrim(cell, chr(10)) AS block, '\label{t:' || n || '} é ' || n AS content FROM a WHERE t = 0
      UNION ALL SELECT paper, place, base, cell, 'lemma', NULL, NULL, rtrim(cell, chr(10)), 'a\begin{lem}' || n || '\end{lem}c' FROM a WHERE t = 1
      UNION ALL SELECT paper, place, base, cell, 'claim', NULL, NULL, '\begin{claim}p' || n || '\begin{proof}q\end{claim}', 'p' || n || '\begin{proof}q' FROM a WHERE t = 2
      UNION ALL SELECT paper, place, base, cell, 'remark', NULL, NULL, '\begin{remark}s' || n || '\end{remark}', 's' || n FROM a WHERE t = 2
      UNION ALL SELECT paper, place, base, cell, 'corollary', NULL, NULL, '\begin{cor*} y' || chr(10) || n || '\end{cor*}', 'y' || chr(10) || n FROM a WHERE t = 3
      UNION ALL SELECT paper, place, base, cell, 'example', NULL, NULL, '\begin{example} 5\% ' || n || '\end{example}', '5\% ' || n FROM a WHERE t = 4),
    s AS (SELECT *, CAST(base + strpos(cell, block) - 1 AS BIGINT) AS start FROM b),
    e AS (SELECT *, start + length(block) AS "end" FROM s),
    f AS (SELECT e.*, string_split(left(doc, start), chr(10)) AS l0, string_split(left(doc, "end"), chr(10)) AS l1 FROM e JOIN d USING (paper))
    SELECT paper, kind, label, option, content, start, "end", CAST(len(l0) AS INTEGER) AS line_start, CAST(length(l0[-1]) + 1 AS INTEGER) AS col_start, CAST(len(l1) AS INTEGER) AS line_end, CAST(length(l1[-1]) + 1 AS INTEGER) AS col_end,
           CASE WHEN label IS NOT NULL THEN kind || ':' || label ELSE kind || '-' || row_number() OVER (PARTITION BY paper ORDER BY start) || '-' || left(sha1(kind || '|' || start || '|' || "end"), 8) END AS id FROM f""")
def nested_environments(spark, folder):
    """Documents whose blocks are nested, crossing, starred, never closed, commented out or inside other environments."""
    n, t = F.col("l_partkey").cast("string"), (F.col("l_linenumber") + F.col("l_partkey")) % 5
    cells = [
        F.concat(F.lit("\\begin{thm}[part "), n, F.lit("]\\label{t:"), n, F.lit("} é "), n, F.lit(" \\end{thm}")),
        F.concat(F.lit("\\begin{lem}a\\begin{lem}"), n, F.lit("\\end{lem}c\\end{lem}")),
        F.concat(F.lit("\\begin{claim}p"), n, F.lit("\\begin{proof}q\\end{claim}r\\begin{remark}s"), n, F.lit("\\end{remark}t\\end{proof}")),
        F.concat(F.lit("\\begin{Def}x \\begin{cor*} y\n"), n, F.lit("\\end{cor*}")),
        F.concat(F.lit("\\end{fact}% \\begin{fact} "), n, F.lit("\n\\begin{figure}\\begin{example} 5\\% "), n, F.lit("\\end{example}\\end{figure}")),
    ]
    cell = F.concat(F.coalesce(*[F.when(t == k, c) for k, c in enumerate(cells)]), F.lit("\n"))
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", n.alias("n"), cell.alias("cell")))).alias("c"))
    return latex.environments(rows.select("paper", F.array_join(F.transform("c", lambda x: x.cell), "").alias("text")))


# Citations in prose


PROSE = "'By Theorem ' || (p_size % 9 + 1) || '.2 and Lem. ' || p_size || ' we use Lemma Zorn Main, then Theorem the rest; cf. Prop. Weil Deligne Bound.'"


def _prose():
    return F.concat(F.lit("By Theorem "), (F.col("size") % 9 + 1).cast("string"), F.lit(".2 and Lem. "), F.col("size").cast("string"), F.lit(" we use Lemma Zorn Main, then Theorem the rest; cf. Prop. Weil Deligne Bound."))


@query("""
    SELECT p_partkey AS k, 'theorem' AS kind, (p_size % 9 + 1) || '.2' AS number, 'Theorem ' || (p_size % 9 + 1) || '.2' AS raw FROM part
    UNION ALL SELECT p_partkey, 'lemma', CAST(p_size AS VARCHAR), 'Lem. ' || p_size FROM part""")
def explicit_references(spark, folder):
    return _parts(spark, folder).select("k", F.inline(text.numbered_refs(_prose())))


@query("SELECT p_partkey AS k, x.kind, x.name FROM part, (VALUES ('lemma', 'Zorn Main'), ('proposition', 'Weil Deligne Bound')) x(kind, name)")
def named_references(spark, folder):
    found = citations.source_refs([_prose(), F.lit(None).cast("string")])
    return _parts(spark, folder).select("k", F.inline(found["named_refs"])).select("k", "kind", "name")


@query("""
    SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'Ab' || p_size || '|Smith ' || (1950 + p_size) || '|Smith, ' || (1950 + p_size) WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'Smith ' || (1950 + p_size) || '|Smith, ' || (1950 + p_size) END AS labels FROM part""")
def entry_labels(spark, folder):
    year = (F.col("size") + 1950).cast("string")
    entry = F.when(F.col("size") % 3 == 0, F.concat(F.lit("[Ab"), F.col("size").cast("string"), F.lit("] Smith, J. On things, "), year)).when(F.col("size") % 3 == 1, F.concat(F.col("size").cast("string"), F.lit(". without a date"))).otherwise(F.concat(F.lit("Smith, J. On things, "), year))
    return _parts(spark, folder).select("k", F.array_join(citations.entry_labels(F.when(F.col("size") % 3 == 0, F.regexp_replace(entry, r"\] Smith", "] by Smith")).otherwise(entry)), "|").alias("labels"))


@query("SELECT p_partkey AS k FROM part WHERE p_size % 3 <> 1")
def title_entries(spark, folder):
    entry = F.when(F.col("size") % 3 == 0, F.concat(F.lit("Doe, J.: The "), F.upper("name"), F.lit(" of Everything, 2001"))).when(F.col("size") % 3 == 1, "Roe, A.: Another subject as a whole").otherwise(F.concat(F.lit("the "), "name", F.lit(" of everythin")))
    rows = _parts(spark, folder).select("k", entry.alias("text"), F.concat(F.lit("The "), "name", F.lit(" of everything")).alias("title"))
    return citations.entries_of_title(rows, "title").select("k")


@query("""
    SELECT p_partkey AS k, sha256('W' || p_partkey || '||' || p_name || '|[' || p_size || ']|body') AS mention_id,
           p_name || ' is used, see and with for ' || p_type AS context,
           CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END || ' ' || p_name AS stitched FROM part""")
def mention_contexts(spark, folder):
    mention = citations.mention_id(F.concat(F.lit("W"), F.col("k").cast("string")), F.lit(None), F.col("name"), F.concat(F.lit("["), F.col("size").cast("string"), F.lit("]")), F.lit("body"))
    raw = F.concat("name", F.lit(" is used, see [Ab12, p. 3] Theorem 1.3(ii) and § 3.2 with Section 4 (2.1) MR 1234 for "), "type")
    html = F.concat(F.lit("<p>"), F.when(F.col("size") % 2 == 0, "a").otherwise("b"), F.lit("</p><b>"), "name", F.lit("</b>"))
    return _parts(spark, folder).select("k", mention.alias("mention_id"), citations.sanitised(raw).alias("context"), citations.query_context(F.lit(None), F.lit(""), F.lit(None), html).alias("stitched"))


@query("""
    SELECT p_partkey AS doc, CASE p_size % 3 WHEN 0 THEN '[Ab12]' WHEN 1 THEN 'Smith (2001)' ELSE '(7)' END AS found,
           'First of ' || p_name || '.' AS context_prev, CASE WHEN p_size % 2 = 0 THEN 'explicit' ELSE 'implicit' END AS reference_precision FROM part""")
def sentence_mentions(spark, folder):
    mark = F.when(F.col("size") % 3 == 0, "[Ab12]").when(F.col("size") % 3 == 1, "Smith (2001)").otherwise("(7)")
    label = F.when(F.col("size") % 3 == 0, "Ab12").when(F.col("size") % 3 == 1, "Smith 2001").otherwise("7")
    said = F.when(F.col("size") % 2 == 0, " by Theorem 3").otherwise("")
    body = F.concat(F.lit("First of "), "name", F.lit(". Here we follow "), mark, said, F.lit(" closely. Then "), mark, F.lit(" again."))
    p = _parts(spark, folder).withColumn("doc", F.col("k"))
    out = citations.label_mentions(p.select("doc", F.lit(0).alias("par"), body.alias("text")), p.select("doc", label.alias("label")))
    return out.select("doc", F.regexp_extract("context_sentence", r"follow (\[Ab12\]|Smith \(2001\)|\(7\))", 1).alias("found"), "context_prev", "reference_precision")


@query("SELECT l_orderkey AS doc, 'b' || l_suppkey AS bib_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 2 = 0 GROUP BY 1, 2")
def anchor_mentions(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("#b"), F.col("l_suppkey").cast("string")).alias("href"), (F.col("l_linestatus") == "F").alias("in_bibliography"), F.col("l_partkey").cast("string").alias("sentence"))
    entries = li.select("doc", F.substring("href", 2, 99).alias("bib_id")).distinct().where(F.substring("bib_id", 2, 99).cast("int") % 2 == 0).withColumn("text", F.lit("entry"))
    return citations.anchor_mentions(li, entries).groupBy("doc", "bib_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, p_size % 7 < 6 AS leaky, p_size % 7 = 5 OR p_size % 2 = 0 AS long FROM part")
def leaky_queries(spark, folder):
    n = F.col("size") % 7
    q = F.when(n == 0, "Where is Theorem 2.1 shown?").when(n == 1, "What does Section 4 say?").when(n == 2, "Is it in [Ab12, p. 3]?").when(n == 3, "Does condition (ii) hold?").when(n == 4, F.concat(F.lit("Where does "), F.upper("name"), F.lit(" stand?"))).when(n == 5, "").otherwise(F.concat(F.lit("Which "), "type", F.lit(" has this property?")))
    long = F.when((F.col("size") % 2 == 0) & (n != 5), F.concat(q, F.repeat(F.lit(" and more"), 16))).otherwise(q)
    return _parts(spark, folder).select("k", classify.is_leaky(q, F.col("name")).alias("leaky"), classify.is_too_long(long).alias("long"))


@query("""
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'no_latex_source' WHEN 1 THEN 'extractor_error' WHEN 2 THEN 'invalid_arxiv_id' WHEN 3 THEN 'llm_rate_limited' WHEN 4 THEN 'llm_timeout' WHEN 5 THEN 'llm_connection_error' ELSE 'unexpected_error' END AS code,
           CASE event_id % 7 WHEN 0 THEN 'extract' WHEN 1 THEN 'extract' WHEN 2 THEN 'download' WHEN 6 THEN 'unknown' ELSE 'llm' END AS stage FROM events""")
def processing_errors(spark, folder):
    n = F.col("event_id") % 7
    kind = F.when(n < 2, "ArxivExtractorError").when(n == 2, "ValueError").when(n == 3, "RateLimitError").when(n == 4, "ReadTimeout").when(n == 5, "ConnectError").otherwise("KeyError")
    message = F.when(n == 0, "this paper is PDF-only").when(n == 1, "something else").when(n == 2, "Invalid arXiv ID format: x").when(n == 3, "Rate limit reached").otherwise("")
    return table(spark, folder, "events").select("event_id", classify.processing_error(kind, message).alias("e")).select("event_id", "e.*")


@query("SELECT coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'unknown') AS stage, count(*) AS n FROM events GROUP BY 1")
def failures_by_stage(spark, folder):
    return classify.failures_by_stage(table(spark, folder, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("stage")))


@query(r"""
    SELECT p_partkey AS k, 'https://openalex.org/W' || p_partkey AS work, 'a+b' || p_size AS query_key,
           'submittedDate:[200001010000 TO 200001312359]' AS month, '2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS in_text, p_size % 2 = 0 AS is_url, p_size % 2 = 1 AS valid FROM part""")
def identifier_forms(spark, folder):
    p = _parts(spark, folder)
    number = F.lpad(F.col("k").cast("string"), 5, "0")
    work = F.concat(F.when(F.col("size") % 2 == 0, "https://api.openalex.org/works/w").otherwise("W"), F.col("k").cast("string"), F.when(F.col("size") % 3 == 0, "?x=1#y").otherwise(""))
    ref = F.when(F.col("size") % 2 == 0, "see http://a.b/c").otherwise("see https://doi.org/10.1")
    return p.select("k", ids.work_id(work).alias("work"), ids.query_key(F.concat(F.lit(" A B"), F.col("size").cast("string"), F.lit(" "))).alias("query_key"), ids.month_clause(F.lit("2000-01-17").cast("date")).alias("month"),
                    ids.id_in_reference(F.concat(F.lit("in arXiv:2101."), number)).alias("in_text"), ids.is_url_reference(ref).alias("is_url"), ids.is_valid_id(F.when(F.col("size") % 2 == 1, F.concat(F.lit(" 2101."), number, F.lit("v2"))).otherwise("2101.1")).alias("valid"))


# Matching


@query("""
    WITH t AS (SELECT p_partkey AS k, p_size, lower(p_name || ' ' || p_type || ' in the theory of ' || p_brand) AS title FROM part), f AS (SELECT title, min(k) AS work FROM t GROUP BY 1)
    SELECT k AS key, CASE WHEN p_size % 5 = 0 THEN 'direct_regex' WHEN p_size % 5 = 1 THEN 'none' ELSE 'search' END AS method,
           CASE WHEN p_size % 5 = 0 THEN '9901.' || lpad(CAST(k AS VARCHAR), 5, '0') WHEN p_size % 5 > 1 THEN '2101.' || lpad(CAST(work AS VARCHAR), 5, '0') END AS arxiv_id,
           CASE WHEN p_size % 5 > 1 THEN 1.0::DOUBLE END AS title_score, CASE WHEN p_size % 5 > 1 THEN 1.0::DOUBLE END AS author_overlap FROM t JOIN f USING (title)""")
def matched_references(spark, folder):
    title = F.concat("name", F.lit(" "), "type", F.lit(" in the theory of "), F.regexp_replace("brand", "#", " "))
    n = F.col("size") % 5
    direct = F.concat(F.lit("J. Doe, Some paper, arXiv:9901."), F.lpad(F.col("k").cast("string"), 5, "0"), F.lit("v2"))
    written = F.concat(F.when(n == 1, "A. Nobody").otherwise("J. Doe and M. Roe"), F.when(n == 3, F.concat(F.lit(", \\emph{"), title, F.lit("}, 2001."))).otherwise(F.concat(F.lit(', "'), title, F.lit('", Journal of Things, 2001.'))))
    refs = _parts(spark, folder).select(F.col("k").alias("key"), F.when(n == 0, direct).otherwise(written).alias("text"))
    works = _parts(spark, folder).select(F.col("k").alias("work"), title.alias("title"), F.array(F.lit("Doe, John"), F.lit("Mary Roe")).alias("authors"), F.concat(F.lit("2101."), F.lpad(F.col("k").cast("string"), 5, "0")).alias("arxiv_id"))
    return matching.match_references(refs, works)


@query("""
    WITH t AS (SELECT DISTINCT p_name || ' ' || p_type AS a FROM part)
    SELECT x.a AS key, y.a AS work FROM t x JOIN t y ON x.a = y.a""")
def equal_titles(spark, folder):
    """At a ratio of one only equal titles meet, however many works share one."""
    t = _parts(spark, folder).select(F.concat_ws(" ", "name", "type").alias("key")).distinct()
    forms = t.withColumn("form", matching.normalize_title("key"))
    return matching.similar_titles(forms, forms.select(F.col("key").alias("work"), F.col("form").alias("title_form")), 0.999).select("key", "work")


@query("""
    WITH w AS (SELECT *, sha256('{"authors": ["' || lower(replace(p_brand, '#', ' ')) || '", "jose a"], "title": "' || lower(p_name) || '"}') AS cache_key FROM part)
    SELECT p_name AS title, p_brand AS brand, p_size % 5 AS spelling, cache_key, bool_or(p_size % 6 = 0) OVER (PARTITION BY cache_key) AS hit FROM w QUALIFY row_number() OVER (PARTITION BY p_name, p_brand, p_size % 5) = 1""")
def match_cache(spark, folder):
    """Works asked for in several spellings (braces, commands, accents, the order of names); replies are stored under another one."""
    p = _parts(spark, folder).select("k", "size", "brand", "name", (F.col("size") % 5).alias("spelling"))
    title = F.when(F.col("spelling") == 0, F.initcap("name")).when(F.col("spelling") == 1, F.concat(F.lit("{\\textit{"), "name", F.lit("}}"))).when(F.col("spelling") == 2, F.concat("name", F.lit(".  $x^2$"))).otherwise(F.col("name"))
    second = F.when(F.col("spelling") == 0, "A, José").when(F.col("spelling") == 1, "José A.").otherwise("jose a")
    wanted = p.select("*", title.alias("title"), F.array(F.col("brand"), second, F.when(F.col("spelling") == 3, " ").otherwise("")).alias("authors"))
    cache = p.where("size % 3 = 0").select(matching.match_key(F.upper("name"), F.array("brand", F.lit("a, jose"))).alias("cache_key"), F.when(F.col("size") % 2 == 0, 5).otherwise(0).alias("ts"), F.lit("stored").alias("reply"))
    found = matching.cached_matches(wanted, cache.where("ts = 5").distinct().unionByName(cache.where("ts = 0")), F.lit(1))
    return found.groupBy(F.col("name").alias("title"), "brand", F.col("spelling"), "cache_key").agg((F.count_if(F.col("reply").isNotNull()) > 0).alias("hit"))


@query("""
    SELECT p_brand AS id, arg_max(p_partkey, (CASE WHEN p_size % 2 = 0 THEN 0.95 ELSE 0.93 END, 1.0, p_size, -p_partkey)) AS work FROM part WHERE p_size % 3 > 0 GROUP BY 1""")
def best_works(spark, folder):
    score = F.when(F.col("size") % 3 == 0, 0.5).when(F.col("size") % 2 == 0, 0.95).otherwise(0.93)
    pairs = _parts(spark, folder).select(F.col("brand").alias("id"), F.col("k").alias("work"), score.alias("title_score"), F.lit(1.0).alias("author_overlap"), F.col("size").alias("cited"), F.col("k").alias("ord"))
    return matching.best_matches(pairs, "id", "work", 0.92, 0.1).select("id", "work")


@query("SELECT p_partkey AS k, lower(p_name) || ' a b' AS form, 'doe|roe' AS last, 0.5::DOUBLE AS shared FROM part")
def normal_forms(spark, folder):
    title = F.concat(F.lit("\\emph{"), F.initcap("name"), F.lit("} $x^2$ Á—b"))
    mine, theirs = F.array(F.lit("Doe, John"), F.lit("Mary Róe")), F.array(F.lit("J. Doe"), F.lit("A. Poe"))
    p = _parts(spark, folder).select("k", matching.normalize_title(title).alias("form"), matching.last_names(mine).alias("a"), matching.last_names(theirs).alias("b"))
    return p.select("k", "form", F.array_join("a", "|").alias("last"), matching.overlap(F.col("a"), F.col("b")).alias("shared"))


# Pages and printed labels


@query("SELECT DISTINCT l_orderkey AS paper, 'n' || l_linenumber AS id, l_linenumber || '.1' AS number FROM lineitem WHERE l_linenumber <= 3")
def printed_labels(spark, folder):
    """A page per order: a label line every hundred points, and a hit just below each."""
    box = F.struct(F.lit(0.0).alias("x0"), (F.col("l_linenumber") * 100.0).alias("y0"), F.lit(10.0).alias("x1"), (F.col("l_linenumber") * 100.0 + 10).alias("y1"))
    low = F.struct(F.lit(5.0).alias("x0"), (F.col("l_linenumber") * 100.0 + 12).alias("y0"), F.lit(6.0).alias("x1"), (F.col("l_linenumber") * 100.0 + 14).alias("y1"))
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), "l_linenumber").distinct()
    lines = li.select("paper", F.lit(1).alias("page"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("Lemma "), F.col("l_linenumber").cast("string"), F.lit(".1. Words")).alias("text"), box.alias("box"))
    hits = li.where("l_linenumber <= 3").select("paper", F.lit(1).alias("page"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("lemma").alias("kind"), low.alias("box"))
    return layout.nearest_labels(hits, layout.label_lines(lines))


@query("""
    WITH n AS (SELECT l_orderkey AS paper, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    SELECT paper, 'n' || l_linenumber AS id, CAST(k AS VARCHAR) AS number FROM n""")
def labels_in_order(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line_no")).distinct().withColumns({"page": F.lit(1), "kind": F.lit("lemma")})
    sizes = li.groupBy("paper", "page", "kind").agg(F.count("*").alias("n"))
    labels = sizes.select("paper", "page", "kind", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("line_no")).withColumn("number", F.col("line_no").cast("string"))
    return layout.in_order(li.withColumn("id", F.concat(F.lit("n"), F.col("line_no").cast("string"))), labels)


@query("""
    SELECT p_partkey AS paper, CAST(p_size AS INTEGER) AS line, CASE WHEN p_size <= 20 THEN 'a.tex' ELSE 'b.tex' END AS file, CAST(CASE WHEN p_size <= 20 THEN p_size ELSE greatest(p_size, 24) - 23 END AS INTEGER) AS local
    FROM part WHERE p_size <= 20 OR p_size >= 21""")
def combined_lines(spark, folder):
    p = _parts(spark, folder).select(F.col("k").alias("paper"), F.col("size").alias("line"))
    files = p.select("paper", F.inline(F.array(F.struct(F.lit("a.tex").alias("file"), F.lit(1).alias("first"), F.lit(20).alias("last")), F.struct(F.lit("b.tex").alias("file"), F.lit(24).alias("first"), F.lit(99).alias("last")))))
    return layout.source_lines(p, files).select("paper", F.col("line").cast("int").alias("line"), "file", F.col("local").cast("int").alias("local"))


@query(r"""
    SELECT p_partkey AS k, 'z' || p_size || ' in r2 big ' || lower(p_name) AS canonical, p_name || ' of this size' AS anchor, 'z' || p_size || ' r2 big' AS tokens FROM part""")
def tex_anchors(spark, folder):
    body = F.concat(F.lit("\\mathbb{Z}_{"), F.col("size").cast("string"), F.lit("} in $r^2$ \\textbf{big} "), "name")
    prose = F.concat(F.lit("\\emph{x} Short. "), "name", F.lit(" of this size; $a$ end"))
    words = layout.line_tokens(F.concat(F.lit("The Z"), F.col("size").cast("string"), F.lit(" in r2, a big")))
    return _parts(spark, folder).select("k", layout.tex_words(body).alias("canonical"), layout.anchor(prose).alias("anchor"), F.array_join(words, " ").alias("tokens"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a\\s[^>]*?href=\"')) AS INTEGER) > 0 AS any_link FROM pages".replace("\\\\", "\\"))
def page_links(spark, folder):
    return mentions.page_texts(table(spark, folder, "pages")).select("page_id", (F.size("links") > 0).alias("any_link"))
