"""Printed labels of statements: text lines and source hits matched by place and by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import replaced

# Geometry and similarity bounds.
MARGIN, MAX_DISTANCE, MIN_SIMILARITY, MIN_GAP, WINDOW_LINES = 80.0, 200.0, 0.5, 0.1, 3
LABEL = r"^\s*(Theorem|Lemma|Proposition|Corollary|Definition|Remark|Example|Claim|Conjecture)\s+(\d+(?:\.\d+)*)"


def rect_distance(a: Column, b: Column) -> Column:
    """Distance of two boxes (x0, y0, x1, y1); 0 if they overlap."""
    dx = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"], F.lit(0.0))
    dy = F.greatest(b["y0"] - a["y1"], a["y0"] - b["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def label_lines(lines: DataFrame) -> DataFrame:
    """lines (paper, page, line_no, text, box) that start with a printed label, with the words of three lines."""
    around = Window.partitionBy("paper", "page").orderBy("line_no").rowsBetween(0, WINDOW_LINES - 1)
    words = F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).over(around))
    marked = lines.withColumn("words", F.array_distinct(words)).where(F.col("text").rlike(LABEL))
    return marked.withColumns({"kind": F.lower(F.regexp_extract("text", LABEL, 1)), "number": F.regexp_extract("text", LABEL, 2)})


def nearest_labels(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(paper, id, number): for each source hit (paper, page, id, kind, box) the nearest label of its type on its page, within reach."""
    met = hits.alias("h").join(labels.alias("l"), [F.col("h.paper") == F.col("l.paper"), F.col("h.page") == F.col("l.page"), F.col("h.kind") == F.col("l.kind")])
    near = met.select(F.col("h.paper").alias("paper"), F.col("h.id").alias("id"), "number", rect_distance(F.col("h.box"), F.col("l.box")).alias("d"), "line_no").where(F.col("d") <= MAX_DISTANCE)
    return near.groupBy("paper", "id").agg(F.min_by("number", F.struct("d", "line_no")).alias("number"))


def similar_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(paper, id, number): the label with the most of a node's rare words, if clear of the second. nodes (paper, id, kind, words)."""
    weights = labels.select("paper", F.explode("words").alias("word")).groupBy("paper", "word").agg((1.0 / F.count("*")).alias("w"))
    n = nodes.select("paper", "id", "kind", F.explode(F.array_distinct("words")).alias("word")).join(weights, ["paper", "word"])
    total = n.groupBy("paper", "id").agg(F.sum("w").alias("total"))
    met = n.join(labels.select("paper", "kind", "number", F.explode("words").alias("word")), ["paper", "kind", "word"])
    scored = met.groupBy("paper", "id", "number").agg(F.sum("w").alias("s")).join(total, ["paper", "id"]).withColumn("s", F.col("s") / F.col("total"))
    order = Window.partitionBy("paper", "id").orderBy(F.desc("s"), "number")
    best = scored.withColumns({"place": F.row_number().over(order), "second": F.lead("s", 1, 0.0).over(order)}).where("place = 1")
    return best.where((F.col("s") >= MIN_SIMILARITY) & (F.col("s") - F.col("second") >= MIN_GAP)).select("paper", "id", "number")


def in_order(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(paper, id, number): nodes and labels of a page and type paired in order. nodes (paper, page, id, kind, line_no)."""
    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("paper", "page", "kind").orderBy("line_no")))

    return numbered(nodes).select("paper", "page", "kind", "k", "id").join(numbered(labels).select("paper", "page", "kind", "k", "number"), ["paper", "page", "kind", "k"]).select("paper", "id", "number")


def source_lines(wanted: DataFrame, files: DataFrame, probe: int = 5) -> DataFrame:
    """(paper, line, file, local): the file of a combined line, or of one of the next lines within ``probe``.

    files (paper, file, first, last) are ranges of combined lines.  A range's first line that may answer is reckoned, not
    looked for.  Papers are dealt to tasks: files grow with the papers, and as a plan's estimate of them may be far too
    low, a broadcast would pass them all through the driver.
    """
    at = F.greatest("line", "first")
    met = wanted.select("paper", "line").hint("merge").join(files, "paper").withColumn("at", at)
    met = met.where((F.col("at") <= F.col("line") + probe) & F.col("at").between(F.col("first"), F.col("last")))
    return met.groupBy("paper", "line").agg(F.min_by(F.struct("file", (F.col("at") - F.col("first") + 1).alias("local")), "at").alias("x")).select("paper", "line", "x.*")


# Words that don't tell lines apart, and single letters that do.
LINE_STOP = ["the", "of", "and", "are", "is", "a", "an", "to", "for", "in", "on", "with", "by", "let", "be", "then", "that", "this", "these", "those", "as", "we", "our", "their", "its", "from", "over", "under"]
LINE_LETTERS = ["t", "k", "q", "f", "r", "s", "z"]
# How TeX becomes comparable words, and text without formulas.
TEX_WORDS = [
    (r"\\mathbb\{([A-Za-z])\}_\{?([A-Za-z0-9]+)\}?", "$1$2"),
    (r"\\mathbb\{([A-Za-z])\}", "$1"),
    (r"([A-Za-z])_\{?([A-Za-z0-9]+)\}?", "$1$2"),
    (r"([A-Za-z])\^\{?([A-Za-z0-9]+)\}?", "$1$2"),
    (r"\\[a-zA-Z@]+(\[[^\]]*\])?", " "),
]
TEX_PROSE = [(r"\\[a-zA-Z@]+(\[[^\]]*\])?(\{[^}]*\})?", " "), (r"\\begin\{[^}]+\}|\\end\{[^}]+\}", " "), (r"\$[^$]*\$", " "), (r"\{|\}|\[|\]|\(|\)", " ")]


def line_words(text: Column) -> Column:
    """A printed line in lower case, letters and digits only."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def tex_words(text: Column) -> Column:
    """A TeX text as the line that it prints: commands out, indices joined to their letter."""
    return line_words(replaced(F.coalesce(text, F.lit("")), TEX_WORDS))


def line_tokens(text: Column) -> Column:
    """The words of a line that may tell it apart: longer ones, numbers and some letters."""
    return F.filter(F.split(line_words(text), " "), lambda t: (t != "") & ~t.isin(LINE_STOP) & ((F.length(t) >= 2) | t.rlike("[0-9]") | t.isin(LINE_LETTERS)))


def anchor(text: Column) -> Column:
    """The longest span without formulas: the most words between sentence ends, or the first four words if that has under three."""
    bare = F.trim(F.regexp_replace(replaced(F.coalesce(text, F.lit("")), TEX_PROSE), r"\s+", " "))
    spans = F.filter(F.transform(F.split(bare, r"[.;:!?]\s+"), lambda s: F.trim(s)), lambda s: s != "")
    sized = F.transform(spans, lambda s, k: F.struct((-F.size(F.split(s, r"\s+"))).alias("n"), k.alias("k"), s.alias("s")))
    best = F.array_min(sized)
    return F.coalesce(F.when(best["n"] <= -3, best["s"]).otherwise(F.array_join(F.slice(F.split(bare, " "), 1, 4), " ")), F.lit(""))


def best_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper, page, id, line_no): the line whose distinct words, by their rarity on the page, agree most with a node's.

    nodes (paper, page, id, text), lines (paper, page, line_no, text).  The sum of 1 / (lines with the word) is at least
    ``MIN_SIMILARITY`` and ahead of the second by ``MIN_GAP``.
    """
    each = lines.select("paper", "page", "line_no", F.explode(F.array_distinct(line_tokens(F.col("text")))).alias("w"))
    df = each.groupBy("paper", "page", "w").agg(F.count("*").alias("n"))
    asked = nodes.select("paper", "page", "id", F.explode(F.array_distinct(line_tokens(tex_words(F.col("text"))))).alias("w"))
    scored = asked.join(each, ["paper", "page", "w"]).join(df, ["paper", "page", "w"]).groupBy("paper", "page", "id", "line_no").agg(F.sum(1.0 / F.col("n")).alias("s"))
    order = Window.partitionBy("paper", "page", "id").orderBy(F.desc("s"), "line_no")
    best = scored.withColumns({"place": F.row_number().over(order), "second": F.lead("s", 1, 0.0).over(order)}).where("place = 1")
    return best.where((F.col("s") >= MIN_SIMILARITY) & (F.col("s") - F.col("second") >= MIN_GAP)).select("paper", "page", "id", "line_no")
