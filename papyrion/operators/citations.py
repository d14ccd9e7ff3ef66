"""Citations in prose: named references, labels of bibliography entries, mentions, prompts' contexts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.functions.text import REF_KINDS, numbered_refs, quoted, replaced, sentences, without_tags

# References by a statement's name, words that are no names, and names in lower case.
NAMED_REF = r"(Theorem|Th\.?|Thm\.?|Definition|Def\.?|Proposition|Prop\.?|Lemma|Lem\.?|Corollary|Cor\.?)\s+([A-Z][A-Za-z\-\s]{1,60})"
NOT_NAMES = ["the", "a", "an", "general", "criterion", "statement", "result", "construction", "discussion"]
LOWER_NAMES = ["finitude", "finiteness", "sommes", "trig", "trigonometriques", "sommes trig"]
LOWER_REF = r"(?i:(th\.?|thm\.?|theorem)\s*(?:(?:[IVXLCDM]+\s*\.)?\s*\d+(?:\.\d+)*))\s*([a-z][a-z\-]{3,20})"
# What goes from a context before it becomes a prompt.
SANITISING = [
    (r"\[[A-Za-z]{2,}\d{2,}[^\]]*\]", " "),
    (r"\b(?:Theorem|Thm\.?|Lemma|Lem\.?|Proposition|Prop\.?|Corollary|Cor\.?|Definition|Def\.?|Example|Ex\.?|Remark|Rem\.?)\s*\d+(?:\.\d+)*\s*(?:\([ivxIVX]+\))?", " "),
    (r"\b(?:Section|Sec\.?)\s*\d+(?:\.\d+)*\b", " "),
    (r"§\s*\d+(?:\.\d+)*", " "),
    (r"\(\s*\d+(?:\.\d+)*\s*\)", " "),
    (r"\bMR\s*\d+\b", " "),
    (r"(?i)\bDOI:\s*\S+\b", " "),
    (r"\b10\.\d{4,9}/\S+\b", " "),
    (r"(?iu)\bPubl\.\s*Math\.\s*IH[ÉE]S\b", " "),
    (r"(?i)\bInvent\.\s*Math\.\b", " "),
    (r"(?i)\bMath\.\s*Ann\.\b", " "),
    (r"\bJ\.\s*\w+\.\s*Math\.\b", " "),
]
# Characters that count as others when labels are looked for.
MATCHING = {"\u00bd": "1/2", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " "}


def _kind(raw: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in REF_KINDS.items() for x in pair])
    low = F.regexp_replace(F.lower(raw), r"\.$", "")
    return F.coalesce(F.try_element_at(kinds, low), low)


def named_refs(text: Column) -> Column:
    """array<struct<kind, name, raw>> of references such as Theorem Riemann; up to six words, no common first word."""
    p = F.lit(NAMED_REF)
    found = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("k"), F.regexp_extract_all(text, p, F.lit(2)).alias("n"), F.regexp_extract_all(text, p, F.lit(0)).alias("raw"))
    made = F.transform(found, lambda x: F.struct(_kind(x["k"]).alias("kind"), F.trim(x["n"]).alias("name"), x["raw"].alias("raw")))

    def good(x: Column) -> Column:
        words = F.split(x["name"], r"\s+")
        return (x["name"] != "") & ~F.lower(words[0]).isin(NOT_NAMES) & (F.size(words) <= 6)

    q = F.lit(LOWER_REF)
    low = F.arrays_zip(F.regexp_extract_all(text, q, F.lit(1)).alias("k"), F.regexp_extract_all(text, q, F.lit(2)).alias("n"))
    lower = F.transform(F.filter(low, lambda x: x["n"].isin(LOWER_NAMES)), lambda x: F.struct(F.lit("theorem").alias("kind"), x["n"].alias("name"), F.concat_ws(" ", x["k"], x["n"]).alias("raw")))
    return F.concat(F.filter(made, good), lower)


def source_refs(parts: list[Column]) -> Column:
    """Struct of refs, named refs and text of the context fields joined by spaces; null fields are empty."""
    text = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.struct(numbered_refs(text).alias("refs"), named_refs(text).alias("named_refs"), text.alias("text"))


def sanitised(text: Column) -> Column:
    """A context without labels, numbered references and bibliographic details, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(replaced(F.coalesce(text, F.lit("")), SANITISING), r"\s+", " "))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def query_context(previous: Column, sentence: Column, following: Column, html: Column, most: int = 1500) -> Column:
    """The sanitised context of a mention: its three sentences, else its page's text."""
    def some(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    stitched = F.trim(F.concat_ws(" ", some(previous), some(sentence), some(following)))
    page = without_tags(F.coalesce(html, F.lit("")))
    return sanitised(shortened(F.when(stitched != "", stitched).otherwise(F.trim(F.regexp_replace(page, r"\s+", " "))), most))


def mention_id(*fields: Column) -> Column:
    """SHA-256 of the fields joined by bars; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


# Bibliography entries and their labels


def entry_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def entries_of_title(entries: DataFrame, title: str, least: float = 0.9) -> DataFrame:
    """``entries`` (..., text) that hold a title: its normal form is inside theirs, or both are alike.

    Only entries whose length allows the ratio reach Python.
    """
    rows = entries.withColumns({"__e": entry_form(F.col("text")), "__t": entry_form(F.col(title))}).where("__e <> '' and __t <> ''")
    inside = rows.where(F.contains("__e", F.col("__t")))
    bound = 2.0 * F.least(F.length("__e"), F.length("__t")) / (F.length("__e") + F.length("__t")) >= least
    alike = rows.where(~F.contains("__e", F.col("__t")) & bound).where(_ratio("__e", "__t") >= least)
    return inside.unionByName(alike).drop("__e", "__t")


def entry_labels(text: Column) -> Column:
    """array of the labels by which an entry may be cited: [label], (label) or number in front, then surname and year."""
    front = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in (r"^\s*\[(.+?)\]\s*", r"^\s*\((.+?)\)\s*", r"^\s*(\d+)\.\s*")])
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    name = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"^\s*([A-Z][A-Za-z'`-]+)", r"\b([A-Z][A-Za-z'`-]+)\b")])
    dated = name.isNotNull() & year.isNotNull()
    return F.array_distinct(F.filter(F.array(front, F.when(dated, F.concat_ws(" ", name, year)), F.when(dated, F.concat(name, F.lit(", "), year))), lambda x: x.isNotNull()))


def matching_form(text: Column) -> Column:
    for old, new in MATCHING.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def label_pattern(label: Column) -> Column:
    """The pattern by which a label is found: a surname before its year, a number in brackets, else in brackets or as a word."""
    plain = matching_form(label)
    year = F.nullif(F.regexp_extract(plain, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))

    dated = F.concat(F.lit("\\b"), quoted(F.regexp_extract(plain, r"^\s*(\S+)", 1)), F.lit("\\b\\W*"), year, F.lit("\\b"))
    bracketed = F.concat(F.lit("(?:\\["), quoted(plain), F.lit("\\]|\\("), quoted(plain), F.lit("\\)"))
    return F.when(year.isNotNull(), dated).when(plain.rlike(r"^\d+$"), F.concat(bracketed, F.lit(")"))).otherwise(F.concat(bracketed, F.lit("|\\b"), quoted(plain), F.lit("\\b)")))


def label_mentions(paragraphs: DataFrame, labels: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, par, label, context_prev, context_sentence, context_next, explicit_refs, reference_precision): the first sentence of a paragraph with each label of its document.

    paragraphs (doc, par, text), labels (doc, label).  A document's labels are few (those of one
    target's entries), so its sentences meet them by the document.  Labels grow with the documents,
    so both are dealt by the document and labels don't pass through the driver.
    """
    cut = paragraphs.repartition(key).select(key, "par", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    order = Window.partitionBy(key, "par").orderBy("pos")
    rows = cut.withColumns({"context_prev": F.lag("s").over(order), "context_next": F.lead("s").over(order)})
    met = rows.join(labels.select(key, "label").distinct().hint("merge"), key).where(F.regexp_like(matching_form(F.col("s")), label_pattern(F.col("label"))))
    first = met.groupBy(key, "par", "label").agg(F.min_by(F.struct("s", "context_prev", "context_next"), "pos").alias("x"))
    refs = numbered_refs(F.col("x.s"))
    return first.select(key, "par", "label", "x.context_prev", F.col("x.s").alias("context_sentence"), "x.context_next", refs.alias("explicit_refs"), F.when(F.size(refs) > 0, "explicit").otherwise("implicit").alias("reference_precision"))


def anchor_mentions(anchors: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, bib_id, ...): anchors outside the bibliography whose href is #id of an entry; once per document, entry and sentence.

    anchors (doc, href, in_bibliography, sentence), entries (doc, bib_id, text).
    """
    asked = anchors.where(~F.col("in_bibliography") & F.startswith("href", F.lit("#"))).withColumn("bib_id", F.substring("href", 2, 1 << 30))
    return asked.join(entries.select("doc", "bib_id", F.col("text").alias("entry")), ["doc", "bib_id"]).dropDuplicates(["doc", "bib_id", "sentence"]).select("doc", "bib_id", "entry", "sentence")
