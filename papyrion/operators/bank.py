"""Definition bank of papers: clean terms, dependencies between definitions, requirements and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import canonical, normal_term
from papyrion.operators.definitions import base_by_parameter, base_by_suffix, contained_terms
from papyrion.operators.indexing import context_paragraph


def clean_terms(terms: Column) -> Column:
    """Sorted distinct terms without control characters, doubled backslashes, white space at the ends and one last stop or comma."""
    def clean(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), r"\\{2,}", r"\\\\")
        return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"[.,]$", "")

    return F.array_sort(F.array_distinct(F.filter(F.transform(terms, clean), lambda t: t.isNotNull() & (t != ""))))


def definition_dependencies(definitions: DataFrame) -> DataFrame:
    """(paper, term, depends_on): definitions whose canonical text holds another term of the paper at word borders.

    definitions (paper, term, definition_text).  Terms and texts meet by ``contained_terms`` within a paper.
    """
    marked = definitions.withColumn("scope", F.sha2(F.col("paper").cast("string"), 256))

    def scoped(c: str) -> Column:
        """Each word after its paper, so that only words of one paper are alike."""
        return F.array_join(F.transform(F.split(canonical(F.col(c)), " "), lambda w: F.concat(F.col("scope"), F.lit("_"), w)), " ")

    texts = marked.select(F.struct("paper", "term").alias("text_id"), scoped("definition_text").alias("text"))
    terms = marked.where(canonical(F.col("term")) != "").select(F.struct("paper", "term").alias("term_id"), scoped("term").alias("term"))
    found = contained_terms(texts, terms)
    return found.select(F.col("text_id.paper").alias("paper"), F.col("text_id.term").alias("term"), F.col("term_id.term").alias("depends_on")).where("term <> depends_on")


def valid_definitions(proposed: DataFrame, definition: str, context: str) -> DataFrame:
    """Proposals whose definition's canonical form stands in their context's at word borders; a blank one isn't valid."""
    inside = F.contains(F.concat(F.lit(" "), canonical(F.col(context)), F.lit(" ")), F.concat(F.lit(" "), canonical(F.col(definition)), F.lit(" ")))
    return proposed.where(F.coalesce((canonical(F.col(definition)) != "") & inside, F.lit(False)))


def missing_terms(terms: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(paper, term, key, first_artifact, base): terms that no definition or alias of their paper names, with what a synthesis starts from.

    terms (paper, artifact, line, term), definitions (paper, key, ord), aliases (paper, alias).
    The base is the defined term that is the longest suffix, else the longest one that differs in one word.
    """
    keyed = terms.withColumn("key", normal_term(F.col("term")))
    known = definitions.select("paper", "key").union(aliases.select("paper", F.col("alias"))).distinct()
    new = keyed.join(known, ["paper", "key"], "left_anti").groupBy("paper", "key").agg(F.min_by(F.struct("artifact", "term"), F.struct("line", "artifact", "term")).alias("x"))
    rows = new.select("paper", F.col("x.term").alias("term"), "key", F.col("x.artifact").alias("first_artifact"))
    by_suffix = base_by_suffix(rows, definitions, ("paper",)).withColumnRenamed("base", "b1")
    by_word = base_by_parameter(rows, definitions, ("paper",)).withColumnRenamed("base", "b2")
    rows = rows.join(by_suffix, ["paper", "term"], "left").join(by_word, ["paper", "term"], "left")
    return rows.select("paper", "term", "key", "first_artifact", F.coalesce("b1", "b2").alias("base"))


def ordered_prerequisites(requirements: DataFrame, definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper, artifact, prerequisites array<struct<term, text>>): in the order of the line where the term's source stands.

    requirements (paper, artifact, term), definitions (paper, term, text, source), nodes (paper,
    id, line).  Terms without a known source come first; equal lines by term.  An artifact's terms are few.
    """
    lines = nodes.select("paper", F.col("id").alias("source"), "line")
    known = definitions.select("paper", "term", "text", "source").join(lines, ["paper", "source"], "left")
    rows = requirements.select("paper", "artifact", "term").distinct().join(known, ["paper", "term"])
    item = F.struct(F.coalesce("line", F.lit(0)).alias("line"), "term", "text")
    return rows.groupBy("paper", "artifact").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["term"].alias("term"), x["text"].alias("text"))).alias("prerequisites"))


def synthesis_context(tex: Column, start: Column, term: Column, artifact: Column) -> Column:
    """What a definition is made from: the paragraph of the term's first occurrence in the body before the artifact, and the artifact."""
    before = F.substring(tex, F.lit(1), start.cast("int"))
    body = F.when(F.contains(before, F.lit("\\begin{document}")), F.substring_index(before, "\\begin{document}", -1)).otherwise(before)
    return F.concat_ws("\n\n", F.nullif(context_paragraph(body, term), F.lit("")), F.nullif(artifact, F.lit("")))


def bank_documents(definitions: DataFrame, aliases: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(paper, bank map<key, struct<term, definition_text, source, aliases, dependencies>>): each paper's bank; papers without definitions have no row.

    definitions (paper, key, term, definition_text, source), aliases (paper, key, alias), dependencies (paper, key, depends_on).
    A paper's bank is one document by contract.
    """
    a = aliases.groupBy("paper", "key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    d = dependencies.groupBy("paper", "key").agg(F.array_sort(F.collect_set("depends_on")).alias("dependencies"))
    none = F.array().cast("array<string>")
    rows = definitions.join(a, ["paper", "key"], "left").join(d, ["paper", "key"], "left")
    item = F.struct("term", "definition_text", "source", F.coalesce("aliases", none).alias("aliases"), F.coalesce("dependencies", none).alias("dependencies"))
    return rows.groupBy("paper").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", item.alias("value"))))).alias("bank"))


def enhance(terms: DataFrame, definitions: DataFrame, aliases: DataFrame, proposed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, prerequisites) after the three phases: the bank as it is, valid proposals for missing terms, requirements in order.

    terms (paper, artifact, line, term), definitions (paper, key, ord, text, source), aliases
    (paper, alias, key), proposed (paper, term, text, context), nodes (paper, id, line).
    """
    new = missing_terms(terms, definitions, aliases).select("paper", "term", "key", F.col("first_artifact").alias("source"))
    good = valid_definitions(proposed, "text", "context").groupBy("paper", normal_term(F.col("term")).alias("key")).agg(F.min("text").alias("text"))
    added = new.join(good, ["paper", "key"]).select("paper", "key", F.lit(None).cast("long").alias("ord"), "text", "source")
    bank = definitions.select("paper", "key", F.col("ord").cast("long").alias("ord"), "text", "source").unionByName(added)
    named = bank.select("paper", F.col("key").alias("name"), "key").union(aliases.select("paper", F.col("alias"), "key"))
    needs = terms.select("paper", "artifact", normal_term(F.col("term")).alias("name")).join(named, ["paper", "name"]).select("paper", "artifact", F.col("key").alias("term"))
    return bank, ordered_prerequisites(needs, bank.select("paper", F.col("key").alias("term"), "text", "source"), nodes)
