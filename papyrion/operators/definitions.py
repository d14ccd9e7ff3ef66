"""Definition bank as tables: lookup, base terms, merging, containment and prerequisites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import canonical, normal_term
from papyrion.workspace import materialize


def find_definitions(terms: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """terms (term) with key: the canonical term it names directly or through an alias; null if none.

    definitions (key), aliases (alias, key).
    """
    asked = terms.withColumn("__k", normal_term(F.col("term")))
    direct = definitions.select(F.col("key").alias("__k"), F.col("key").alias("__d"))
    through = aliases.select(F.col("alias").alias("__k"), F.col("key").alias("__a"))
    return asked.join(direct, "__k", "left").join(through, "__k", "left").withColumn("key", F.coalesce("__d", "__a")).drop("__k", "__d", "__a")


def base_by_suffix(terms: DataFrame, definitions: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, term, base): the longest proper suffix of a term's words that is defined; definitions (*within, key)."""
    words = F.split(normal_term(F.col("term")), r"\s+")
    parts = terms.select(*within, "term").distinct().withColumn("w", words).where(F.size("w") > 1)
    each = parts.select(*within, "term", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.array_join(F.slice(F.col("w"), k, F.size("w")), " "))).alias("k", "key"))
    return each.join(definitions.select(*within, "key").distinct(), [*within, "key"]).groupBy(*within, "term").agg(F.min_by("key", "k").alias("base"))


def base_by_parameter(terms: DataFrame, definitions: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, term, base): the longest defined term that differs in one word from a window of the term's words.

    Windows and defined terms meet on (number of words, the words but one), so no pair of terms
    is compared that doesn't match.  definitions (*within, key, ord); the first one wins a tie of length.
    """
    def holes(words: str):
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda h: F.struct(h.alias("hole"), F.array_join(F.transform(F.col(words), lambda w, i: F.when(i == h, "\x00").otherwise(w)), " ").alias("shape"), F.element_at(F.col(words), h + 1).alias("word")))

    known = definitions.select(*within, "key", "ord", F.split("key", r"\s+").alias("w")).where(F.size("w") > 1).select(*within, "key", "ord", F.size("w").alias("n"), F.inline(holes("w")))
    asked = terms.select(*within, "term").distinct().withColumn("w", F.split(normal_term(F.col("term")), r"\s+")).where(F.size("w") > 1)
    sizes = asked.select(*within, "term", "w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("n"))
    windows = sizes.select(*within, "term", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice(F.col("w"), i, F.col("n")))).alias("v"))
    windows = windows.select(*within, "term", "n", F.inline(holes("v"))).withColumnRenamed("word", "other")
    met = windows.join(known, [*within, "n", "hole", "shape"]).where("word <> other")
    return met.groupBy(*within, "term").agg(F.max_by("key", F.struct(F.length("key"), -F.col("ord"))).alias("base"))


def merge_redundant(definitions: DataFrame, text: str = "definition_text", term: str = "term", order: str = "ord") -> DataFrame:
    """One row per distinct text: primary (shortest term, first on a tie), aliases (sorted others), n."""
    groups = definitions.where(F.col(text) != "").groupBy(text).agg(
        F.min_by(F.col(term), F.struct(F.length(term), order)).alias("primary"), F.array_sort(F.collect_set(F.col(term))).alias("terms"), F.count("*").alias("n")
    )
    return groups.select(text, "primary", F.array_remove("terms", F.col("primary")).alias("aliases"), "n")


def redundant_members(definitions: DataFrame, text: str = "definition_text", term: str = "term", order: str = "ord") -> DataFrame:
    """(term, primary, n, is_primary): ``merge_redundant`` as a row per term, for texts that very many terms share.

    Nothing is gathered by text: the primary terms are aggregated map-side and joined back on the text's hash.
    """
    named = definitions.where(F.col(text) != "").select(F.col(term).alias("term"), F.col(order).alias("ord"), F.sha2(F.col(text).cast("string"), 256).alias("key"))
    best = named.groupBy("key").agg(F.min_by("term", F.struct(F.length("term"), "ord")).alias("primary"), F.count("*").alias("n"))
    return named.join(best, "key").groupBy("term", "primary", "n").agg((F.first("term") == F.first("primary")).alias("is_primary"))


def contained_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term_id): canonical terms inside canonical texts at word borders; texts (text_id, text), terms (term_id, term).

    A term is filed under the word of it that the fewest texts have.  A text meets only the terms
    filed under one of its words, and only these pairs are tested whole.  The words asked for and
    the pairs are written tables: small ones are broadcast, others are shuffled without the texts.
    """
    t = terms.select("term_id", canonical(F.col("term")).alias("c")).where("c <> ''")
    each = t.select("term_id", "c", F.explode(F.array_distinct(F.split("c", " "))).alias("word"))
    asked = materialize(each.select("word").distinct(), "words")
    body = texts.select("text_id", F.explode(F.array_distinct(F.split(canonical(F.col("text")), " "))).alias("word"))
    met = materialize(body.join(asked, "word", "left_semi"), "met")
    df = met.groupBy("word").agg(F.count("*").alias("df"))
    keyed = each.join(df, "word", "left").groupBy("term_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"), F.first("c").alias("c"))
    pairs = materialize(met.join(keyed, "word").select("text_id", "term_id", "c"), "pairs")
    inside = F.concat(F.lit(" "), canonical(F.col("text")), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("c"), F.lit(" ")))
    return texts.join(pairs, "text_id").where(inside).select("text_id", "term_id").distinct()


def prerequisites(requirements: DataFrame, definitions: DataFrame) -> DataFrame:
    """(paper, artifact, prerequisites map<term, text>): requirements (paper, artifact, term), definitions (paper, term, text)."""
    rows = requirements.join(definitions.groupBy("paper", "term").agg(F.min("text").alias("text")), ["paper", "term"])
    return rows.groupBy("paper", "artifact").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "text")))).alias("prerequisites"))
