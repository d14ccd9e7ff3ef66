"""Candidate pairs for dependency inference, as equi-joins over inverted indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import words_of
from papyrion.workspace import apart, materialize

# Bounds of the automatic mode.
MAX_NODES, MAX_TOKENS, PROOF_CHARS, GLOBAL_NODES = 30, 12_000, 1_200, 15
#: Artifacts in a cell, and tasks that make the pairs of cells.
CELL, PARTS = 1_000, 256


def term_cells(terms: DataFrame) -> DataFrame:
    """Written table (cell, paper, terms, members): a paper's artifacts with the same terms, in blocks of about ``CELL``.

    terms (paper, artifact, term), without nulls.  An artifact is in one cell, so pairs of cells make each pair of artifacts once.
    """
    t = terms.select("paper", "artifact", "term").dropna()
    sets = materialize(t.groupBy("paper", "artifact").agg(F.sort_array(F.collect_set("term")).alias("terms")), "terms")
    parts = sets.groupBy("paper", "terms").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    dealt = sets.join(parts, ["paper", "terms"]).groupBy("paper", "terms", F.pmod(F.xxhash64("artifact"), "parts").alias("part"))
    cells = dealt.agg(F.collect_list("artifact").alias("members"))
    return materialize(cells.select(F.monotonically_increasing_id().alias("cell"), "paper", "terms", "members"), "cells")


def cell_pairs(met: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Unordered pairs (paper, a < b) of artifacts from pairs of cells (paper, x, y, left, right): cells and their members.

    Pairs of cells are dealt to ``PARTS`` tasks, and the artifacts' pairs are made there and never shuffled, a cell's members
    at a time: a task holds the pairs of one artifact with a cell.
    ``known`` (x, y, artifact, others) are partners that an artifact of cell x doesn't get.
    """
    dealt = met.repartition(PARTS, "x", "y")
    if known is not None:
        each = dealt.join(known.repartition(PARTS, "x", "y").groupBy("x", "y").agg(F.map_from_entries(F.collect_list(F.struct("artifact", "others"))).alias("known")), ["x", "y"], "left")
        each = each.select("paper", "x", "y", "right", "known", F.explode("left").alias("p"))
        others = F.try_element_at("known", F.col("p"))
        each = each.withColumn("right", F.when(others.isNull(), F.col("right")).otherwise(F.array_except("right", others)))
    else:
        each = dealt.select("paper", "x", "y", "right", F.explode("left").alias("p"))
    each = apart(each.select("paper", "x", "y", "p", "right")).select("paper", "x", "y", "p", F.explode("right").alias("q")).where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return each.select("paper", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _overlapping(cells: DataFrame) -> DataFrame:
    """(paper, x, y, left, right): pairs of cells that share a term, each under the first term that it shares."""
    each = cells.select("paper", "cell", "terms", "members", F.explode("terms").alias("term"))
    left = each.select("paper", "term", F.col("cell").alias("x"), F.col("terms").alias("tx"), F.col("members").alias("left"))
    right = each.select("paper", "term", F.col("cell").alias("y"), F.col("terms").alias("ty"), F.col("members").alias("right"))
    first = F.get(F.array_intersect("tx", "ty"), F.lit(0))
    return left.join(right, ["paper", "term"]).where((F.col("x") <= F.col("y")) & (F.col("term") == first)).select("paper", "x", "y", "left", "right")


def overlap_pairs(terms: DataFrame) -> DataFrame:
    """Unordered pairs (paper, a < b) of artifacts of a paper that share a term; terms (paper, artifact, term)."""
    return cell_pairs(_overlapping(term_cells(terms)))


def new_overlap_pairs(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """``overlap_pairs`` without those that are edges (source = a, target = b) already.

    Edges go to their pair of cells, so the pairs aren't joined with them one by one.
    """
    cells = term_cells(terms)
    of = cells.select("paper", "cell", F.explode("members").alias("artifact"))
    ends = edges.select("source", "target").where("source < target").distinct()
    ends = ends.join(of.toDF("paper", "s", "source"), "source").join(of.toDF("paper", "t", "target"), ["paper", "target"])
    turned = F.col("s") > F.col("t")  # in one cell both ends have the other as their partner
    rows = ends.select("s", "t", "source", "target").where(~turned).unionByName(ends.where("s >= t").select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("target").alias("source"), F.col("source").alias("target")))
    known = rows.groupBy(F.col("s").alias("x"), F.col("t").alias("y"), F.col("source").alias("artifact")).agg(F.collect_set("target").alias("others"))
    return cell_pairs(_overlapping(cells), known)


def subword_terms(terms: DataFrame) -> DataFrame:
    """(narrow, wide): different terms where the words of the one are among those of the other.

    Terms meet on one word only, the rarest of the narrow term, so common words make no pairs
    unless a term consists of nothing else.
    """
    distinct = terms.select("term").distinct().withColumn("words", words_of(F.col("term"))).where(F.size("words") > 0)
    each = distinct.select("term", "words", F.explode("words").alias("word"))
    rare = each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("term").agg(F.min_by("word", F.struct("df", "word")).alias("word"), F.first("words").alias("words"))
    narrow = rare.select(F.col("term").alias("narrow"), F.col("words").alias("nw"), "word")
    wide = each.select(F.col("term").alias("wide"), F.col("words").alias("ww"), "word")
    return narrow.join(wide, "word").where((F.col("narrow") != F.col("wide")) & (F.size(F.array_except("nw", "ww")) == 0)).select("narrow", "wide")


def subword_pairs(terms: DataFrame) -> DataFrame:
    """Unordered pairs (paper, a < b) of artifacts with a term of the one a subword of a term of the other."""
    cells = term_cells(terms)
    related = materialize(subword_terms(cells.select(F.explode("terms").alias("term"))), "related")
    each = cells.select("paper", "cell", F.explode("terms").alias("term"))
    met = each.toDF("paper", "p", "narrow").join(related, "narrow").join(each.toDF("paper", "q", "wide"), ["paper", "wide"])
    met = met.select("paper", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
    members = cells.select("cell", "members")
    return cell_pairs(met.join(members.toDF("x", "left"), "x").join(members.toDF("y", "right"), "y"))


def capped_overlap_pairs(terms: DataFrame, cap: int) -> DataFrame:
    """``overlap_pairs`` of the papers with at most ``cap`` pairs; others keep none.

    A term of n artifacts alone makes n (n - 1) / 2 pairs, so papers with a term beyond the cap go
    before any pair is made, and what is left makes at most ``cap`` pairs a term.
    """
    t = terms.select("paper", "artifact", "term").distinct()
    sizes = t.groupBy("paper", "term").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") * (F.col("n") - 1) / 2 > cap).select("paper").distinct()
    return under_cap(overlap_pairs(t.join(over, "paper", "left_anti")), cap)


def all_pairs(nodes: DataFrame, cap: int = 10_000) -> DataFrame:
    """The fallback: every pair of a paper's nodes, the earlier line as the source (smaller id on a tie).

    nodes (paper, id, line).  A paper with more than ``cap`` pairs has none, and is left out before the join on the paper.
    """
    sizes = nodes.groupBy("paper").agg(F.count("*").alias("n")).where(F.col("n") * (F.col("n") - 1) / 2 <= cap)
    nodes = nodes.join(sizes.select("paper"), "paper", "left_semi")
    left, right = nodes.select("paper", F.col("id").alias("source"), F.col("line").alias("l1")), nodes.select("paper", F.col("id").alias("target"), F.col("line").alias("l2"))
    return left.join(right, "paper").where((F.col("l1") < F.col("l2")) | ((F.col("l1") == F.col("l2")) & (F.col("source") < F.col("target")))).select("paper", "source", "target")


def directed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs as (paper, source, target): the later artifact is the source (smaller id on a tie)."""
    lines = nodes.select("paper", "id", "line")
    both = pairs.join(lines.toDF("paper", "a", "la"), ["paper", "a"]).join(lines.toDF("paper", "b", "lb"), ["paper", "b"])
    later = F.col("la") >= F.col("lb")
    return both.select("paper", F.when(later, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("target"))


def under_cap(pairs: DataFrame, cap: int) -> DataFrame:
    """Pairs of the papers with at most ``cap`` pairs; others keep none."""
    sizes = pairs.groupBy("paper").agg(F.count("*").alias("n")).where(F.col("n") <= cap)
    return pairs.join(sizes.select("paper"), "paper", "left_semi")


def new_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select("source", "target"), ["source", "target"], "left_anti")


def accepted_edges(proposed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct proposals between known nodes that aren't loops or edges already."""
    known = nodes.select("paper", "id")
    good = proposed.where("source <> target").join(known.withColumnRenamed("id", "source"), ["paper", "source"], "left_semi")
    good = good.join(known.withColumnRenamed("id", "target"), ["paper", "target"], "left_semi")
    return good.join(edges.select("paper", "source", "target"), ["paper", "source", "target"], "left_anti").select("paper", "source", "target").distinct()


def token_estimate(content: Column, proof: Column) -> Column:
    """Characters that count, for a sum."""
    return F.length(F.coalesce(content, F.lit(""))) + F.least(F.length(F.coalesce(proof, F.lit(""))), F.lit(PROOF_CHARS))


def cut_proof(proof: Column, budget: Column) -> Column:
    """A proof for a prompt: whole without a budget or within it, else its beginning and a mark; null is empty."""
    text = F.coalesce(proof, F.lit(""))
    whole = budget.isNull() | (F.length(text) <= budget)
    return F.when(whole, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), budget.cast("int"))), F.lit("\n[proof cut]")))


def choose_mode(nodes: DataFrame, paper: str, content: str, proof: str) -> DataFrame:
    """(paper, n_nodes, tokens, mode): global or hybrid for small papers, else pairwise."""
    sums = nodes.groupBy(paper).agg(F.count("*").alias("n_nodes"), F.ceil(F.sum(token_estimate(F.col(content), F.col(proof))) / 4).alias("tokens"))
    small = (F.col("n_nodes") <= MAX_NODES) & (F.col("tokens") <= MAX_TOKENS)
    return sums.withColumn("mode", F.when(small & (F.col("n_nodes") <= GLOBAL_NODES), "global").when(small, "hybrid").otherwise("pairwise"))


def footprints(direct: DataFrame, definitions: DataFrame) -> DataFrame:
    """(paper, artifact, term): direct terms and the dependencies of each defined one.

    direct (paper, artifact, term); definitions (paper, term, dependencies).
    """
    more = direct.join(definitions, ["paper", "term"]).select("paper", "artifact", F.explode("dependencies").alias("term"))
    return direct.select("paper", "artifact", "term").union(more).distinct()


def first_artifact(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper, term, artifact): the earliest artifact of each term."""
    lines = nodes.select("paper", F.col("id").alias("artifact"), "line")
    return terms.join(lines, ["paper", "artifact"]).groupBy("paper", "term").agg(F.min_by("artifact", F.struct("line", "artifact")).alias("artifact"))


def following(rows: DataFrame, key: str, at: str, value: Column, width: int | None = None) -> DataFrame:
    """``rows`` with next: the smallest ``value`` of the key's rows after ``at``, null if none.

    The rows run backwards with a running minimum, so the work is linear.  With ``width`` a key
    is cut into ranges of that many units: each range has a task of its own and gets the minimum
    of the later ones from a table with a row per range, so a hot key is many tasks.
    """
    if width is None:
        window = Window.partitionBy(key).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("next", F.min(value).over(window))
    cut = rows.withColumn("__range", F.floor(F.col(at) / width))
    here = Window.partitionBy(key, "__range").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("__k").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    lows = cut.groupBy(F.col(key).alias("__k"), F.col("__range").alias("__b")).agg(F.min(value).alias("__low"))
    lows = lows.select("__k", "__b", F.min("__low").over(later).alias("__later"))
    near = cut.withColumn("__near", F.min(value).over(here))
    joined = near.join(lows, F.col(key).eqNullSafe(F.col("__k")) & F.col("__range").eqNullSafe(F.col("__b")), "left")
    return joined.select(*rows.columns, F.coalesce("__near", "__later").alias("next"))


def next_after(events: DataFrame, key: str, start: str, end: str, kind: str, left: str, right: str, width: int | None = None) -> DataFrame:
    """As-of join forward within one table: for each ``left`` row the first ``right`` row of its key that starts after its end."""
    at = F.when(F.col(kind) == right, F.col(start)).otherwise(F.col(end))
    rows = following(events.withColumn("__at", at), key, "__at", F.when(F.col(kind) == right, F.col(start)), width)
    return rows.where(F.col(kind) == left).withColumnRenamed("next", "next_start").drop("__at")
