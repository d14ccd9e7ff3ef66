"""Index documents, prepared queries, graph rebuild, display columns, event rows and queue repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import math_to_tex, quoted
from papyrion.operators.graph import placeholders

# Tags of statement types in index texts.
TAGS = {"definition": "[DEF]", "theorem": "[THM]", "lemma": "[LEM]", "proposition": "[PROP]", "corollary": "[COR]", "remark": "[REM]", "example": "[EX]", "proof": "[PROOF]"}
#: What an index mode adds to the content.
PREREQS, SEMANTIC = ("content+prereqs", "content+all"), ("content+semantic", "content+all")


def tag(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def _present(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def prefixed(parts: dict[str, Column]) -> list[Column]:
    """Structured lists as text, each after its name; empty ones are left out."""
    return [F.when(F.size(c) > 0, F.concat(F.lit(f"[{name}] "), F.array_join(c, " ; "))) for name, c in parts.items()]


def index_documents(nodes: DataFrame, mode: str = "content", with_type: bool = True) -> DataFrame:
    """(artifact_id, node_id, type, text, index_text): a row for the content and one for the proof, where not blank.

    nodes (id, type, content, proof, semantic_tag, prerequisites map<term, text>).
    """
    pairs = F.array(F.struct(F.col("id").alias("artifact_id"), F.coalesce("type", F.lit("unknown")).alias("type"), F.col("content").alias("text")), F.struct(F.concat("id", F.lit("#proof")).alias("artifact_id"), F.lit("proof").alias("type"), F.col("proof").alias("text")))
    rows = nodes.select(F.col("id").alias("node_id"), "semantic_tag", "prerequisites", F.inline(pairs)).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    needs = F.array_join(F.transform(F.map_entries("prerequisites"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
    parts = [tag(F.col("type"))] if with_type else []
    if mode in SEMANTIC:
        parts.append(_present(F.col("semantic_tag")))
    if mode in PREREQS:
        parts.append(_present(needs))
    return rows.select("artifact_id", "node_id", "type", "text", math_to_tex(F.concat_ws(" ", *parts, F.col("text"))).alias("index_text"))


def prepared_queries(queries: DataFrame, explicit_only: bool = False, single_ref: bool = False) -> DataFrame:
    """Queries with text, in normal form, with the number of words and references.

    queries (query_id, query_text, query_style, reference_precision, explicit_refs array).  A
    blank precision passes the explicit filter; a missing id is the text's SHA-256.
    """
    n = F.coalesce(F.nullif(F.size("explicit_refs"), F.lit(-1)), F.lit(0))
    rows = queries.where(F.coalesce("query_text", F.lit("")) != "").withColumn("n_refs", n)
    if explicit_only:
        rows = rows.where(F.lower(F.coalesce("reference_precision", F.lit(""))).isin("", "explicit"))
    if single_ref:
        rows = rows.where("n_refs = 1")
    words = F.size(F.filter(F.split("query_text", r"\s+"), lambda w: w != ""))
    return rows.select(F.coalesce("query_id", F.sha2("query_text", 256)).alias("query_id"), "query_text", math_to_tex(F.col("query_text")).alias("normalized"), F.coalesce("query_style", F.lit("unknown")).alias("style"), words.alias("n_words"), "n_refs")


def build_qrels(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): nodes (id, kind, number) with the type and number of a query's references; queries (query_id, refs array<struct<kind, number>>)."""
    asked = queries.select("query_id", F.inline("refs")).select("query_id", F.lower("kind").alias("kind"), "number")
    return asked.join(nodes.select("id", F.lower("kind").alias("kind"), "number"), ["kind", "number"]).select("query_id", "id").distinct()


def rebuild_graph(artifacts: DataFrame, edges: DataFrame, prerequisites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of stored papers: artifacts with their prerequisites, and placeholders for unknown ends.

    artifacts (paper, id, kind, content), edges (paper, edge_kind, source, target, kind), prerequisites (paper, artifact, prerequisites).
    """
    joined = artifacts.join(prerequisites.withColumnRenamed("artifact", "id"), ["paper", "id"], "left").withColumn("is_external", F.lit(False))
    scoped = edges.select(F.struct("paper", F.col("source").alias("id")).alias("source"), F.struct("paper", F.col("target").alias("id")).alias("target"))
    missing = placeholders(artifacts.select(F.struct("paper", "id").alias("id")), scoped).select("id.*")
    extra = missing.select("paper", "id", F.lit("unknown").alias("kind"), F.lit("").alias("content"), F.lit(True).alias("is_external"))
    typed = edges.select("paper", "source", "target", F.when(F.col("edge_kind") == "reference", F.col("kind")).alias("reference_type"), F.when(F.col("edge_kind") == "dependency", F.col("kind")).alias("dependency_type"))
    return joined.unionByName(extra, allowMissingColumns=True), typed


def event_rows(nodes: DataFrame, links: DataFrame, enriched: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(paper, seq, type, data): a paper's events in order: status, nodes, links, enriched nodes, dependency links, done.

    All inputs (paper, ord, data).
    """
    phases = [("node", nodes), ("link", links), ("node", enriched), ("link", dependencies)]
    union = None
    for k, (kind, rows) in enumerate(phases, 1):
        part = rows.select("paper", F.lit(k).alias("phase"), F.col("ord").cast("long").alias("ord"), F.lit(kind).alias("type"), "data")
        union = part if union is None else union.unionByName(part)
    papers = nodes.select("paper").distinct()
    ends = [papers.select("paper", F.lit(k).alias("phase"), F.lit(0).cast("long").alias("ord"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("data")) for k, t in ((0, "status"), (5, "done"))]
    order = Window.partitionBy("paper").orderBy("phase", "ord")
    return union.unionByName(ends[0]).unionByName(ends[1]).withColumn("seq", F.row_number().over(order)).select("paper", "seq", "type", "data")


def rollback(processed: DataFrame, papers: DataFrame, queue: DataFrame, cutoff: Column) -> DataFrame:
    """(id, ts, metadata, requeued): papers processed after the cutoff, with metadata of the paper or a stub; requeued if not queued already.

    processed (id, status, ts), papers (id, ...), queue (id).
    """
    hit = processed.where(F.col("ts") > cutoff).select("id", "ts")
    known = papers.select("id", F.to_json(F.struct(*papers.columns)).alias("known"))
    queued = queue.select("id").distinct().withColumn("__q", F.lit(True))
    rows = hit.join(known, "id", "left").join(queued, "id", "left")
    return rows.select("id", "ts", F.coalesce("known", F.to_json(F.struct("id"))).alias("metadata"), F.col("__q").isNull().alias("requeued"))


def newest_modes(states: DataFrame) -> DataFrame:
    """(paper, mode): the latest completed mode of each paper; states (paper, mode, stage, ts)."""
    return states.where("stage = 'complete'").groupBy("paper").agg(F.max_by("mode", "ts").alias("mode"))


def upload_batches(rows: DataFrame, remote: DataFrame, key: str = "path", size: int = 200) -> DataFrame:
    """Rows that the remote list lacks, with the number of their batch, in key order.

    Batches are numbered in ranges of keys first, so no task holds the whole order.
    """
    from papyrion.sources.tables import numbered

    return numbered(rows.join(remote.select(key), key, "left_anti"), key).withColumn("batch", F.floor((F.col("n") - 1) / size)).drop("n")


def context_paragraph(text: Column, term: Column) -> Column:
    """The blank-line-delimited paragraph of the term's first occurrence as a word; empty if none.

    A single letter is looked for after a dollar sign first, in its own case.
    """
    bare = F.when(term.rlike(r"(?s)^\$.+\$$"), F.regexp_replace(term, r"(?s)^\$(.+)\$$", "$1")).otherwise(term)
    ends = r"(?=[\s()\[\]{},.=+\-*/<>]|\$|$)"
    exact = quoted(bare)
    strict = F.concat(F.lit(r"\$"), exact, F.lit(ends))
    plain = F.concat(F.when(bare.rlike("^[A-Za-z]+$"), "(?i)").otherwise(""), F.lit(r"(?:^|\s|[(\[{,=+\-*/<>]|\$)"), exact, F.lit(ends))
    parts = F.split(text, r"\n\n")

    def first(pattern: Column) -> Column:
        return F.get(F.filter(parts, lambda p: F.regexp_like(p, pattern)), F.lit(0))

    single = bare.rlike("^[A-Za-z]$")
    return F.trim(F.coalesce(F.when(single, first(strict)), first(plain), F.lit("")))


def display_name(kind: Column, label: Column, node_id: Column, external: Column) -> Column:
    return F.when(external, F.concat(F.lit("Reference: "), F.coalesce(label, node_id))).otherwise(F.initcap(kind))


def prerequisites_preview(prerequisites: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(prerequisites), lambda e: F.concat(F.lit("<b>"), e["key"], F.lit("</b>: "), e["value"])), "<br><br>")


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """The 0-based offset of a 1-based line and column."""
    before = F.slice(F.split(text, "\n", -1), F.lit(1), line - 1)
    return F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1) + column - 1
