"""A paper store as tables: writes of papers' parts, integrity, graph access and per-paper documents.

Each function takes the tables as they are and returns them as they become; a caller writes
them where it keeps its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.ids import base_id
from papyrion.operators.queue import upsert


def put_artifacts(old: DataFrame, new: DataFrame, order: str, remove_stale: bool = False, papers: DataFrame | None = None) -> DataFrame:
    """Artifacts (paper, id, ...) after a write: the last new row of a key wins; others stay.

    With ``remove_stale`` artifacts of a written paper that it no longer has go; ``papers`` (paper)
    names the written papers, so that one without any statement loses all (else those of the new rows).
    """
    kept = old
    if remove_stale:
        kept = old.join((new if papers is None else papers).select("paper").distinct(), "paper", "left_anti")
    blank = kept.withColumn(order, F.lit(None).cast(new.schema[order].dataType))
    return upsert(blank.select(*new.columns), new, ["paper", "id"], F.col(order)).drop(order)


def put_edges(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Edges (paper, edge_kind, source, target, ...) after an insert-or-replace; the last one of a key wins."""
    blank = old.withColumn(order, F.lit(None).cast(new.schema[order].dataType))
    return upsert(blank.select(*new.columns), new, ["paper", "edge_kind", "source", "target"], F.col(order)).drop(order)


def put_definitions(old: dict[str, DataFrame], new: dict[str, DataFrame], papers: DataFrame) -> dict[str, DataFrame]:
    """The five definition tables after the papers' rows were deleted and written anew.

    definitions (paper, term, ...), aliases (paper, term, alias), dependencies (paper, term,
    depends_on), terms (paper, artifact, term), requirements (paper, artifact, term).
    Dependencies stay only if their target is defined in the paper, requirements only if their term is.
    """
    written = papers.select("paper").distinct()
    known = new["definitions"].select("paper", "term").distinct()
    checked = dict(new)
    checked["dependencies"] = new["dependencies"].join(known.withColumnRenamed("term", "depends_on"), ["paper", "depends_on"], "left_semi").select(*new["dependencies"].columns)
    checked["requirements"] = new["requirements"].join(known, ["paper", "term"], "left_semi").select(*new["requirements"].columns)
    return {name: rows.join(written, "paper", "left_anti").select(*rows.columns).unionByName(checked[name].distinct()) for name, rows in old.items()}


def commit(results: DataFrame, mode: str) -> DataFrame:
    """(paper, stage, reason): what a paper's write leaves behind; one that fails leaves only its failure.

    results (paper, n_nodes, n_definitions, error), and n_terms where term maps are known of.  A
    graph without statements is a failure, and so is a mode with definitions (defs, full) without
    any bank or term map.  ``snapshots.persist_results`` writes by it.
    """
    needs = F.lit(mode in ("defs", "full"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("n_nodes", F.lit(0)) == 0, "empty graph").when(needs & F.col("n_definitions").isNull(), "no definition bank")
    if "n_terms" in results.columns:
        reason = reason.when(needs & F.col("n_terms").isNull(), "no term map")
    return results.select("paper", F.when(reason.isNull(), "complete").otherwise("failed").alias("stage"), reason.alias("reason"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing: a foreign key as a check."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def add_usage(papers: DataFrame, usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers with a stub for each paper that only the usage names, usage rows with total tokens)."""
    stubs = usage.select("paper").where("paper is not null").distinct().join(papers.select("paper"), "paper", "left_anti")
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return papers.unionByName(stubs, allowMissingColumns=True), usage.withColumn("total_tokens", total)


# Graph access


def first_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The first node of each (paper, id)."""
    rest = [c for c in nodes.columns if c not in ("paper", "id")]
    return nodes.groupBy("paper", "id").agg(F.min_by(F.struct(*rest), order).alias("v")).select("paper", "id", *[F.col(f"v.{c}").alias(c) for c in rest])


def edges_at(edges: DataFrame, asked: DataFrame, side: str) -> DataFrame:
    """Edges into (side ``target``) or out of (``source``) the asked nodes (paper, id)."""
    return edges.join(asked.select("paper", F.col("id").alias(side)).distinct(), ["paper", side], "left_semi").select(*edges.columns)


def nodes_by_label(nodes: DataFrame, asked: DataFrame, order: str) -> DataFrame:
    """(paper, label, id): the first node of each asked label (paper, label)."""
    return nodes.join(asked.select("paper", "label").distinct(), ["paper", "label"]).groupBy("paper", "label").agg(F.min_by("id", order).alias("id"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper, n_nodes, n_edges, n_reference, n_dependency) of each paper with nodes; edges (paper, edge_kind, ...)."""
    n = nodes.groupBy("paper").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("paper").agg(F.count("*").alias("n_edges"), *[F.count_if(F.col("edge_kind") == k).alias(f"n_{k}") for k in ("reference", "dependency")])
    return n.join(e, "paper", "left").na.fill(0, ["n_edges", "n_reference", "n_dependency"])


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, source, target): the directed edges inside each component, repeated ones too; members (vertex, component)."""
    at = members.select(F.col("vertex").alias("source"), "component")
    other = members.select(F.col("vertex").alias("target"), F.col("component").alias("__c"))
    return edges.where("source is not null and target is not null").join(at, "source").join(other, "target").where(F.col("component") == F.col("__c")).select("component", "source", "target")


def citation_edges(matches: DataFrame, processed: DataFrame) -> DataFrame:
    """(source, target) without versions: matches (paper, matched) of successfully processed papers (id, status); blank ends go."""
    done = processed.where(F.startswith("status", F.lit("success"))).select(F.col("id").alias("paper")).distinct()
    rows = matches.where("matched is not null").join(done, "paper", "left_semi")
    ends = rows.select(base_id(F.trim("paper")).alias("source"), base_id(F.trim("matched")).alias("target"))
    return ends.where("source <> '' and target <> ''")


# Documents


def file_name(paper: Column) -> Column:
    return F.concat(F.replace(paper, F.lit("/"), F.lit("_")), F.lit(".json"))


def export_rows(documents: DataFrame, banks: DataFrame, terms: DataFrame, macros: DataFrame, modes: DataFrame) -> DataFrame:
    """(paper, path, json): a dataset document per paper with a graph: graph, bank, terms by artifact, macros, mode.

    documents (paper, n_nodes, json), banks (paper, bank), terms (paper, artifact, term), macros
    (paper, macros map), modes (paper, mode).  Papers without statements are left out.
    """
    by_artifact = terms.groupBy("paper", "artifact").agg(F.array_sort(F.collect_set("term")).alias("t"))
    term_map = by_artifact.groupBy("paper").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact", "t")))).alias("artifact_to_terms"))
    rows = documents.where("n_nodes > 0").join(banks, "paper", "left").join(term_map, "paper", "left").join(macros, "paper", "left").join(modes, "paper", "left")
    body = F.to_json(F.struct(F.col("paper").alias("arxiv_id"), F.coalesce("mode", F.lit("unspecified")).alias("extractor_mode"), F.col("bank").alias("definition_bank"), "artifact_to_terms", "macros"))
    joined = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"graph":'), F.col("json"), F.lit("}"))
    return rows.select("paper", F.concat(F.lit("data/arxiv_"), file_name(F.col("paper").cast("string"))).alias("path"), joined.alias("json"))


def write_documents(rows: DataFrame, folder: str) -> DataFrame:
    """Write each (path, json) as a file under ``folder`` through pyarrow's file systems; returns (path, bytes).

    A file is written under a name of its task's own and then moved, so a repeated task leaves one whole file.
    """
    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, data = f"{top}/{path}", text.encode("utf-8")
                where.create_dir(name.rpartition("/")[0], recursive=True)
                own = f"{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(own) as out:
                    out.write(data)
                where.move(own, name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select("path", "json").mapInArrow(run, "path string, bytes long")
