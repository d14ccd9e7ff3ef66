"""What the command line does, as functions of tables: discover, select, reprocess, deduplicate, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions.ids import base_id
from papyrion.operators.graph import top_components
from papyrion.operators.components import connected_components
from papyrion.operators.queue import latest_versions, paper_titles
from papyrion.operators.store import induced_edges


def reprocess(papers: DataFrame, processed: DataFrame, states: DataFrame, queue: DataFrame, modes: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processed, states, queue) after papers (id, metadata) were taken back: no status, no ingestion state (of the modes), queued again.

    processed (id, ...), states (paper, mode, ...), queue (id, metadata).
    """
    ids = papers.select("id").distinct()
    hit = F.lit(True) if modes is None else F.col("mode").isin(modes)
    gone = states.join(ids.withColumnRenamed("id", "paper"), "paper", "left_semi").where(hit)
    kept = states.join(gone.select("paper", "mode").distinct(), ["paper", "mode"], "left_anti").select(*states.columns)
    back = papers.groupBy("id").agg(F.min("metadata").alias("metadata")).join(queue.select("id"), "id", "left_anti")
    return processed.join(ids, "id", "left_anti").select(*processed.columns), kept, queue.unionByName(back)


def deduplicated_queue(queue: DataFrame, id_col: str = "arxiv_id") -> tuple[DataFrame, DataFrame]:
    """(the queue with the highest version of each paper, one row: before, removed, after)."""
    marked = latest_versions(queue, id_col)
    counts = marked.agg(F.count("*").alias("before"), F.count_if(~F.col("kept")).alias("removed"), F.count_if("kept").alias("after"))
    return marked.where("kept").select(*queue.columns), counts


def backfill_ids(kind: str, papers: DataFrame, discovered: DataFrame, citations: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """(id): base ids to look up: ``explicit`` ones, those with ``zero`` citations, those ``discovered`` only, or ``all``.

    papers, discovered (id), citations (id, count).
    """
    def bases(rows: DataFrame) -> DataFrame:
        return rows.select(base_id(F.trim("id")).alias("id")).where("id <> ''").distinct()

    if kind == "explicit":
        return bases(papers.sparkSession.createDataFrame([(x,) for x in explicit or []], "id string"))
    if kind == "zero":
        return bases(citations.where("count = 0"))
    if kind == "discovered":
        return bases(discovered).join(bases(papers), "id", "left_anti")
    if kind == "all":
        return bases(papers).union(bases(discovered)).distinct()
    raise ValueError(f"unknown selection: {kind}")


def until_target(months: Iterable, pages: Callable[[object], Iterable[int]], target: int) -> tuple[int, list]:
    """Month after month and page after page until ``target`` papers were added: (added, completed months).

    ``pages`` gives the number of papers that each page of a month added; a month that the target cuts off isn't completed.
    """
    added, done = 0, []
    for month in months:
        for n in pages(month):
            added += n
            if added >= target:
                return added, done
        done.append(month)
    return added, done


def component_documents(edges: DataFrame, papers: DataFrame, discovered: DataFrame, k: int = 10, min_size: int = 2) -> DataFrame:
    """(rank, component, size, n_edges, json): the k largest components with their directed edges, counts and titles.

    edges (source, target) without versions, papers and discovered (id, title).
    """
    named = edges.where("target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    best = top_components(named, k, min_size)
    members = connected_components(named).join(best.select("component"), "component", "left_semi")
    inside = induced_edges(edges, members).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("edges"))
    titles = paper_titles(members.select(F.col("vertex").alias("id")), papers, discovered).withColumnRenamed("id", "vertex")
    nodes = members.join(titles, "vertex", "left").groupBy("component").agg(F.array_sort(F.collect_list(F.struct(F.col("vertex").alias("id"), "title"))).alias("nodes"))
    rows = best.join(nodes, "component").join(inside, "component", "left")
    return rows.select("rank", "component", "size", "n_edges", F.to_json(F.struct("component", "size", "nodes", "edges")).alias("json"))
