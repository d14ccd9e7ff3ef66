"""Writers: graph documents, category files, search rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, edges: DataFrame, key: str = "paper") -> DataFrame:
    """(key, n_nodes, n_edges, json): one document per paper; used_in edges are written the other way round.

    A paper's nodes and edges are a document, so they are gathered by paper.
    """
    swap = F.col("dependency_type") == "used_in"
    turned = edges.withColumns({"source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))})
    n = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in nodes.columns if c != key]))).alias("nodes"))
    e = turned.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in turned.columns if c != key]))).alias("edges"))
    rows = n.join(e, key, "left")
    sizes = F.size("nodes").alias("n_nodes"), F.coalesce(F.nullif(F.size("edges"), F.lit(-1)), F.lit(0)).alias("n_edges")
    return rows.select(key, *sizes, F.to_json(F.struct("nodes", "edges")).alias("json"))


def search_rows(nodes: DataFrame, papers: DataFrame, key: str = "paper") -> DataFrame:
    """Search documents: internal statements with their paper's title and category, header lines cut off."""
    body = F.element_at(F.split("content", r"\n---\n"), -1)
    return nodes.where("not is_external").join(papers, key, "left").select(key, "id", "kind", body.alias("content"), "title", "category")


def append_by_category(rows: DataFrame, path: str, column: str = "category") -> None:
    rows.write.mode("append").partitionBy(column).json(path)


def overwrite_papers(rows: DataFrame, path: str, key: str = "paper") -> None:
    """Replace the papers that occur in ``rows`` and leave the others, by dynamic partition overwrite."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def report(rows: DataFrame, path: str, kind: str) -> None:
    """A small report as csv (quoted), json or md."""
    if kind in ("csv", "json"):
        getattr(rows.coalesce(1).write.mode("overwrite").option("header", "true"), kind)(path)
        return
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = [f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}"]
    top = rows.sparkSession.createDataFrame([(k, h) for k, h in enumerate(head)], "k long, value string")
    body = rows.select((F.monotonically_increasing_id() + 2).alias("k"), line.alias("value"))
    top.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
