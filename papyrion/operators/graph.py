"""Citation and statement graphs: components, rebuild, labels, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import normal_label
from papyrion.operators.components import connected_components


def top_components(edges: DataFrame, k: int, min_size: int = 1, src: str = "src", dst: str = "dst") -> DataFrame:
    """(rank, component, size, n_edges): the k largest components, smallest vertex first on a tie."""
    members = connected_components(edges, src, dst)
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    degrees = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("vertex")).agg(F.count("*").alias("n"))  # no key is hot in the join
    links = degrees.join(members, "vertex").groupBy("component").agg(F.sum("n").alias("n_edges"))
    best = sizes.orderBy(F.desc("size"), "component").limit(k)  # top-k first: the rank's window sees k rows
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))
    return ranked.join(links, "component", "left").select("rank", "component", "size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def top_degrees(edges: DataFrame, k: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, vertex, out_degree, place): the k vertices of highest out-degree of each component."""
    members = connected_components(edges, src, dst)
    degrees = edges.where(F.col(dst).isNotNull()).groupBy(F.col(src).alias("vertex")).agg(F.count("*").alias("out_degree"))
    order = Window.partitionBy("component").orderBy(F.desc("out_degree"), "vertex")
    return degrees.join(members, "vertex").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("component", "vertex", "out_degree", "place")


def dedup_edges(edges: DataFrame, order: str) -> DataFrame:
    """The first edge of each (source, target), whatever its kind."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    best = edges.groupBy("source", "target").agg(F.min_by(F.struct(*rest), order).alias("v"))
    return best.select("source", "target", *[F.col(f"v.{c}").alias(c) for c in rest])


def placeholders(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Edge ends that aren't nodes."""
    ends = edges.select(F.col("source").alias(id_col)).union(edges.select("target")).distinct()
    return ends.join(nodes.select(id_col), id_col, "left_anti")


def resolve_labels(refs: DataFrame, labels: DataFrame) -> DataFrame:
    """refs (source, label) with target: the node of the exact label, else of its normal form.

    labels (label, node_id).  Normal forms of several labels resolve nothing; self-references go.
    """
    normal = labels.groupBy(normal_label(F.col("label")).alias("n")).agg(F.min("node_id").alias("by_form"), F.count("*").alias("many")).where("many = 1 and n <> ''").select("n", "by_form")
    exact = labels.select("label", F.col("node_id").alias("by_label"))
    found = refs.withColumn("n", normal_label(F.col("label"))).join(exact, "label", "left").join(normal, "n", "left")
    target = F.coalesce("by_label", "by_form")
    return found.select("source", "label", target.alias("target")).where(target.isNotNull() & (target != F.col("source")))


def expand_results(results: DataFrame, edges: DataFrame, types: DataFrame, allowed: list[str]) -> DataFrame:
    """results (query_id, rank, id) with the direct successors of each result appended, once per query.

    edges (source, target, ord); types (id, type).  Successors of another type and ids that the
    query has already are left out.  Order: results, then successors by (result's rank, ord).
    """
    hits = results.select("query_id", "rank", F.regexp_replace("id", "#.*$", "").alias("source"))
    more = hits.join(edges, "source").join(types.withColumnsRenamed({"id": "target"}), "target", "left")
    more = more.where(F.col("type").isNull() | F.col("type").isin(allowed)).groupBy("query_id", F.col("target").alias("id")).agg(F.min(F.struct("rank", "ord")).alias("at"))
    more = more.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    size = results.groupBy("query_id").agg(F.max("rank").alias("last"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))
    added = more.withColumn("place", place).join(size, "query_id").select("query_id", (F.col("last") + F.col("place")).alias("rank"), "id", F.lit(True).alias("expanded"))
    return results.select("query_id", "rank", "id", F.lit(False).alias("expanded")).unionByName(added)
