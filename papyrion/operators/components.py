"""Connected components of an undirected graph, by alternating large-star and small-star.

Each round replaces the edges by stars around smaller vertices (Kiveris et al. 2014) and
converges in O(log^2 n) rounds.  Every minimum is written as a table of its own before it
is joined, so that both sides of the join are plain exchanges: a hub's rows are split by
AQE's skew join, and a small table of minima is broadcast only below Spark's threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.workspace import Table, tasks_of

#: Edges of a shuffle's task, which holds a hash table of both their ends.
ROWS = 500_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, Table]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = Table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
    return both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, Table]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = Table(down.groupBy("u").agg(F.min("v").alias("m")), "small")
    moved = down.join(least.df, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.df.select("u", F.col("m").alias("v"))).distinct(), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(vertex, component) for every vertex that has an edge; component is the smallest vertex reachable.

    Edges may repeat and point either way; self-loops and edges with a null end are ignored
    (a vertex that only has such edges isn't returned).  An empty table gives an empty result.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    with tasks_of(edges.sparkSession, clean.count(), ROWS):
        now = Table(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now.df)
    for _ in range(max_rounds):
        if not state[0]:
            break
        with tasks_of(edges.sparkSession, state[0], ROWS):
            large, least1 = _large_star(now.df)
            large = Table(large, "edges")
            small, least2 = _small_star(large.df)
            new = Table(small, "edges")
            for table in (now, least1, large, least2):
                table.drop()
            now, before, state = new, state, _state(new.df)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
