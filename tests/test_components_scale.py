"""Components converge in few rounds on long paths and wide stars."""

from pyspark.sql import functions as F

from papyrion.operators import components
from papyrion.operators.components import connected_components


def test_path_and_star(spark):
    path = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(3000).select(F.lit(10_000).cast("long").alias("src"), (F.col("id") + 10_001).alias("dst"))
    got = connected_components(path.union(star)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {r.component: r.n for r in got} == {0: 2001, 10_000: 3001}


def test_shuffles_have_tasks_of_bounded_size(spark, monkeypatch):
    seen = []

    class Watched(components.Table):
        def __init__(self, df, name, *rest):
            seen.append((name, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
            super().__init__(df, name, *rest)

    monkeypatch.setattr(components, "Table", Watched)
    monkeypatch.setattr(components, "ROWS", 50, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    path = spark.range(500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.connected_components(path).where("component = 0").count() == 501
    assert {n for _, n in seen[:3]} == {10}  # before, the session's number, however many edges there are
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
