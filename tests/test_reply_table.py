"""Stored replies: runs, expiry, compaction, and a lookup that leaves the table where it lies."""

from datetime import datetime

from pyspark.sql import functions as F

from papyrion.operators.reply_table import COLUMNS, ReplyTable


def at(day):
    return datetime(2024, 1, day)


def test_runs_expiry_and_compaction(spark):
    table = ReplyTable(spark, buckets=8)
    try:
        wanted = spark.createDataFrame([(k, x) for k, x in enumerate(["a", "b", "c", None, "a"])], "n int, key string")
        assert {r.status for r in table.lookup(wanted).collect()} == {"missing"}
        table.append(spark.createDataFrame([("a", "old", at(1)), ("b", "b1", at(2)), (None, "x", at(2))], COLUMNS))
        table.append(spark.createDataFrame([("a", "new", at(5)), ("c", "c1", at(1)), ("c", "c0", at(1))], COLUMNS))
        found = table.lookup(wanted)
        assert {(r.n, r.reply, r.status) for r in found.collect()} == {(0, "new", "cached"), (1, "b1", "cached"), (2, "c1", "cached"), (3, None, "missing"), (4, "new", "cached")}
        plan = table.lookup(wanted)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # of the wanted rows only
        since = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
        assert {r.n for r in table.lookup(wanted, since).where("status = 'cached'").collect()} == {0, 1, 4}
        before = spark.table(table.name).count()
        table.compact(since)
        assert before == 5 and sorted((r.key, r.reply) for r in spark.table(table.name).collect()) == [("a", "new"), ("b", "b1")]
        assert {r.n for r in table.lookup(wanted).where("status = 'cached'").collect()} == {0, 1, 4}
    finally:
        table.drop()


def test_models_are_looked_up(spark):
    import pytest

    from papyrion.operators.replies import PROVIDERS, provider_of

    df = spark.createDataFrame([(m,) for m in [*PROVIDERS, "GPT-4o-2024-08-06", "o1", None]], "m string")
    assert [r.p for r in df.select(provider_of(F.col("m"), strict=False).alias("p")).collect()] == [*PROVIDERS.values(), None, None, None]
    assert [r.p for r in df.where(F.col("m").isin(*PROVIDERS)).select(provider_of(F.col("m")).alias("p")).collect()] == list(PROVIDERS.values())
    with pytest.raises(Exception, match="unknown model o1"):
        df.where("m = 'o1'").select(provider_of(F.col("m"))).collect()
