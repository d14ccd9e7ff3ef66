"""Stored replies as a bucketed table: appended in runs, the newest run of a key counts, lookups don't move it.

The table is bucketed and sorted by the key (``prompt_key`` of a call, or ``match_key`` of a
reference), so a lookup shuffles only the wanted rows to the buckets; the newest reply of each key is
taken inside its bucket.  Each append adds a file to a bucket; ``compact`` rewrites the newest
replies as one run and drops those past their time.  Replies without a key are not stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "key string, reply string, ts timestamp_ntz"


class ReplyTable:
    """A table ``name`` of the session's catalogue with replies (key, reply, ts) in ``buckets`` buckets.

    Buckets should be no fewer than the shuffle partitions, else Spark prefers to shuffle both sides.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"replies_{uuid.uuid4().hex[:12]}"
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], COLUMNS), self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        kept = rows.select(F.col("key").cast("string"), F.col("reply").cast("string"), F.col("ts").cast("timestamp_ntz")).where("key is not null")
        dealt = kept.repartition(self.buckets, "key")  # one file for each bucket and run
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").mode("append").saveAsTable(name)

    def append(self, rows: DataFrame) -> None:
        """Add a run of replies (key, reply, ts)."""
        self._write(rows, self.name)

    def newest(self, cutoff: Column | None = None) -> DataFrame:
        """(key, reply, ts): the newest reply of each key (of one time, the greatest text) that is no older than ``cutoff``."""
        rows = self.spark.table(self.name)
        rows = rows if cutoff is None else rows.where(F.col("ts") >= cutoff)
        return rows.groupBy("key").agg(F.max(F.struct("ts", "reply")).alias("x")).select("key", "x.reply", "x.ts")

    def lookup(self, wanted: DataFrame, cutoff: Column | None = None, key: str = "key") -> DataFrame:
        """``wanted`` with reply and status (cached, missing); rows without a key miss.

        A merge join keeps the table where it lies, however large either side is.
        """
        stored = self.newest(cutoff).select(F.col("key").alias("__key"), "reply").hint("merge")
        joined = wanted.join(stored, F.col(key) == F.col("__key"), "left")
        return joined.withColumn("status", F.when(F.col("__key").isNull(), "missing").otherwise("cached")).drop("__key")

    def compact(self, cutoff: Column | None = None) -> None:
        """Rewrite the newest replies as one run, without those older than ``cutoff``."""
        new, old = f"{self.name}_new", f"{self.name}_old"
        self.spark.sql(f"DROP TABLE IF EXISTS {new}")
        self._write(self.newest(cutoff), new)
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {old}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
