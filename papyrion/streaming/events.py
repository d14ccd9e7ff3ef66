"""Streams: latest state by key, usage by window, cursors that only move down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.workspace import remove


def file_stream(spark: SparkSession, folder: str, schema, names: str = "*.parquet", per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder whose names match, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", names).parquet(folder)


def state_paths(spark: SparkSession, target: str) -> dict[int, dict[int, str]]:
    """Part -> batch number -> folder of the tables of a state."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{target}/*/part=*")
    found: dict[int, dict[int, str]] = {}
    for status in glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []:
        path = status.getPath().toString()
        number, part = path.split("/")[-2:]
        found.setdefault(int(part.split("=")[1]), {})[int(number)] = path
    return found


def _newest(spark: SparkSession, target: str, below: int | None = None, parts: set[int] | None = None) -> list[str]:
    kept = [{n: p for n, p in tables.items() if below is None or n < below} for part, tables in state_paths(spark, target).items() if parts is None or part in parts]
    return [tables[max(tables)] for tables in kept if tables]


def state(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows of a state: of each part the newest table."""
    paths = _newest(spark, target)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(stream: DataFrame, key: str, order: str, target: str, checkpoint: str):
    """Fold a stream into one row per key, the one of highest ``order``; returns the finished query.

    For small states: each micro-batch writes the whole state as a table of its own number, from
    the one before, so a repeated batch gives the same state; older ones go.  ``upsert_parts``
    writes only what a batch touches.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/{number - 1}").unionByName(batch)
        _last(rows, key, order).write.mode("overwrite").parquet(f"{target}/{number}")
        if number > 1:
            remove(spark, f"{target}/{number - 2}")

    return _finished(stream.writeStream.foreachBatch(merge), checkpoint)


def _last(rows: DataFrame, key: str, order: str) -> DataFrame:
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def _finished(writer, checkpoint: str):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_parts(stream: DataFrame, key: str, order: str, target: str, checkpoint: str, parts: int = 64):
    """Fold a stream into one row per key, the one of highest ``order``; returns the finished query.

    The state lies in ``parts`` parts by a hash of the key.  A micro-batch is merged with the
    newest tables of the parts it touches and writes these parts under its own number, so it
    costs in proportion to them, and a repeated batch reads the tables before it and gives the
    same state.  Of a part the new table and the one before it stay; ``state`` reads the newest.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        rows = batch.persist()
        touched = {r[0] for r in rows.select(part).distinct().collect()}  # at most ``parts`` numbers
        old = _newest(spark, target, number, touched)
        both = rows.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else rows
        _last(both, key, order).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{target}/{number}")
        rows.unpersist()
        for p, tables in state_paths(spark, target).items():
            for n in sorted(n for n in tables if n < number)[:-1] if p in touched else ():
                remove(spark, tables[n])

    return _finished(stream.writeStream.foreachBatch(merge), checkpoint)


def usage_windows(stream: DataFrame, ts: str, tokens: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and tokens by tumbling event-time window, with a watermark; works on tables too."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width)).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def advance_cursor(cursors: DataFrame, seen: DataFrame, key: str, ts: str) -> DataFrame:
    """cursors (key, ts) moved to the smallest time seen of each key; a cursor never moves up."""
    low = seen.groupBy(key).agg(F.min(ts).alias("__low"))
    return cursors.join(low, key, "full").select(key, F.least(F.col(ts), F.col("__low")).alias(ts))


def next_month(cursors: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Monthly backfill: a cursor (key, month) goes one month back if that month was completed; done (key, month)."""
    finished = done.select(key, "month").distinct().withColumn("__d", F.lit(True))
    joined = cursors.join(finished, [key, "month"], "left")
    return joined.select(key, F.when(F.col("__d"), F.add_months("month", -1)).otherwise(F.col("month")).alias("month"))
