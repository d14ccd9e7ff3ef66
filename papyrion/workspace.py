"""Intermediate tables that survive the loss of an executor.

Iterative operators cut their lineage by writing a Parquet table in the folder that the
cluster names in ``spark.checkpoint.dir``, which every executor and the driver can reach.
A written table also has a size that the planner knows, so a join with it is broadcast
only when the table is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, under ``spark.checkpoint.dir``.

    Only where the setting is missing and Spark runs in this process alone (tests) a temporary
    folder is made; on a cluster no executor could read it, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="papyrion-")
        _FOLDERS[app] = f"{top.rstrip('/')}/papyrion-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; nothing happens once Spark has stopped."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001 - the gateway is gone at shutdown
        return


class Table:
    """A written intermediate table: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*(partition_by or [])).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


@contextlib.contextmanager
def tasks_of(spark: SparkSession, rows: int, most: int, size: str = "16m"):
    """Tables written meanwhile are shuffled to one task for each ``most`` of ``rows`` at least, and tasks read about ``size`` bytes.

    Else a task's hash tables grow with the data: the number of partitions is fixed, and 64 MB of
    shuffled, or 128 MB of written keys are tens of millions of them.  Map-side combination and AQE's skew joins stay.
    """
    wanted = {
        "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / most))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def apart(df: DataFrame) -> DataFrame:
    """``df``, whose rows go one by one to what follows; nothing is shuffled and no partitions are joined.

    Spark compiles generators in a row to one loop and holds copies of all rows that an input row makes there, so two
    lists of 1,000 are a million rows on the heap at once.  A coalescing to more partitions than there are ends that loop.
    """
    return df.coalesce(100_000)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    return Table(df, name).df
