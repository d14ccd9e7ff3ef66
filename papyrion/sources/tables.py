"""Parquet tables by folder: the only way the queries read their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet`` with Spark, so that any file system works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with n, their place from 1 in the order of a column, without a global window.

    Rows are dealt by range; the sizes of the ranges are summed apart and each numbers its own.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from papyrion.workspace import materialize

    dealt = materialize(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return dealt.join(starts, "__p").withColumn("n", F.col("__s") + place).drop("__p", "__s")
