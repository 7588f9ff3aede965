"""Shared tables: intermediate results in the folder that driver and executors both reach."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from lossweave.runtime import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. The job's shuffle files go as soon as the table is written."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.pinned_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete the files of pinned tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "pinned_at", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def task_count(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for so many rows: enough to bound each, and at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_task))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
