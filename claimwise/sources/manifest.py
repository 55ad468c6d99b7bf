"""Small state tables that are replaced as a whole.

A state is a Parquet folder ``v-<time>`` written by one Spark job; it counts once
its ``_SUCCESS`` marker is there, and the newest such folder is what readers follow.
A job that dies leaves the state before it in place.  One writer at a time.
"""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the states that were written whole, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v-*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def latest(spark: SparkSession, folder: str, schema: str) -> list:
    """Rows of the newest state; none before the first."""
    found = versions(spark, folder)
    return spark.read.schema(schema).parquet(found[-1]).collect() if found else []


def publish(spark: SparkSession, folder: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/v-{time.time_ns():020d}")
