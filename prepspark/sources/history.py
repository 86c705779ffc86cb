"""Append-only run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(record: DataFrame, path: str) -> None:
    """Add run records to the history table."""
    record.write.mode("append").parquet(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_history_topn(history: DataFrame, n: int = 5, ts: str = "ts", key: str = "run_id") -> DataFrame:
    """The last n runs, newest first, ties by key."""
    return history.orderBy(F.desc(ts), F.desc(key)).limit(n)
