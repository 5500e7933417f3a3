"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Spark's reader alone touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
