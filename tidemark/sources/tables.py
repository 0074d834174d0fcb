"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder; the scan reads only the columns a query uses."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
