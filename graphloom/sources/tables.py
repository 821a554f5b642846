"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a lazy scan; columns and filters of a query reach the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
