"""Readers of the memory relations with tolerant, explicit typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One relation of a folder of Parquet tables (file or directory)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
