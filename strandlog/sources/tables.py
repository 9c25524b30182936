"""Readers of the tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; a single file and a folder of parts read alike."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
