"""The study's Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns and filters used later are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
