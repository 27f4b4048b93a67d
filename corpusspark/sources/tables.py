"""Readers for the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; Parquet carries the schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
