"""Readers for the input tables.

Every reader returns a lazy scan, so that filters and column selections written
by the callers reach the Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, a single Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
