"""Reports as Parquet tables: written in whole, read again by path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .stored import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a report in the folder that all executors share."""
    return f"{shared_folder(spark)}/lotwright/{name}-{uuid.uuid4().hex}"


def save(report: DataFrame, path: str, partitions: list[str]) -> str:
    """Write a report, over one that is there, in folders of the `partitions` columns; returns the path."""
    report.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
