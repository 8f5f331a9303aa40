"""Parquet tables of one data folder, read lazily so that columns and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; nothing is read before an action needs it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
