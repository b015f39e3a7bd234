"""Parquet tables by name below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, a file or a folder of files named `name`.parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
