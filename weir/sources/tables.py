"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` in ``folder``; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
