"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table name of the folder; columns are pruned and filters pushed by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
