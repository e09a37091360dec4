"""Given tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a directory; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
