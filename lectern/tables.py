"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of part files) of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
