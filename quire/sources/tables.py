"""Table scans by directory: one Parquet table (file or folder) per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
