"""A local session with the settings that the engine is measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: str | int = 8, memory: str = "8g") -> SparkSession:
    """local[cpus], as many shuffle partitions, adaptive plans, UTC."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quire")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
