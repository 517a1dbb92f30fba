"""A Spark session with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", **settings: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own master and sizes."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("declarium")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
