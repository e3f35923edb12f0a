"""A local session for tests and benches; clusters bring their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session on this machine with the settings the library expects (UTC, AQE, Arrow)."""
    n = cores or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("semantide")
        .config("spark.driver.memory", os.environ.get("SEMANTIDE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
