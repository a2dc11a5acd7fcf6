"""Session set-up shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidemill", cpus: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution.

    ``cpus`` only matters for local runs; on a cluster the master, memory and
    partition settings come from spark-submit and are left alone.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", os.environ.get("TIDEMILL_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()
