"""Session construction with the settings the plans in this package rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "groundspark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution. ``master`` and ``extra`` override the defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
