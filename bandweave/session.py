"""Session builder used by the tests and the benchmark; queries take any session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "bandweave", cpus: int | None = None, memory: str = "6g") -> SparkSession:
    """Local session with UTC, adaptive execution and partitions sized to the cores."""
    cores = cpus or os.cpu_count() or 2
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
