"""Session construction with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "claimloom", cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    """Local session for tests and benches; on a cluster the submitter's own settings win."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CLAIMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
