"""A Spark session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def panel_session(app: str = "tidepanel", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        builder = builder.config("spark.driver.memory", os.environ.get("TIDEPANEL_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        # window work is heavy per byte: keep small shuffles spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .getOrCreate()
    )
