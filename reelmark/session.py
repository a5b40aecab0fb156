"""The session that queries and tests run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """ANSI mode, UTC, adaptive plans. On a cluster pass its master; partitions are then those of the input's size."""
    builder = SparkSession.builder.appName("reelmark").master(master)
    for key, value in {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
