"""Session settings in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed join partitions and merges small ones; times are UTC everywhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for one machine; on a cluster the submitter sets master and partitions."""
    builder = SparkSession.builder.master(master).appName("ridgeflow").config("spark.sql.shuffle.partitions", partitions)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
