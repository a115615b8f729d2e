"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive plans with skew handling; partitions and memory stay the cluster's unless given."""
    b = SparkSession.builder.appName("verdantia").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
