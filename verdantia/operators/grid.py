"""The fixed grid: origin and block size in metres. And how rows are dealt that become many."""

from __future__ import annotations

from pyspark.sql import DataFrame

X0, Y0, CELL = 300000, 2000000, 250


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as a shuffle has: rows that become many would else be made by the few tasks that read a small file."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
