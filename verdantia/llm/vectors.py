"""Vectors against a stated query set, in blocks: what both vector searches share."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts

#: Rows, and queries, that meet in one task on average; both are dealt by a hash of their id. Each row is sent once for
#: every block of queries, and each query once for every block of rows, so blocks are as large as a task takes with ease
#: (16 MB each at 64 dimensions).
ROW_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 15
#: Small tables are dealt to all tasks, but in no smaller blocks of rows than these.
LEAST_BLOCK = 1 << 12


def clean(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(vec_id long, vec array<double>) of usable rows: no null or non-finite component, the usual length, not all zero unless zero."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), x.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    if not zero:
        rows = rows.filter(F.exists("vec", lambda v: v != 0))
    usual = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    d = usual.first()
    return rows.filter(F.size("vec") == (d.d if d else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list<double> column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def meet(rows: DataFrame, queries: DataFrame, step: Callable, k: int, schema: str, best: str) -> DataFrame:
    """step(row table, query table) for every block pair, then the k best candidates of each query by `best`, vec_id."""
    n, m = rows.count(), queries.count()
    blocks = max(1, math.ceil(m / QUERY_BLOCK))
    salts = max(1, math.ceil(n / ROW_BLOCK), min(parts(rows.sparkSession) // blocks, math.ceil(n / LEAST_BLOCK)))
    place = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(salts)).cast("int")
    left = rows.withColumn("salt", place).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = ["salt", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(step, schema)
    near = near.groupBy("query_id", "vec_id").agg((F.min if best == "asc" else F.max)("score").alias("score"))
    order = F.col("score").asc() if best == "asc" else F.col("score").desc()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_each(rows: DataFrame, step: int) -> DataFrame:
    """The query set: rows whose id is divisible by step, one vector for each id."""
    return rows.filter(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
