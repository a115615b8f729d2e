"""Fixed-window request limits: a window opens with the first request after the one before it has ended.

The openings of a key are a chain: from each, the next is the first request later than its window. Times fall in buckets as
wide as a window, so a request's successor is in the next bucket or is the first request of a later one, and a bucket holds
one opening at most. So successors come from windows over single buckets, and the openings are marked by doubling: each round
follows jumps twice as long. No key's history meets in one row; only its first requests of each bucket meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import written


def successors(hits: DataFrame, size: int) -> DataFrame:
    """(key, node, next): nodes are (t, id); next is the key's first request later than t + size. Requests without one are left out."""
    bucket = F.floor(F.col("t") / size).cast("long")
    here = hits.select("key", bucket.alias("b"), F.col("t").alias("at"), F.lit(1).alias("is"), F.struct("t", "id").alias("node"))
    asked = here.select("key", (F.col("b") + 1).alias("b"), (F.col("at") + size).alias("at"), F.lit(0).alias("is"), "node")
    rows = here.unionByName(asked)
    request = F.when(F.col("is") == 1, F.col("node"))
    # from the latest backwards; who asks comes before requests at that very time, which are not later
    back = W.partitionBy("key", "b").orderBy(F.desc("at"), "is", F.desc("node")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = rows.withColumn("near", F.last(request, ignorenulls=True).over(back)).filter("is = 0")
    buckets = rows.groupBy("key", "b").agg(F.min(request).alias("first"))
    behind = W.partitionBy("key").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    later = buckets.select("key", "b", F.last("first", ignorenulls=True).over(behind).alias("later"))
    return near.join(later, ["key", "b"]).select("key", "node", F.coalesce("near", "later").alias("next")).filter("next is not null").distinct()


def openings(hits: DataFrame, size: int) -> DataFrame:
    """(key, t, id): the requests that open a window. After round k, 2**k of each key's chain are marked."""
    marked = fresh = written(hits.groupBy("key").agg(F.min(F.struct("t", "id")).alias("node")))
    jumps = written(successors(hits, size))
    while True:
        fresh = written(marked.join(jumps, ["key", "node"]).select("key", F.col("next").alias("node")))
        if fresh.isEmpty():
            return marked.select("key", "node.t", "node.id")
        marked = written(marked.unionByName(fresh))
        on = jumps.select("key", F.col("node").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(on, ["key", "next"]).select("key", "node", F.col("far").alias("next")))


def counted(requests: DataFrame, key: str, ts: str, seconds: int, id_: str = "event_id") -> DataFrame:
    """(key, id, t, open, n) of each request: when its window opened, and its number in it."""
    size = seconds * 1_000_000
    hits = written(requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(ts).alias("t"), F.col(id_).alias("id")))
    bucket = F.floor(F.col("t") / size).cast("long")
    starts = openings(hits, size).select("key", F.explode(F.array(bucket, bucket + 1)).alias("b"), "t", F.lit(0).alias("is"), "id", F.struct("t", "id").alias("open"))
    rows = hits.select("key", bucket.alias("b"), "t", F.lit(1).alias("is"), "id", F.lit(None).cast(starts.schema["open"].dataType).alias("open")).unionByName(starts)
    at = W.partitionBy("key", "b").orderBy("t", "id", "is").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = rows.withColumn("open", F.last("open", ignorenulls=True).over(at)).filter("is = 1")
    number = F.row_number().over(W.partitionBy("key", "open").orderBy("t", "id"))
    return told.select(F.col("key").alias(key), F.col("id").alias(id_), "t", F.col("open.t").alias("open"), number.alias("n"))


def wait(left: Column) -> Column:
    """Whole seconds until a window ends, one at least."""
    return F.greatest(F.lit(1), F.round(left / 1e6).cast("int"))


def fixed_window_counter(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, id_: str = "event_id") -> DataFrame:
    """(key, id, allowed, remaining, retry_after) of each request; those without a key or a time have no row."""
    rows = counted(requests, key, ts, seconds, id_)
    left = F.col("open") + seconds * 1_000_000 - F.col("t")
    return rows.select(key, id_, (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).alias("remaining"), F.when(F.col("n") > limit, wait(left)).otherwise(0).alias("retry_after"))


def rate_status(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, now: Column, id_: str = "event_id") -> DataFrame:
    """(key, allowed, remaining, retry_after) of each key at the time `now`, without a new hit; requests after it don't count."""
    past = requests.filter(F.col(ts) <= now)
    last = counted(past, key, ts, seconds, id_).groupBy(key).agg(F.max(F.struct("open", "n")).alias("s"))
    left = F.col("s.open") + seconds * 1_000_000 - F.unix_micros(now)
    used = F.when(left < 0, 0).otherwise(F.col("s.n"))
    return last.select(key, (used < limit).alias("allowed"), F.greatest(F.lit(limit) - used, F.lit(0)).alias("remaining"), F.when(used >= limit, wait(left)).otherwise(0).alias("retry_after"))
