"""The activity log as streams: deduplication, rate limits, validation, monthly windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.filters import ACTIVITY_TYPES, activity_status
from ..sources.io import scratch

#: One microsecond under the gap: session windows merge at the gap itself, the rule merges below it.
STRICT_GAP = "{us} microseconds"
#: Bytes of files that a stream reads at once, about.
BATCH = 64 << 20


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files under a folder, in batches of about BATCH bytes: what a batch costs besides its rows doesn't grow with the files."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH).parquet(path)


def replay(df: DataFrame, path: str, ts: str = "ts") -> DataFrame:
    """df as a stream in time order: a file for each range of `ts`, with modification times in that order."""
    spark = df.sparkSession
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), ts).sortWithinPartitions(ts).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    files.sort(key=lambda s: (int(s.getPath().getName().split("-")[1]), s.getPath().getName()))
    first = max((s.getModificationTime() for s in files), default=0)
    for i, s in enumerate(files):
        fs.setTimes(s.getPath(), first + 10 * i, -1)
        if fs.getFileStatus(s.getPath()).getModificationTime() != first + 10 * i:
            raise OSError(f"{path}: this store keeps no modification times, so files have no order")
    return read_stream(spark, path, df.schema)


def run_now(df: DataFrame, name: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote; output and state are in the shared folder.

    partitions: those of the state, each of which costs a commit in every batch; at most as many as a shuffle has.
    """
    spark = df.sparkSession
    out, dealt = scratch(spark, name), spark.conf.get("spark.sql.shuffle.partitions")
    w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(dealt), partitions or int(dealt))))
        q = w.start(out)  # takes the session's settings as they are now
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", dealt)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def dedup_sessions(events: DataFrame, keys: list[str], seconds: int, late: str = "1 hour") -> DataFrame:
    """One row for each chain of events of a key closer than `seconds`; events with a NULL key pass one by one."""
    us = seconds * 1_000_000 - 1
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    marked = events.withWatermark("ts", late)
    # one condition with ts: rows without a key still move the watermark on, as the filter can't go below it
    merged = marked.filter(F.when(F.col("ts").isNotNull(), whole)).groupBy(*keys, F.session_window("ts", STRICT_GAP.format(us=us))).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("last_ts"), F.count("*").alias("merged"))
    return merged.select(*keys, "event_id", "last_ts", "merged")


#: Keys are kept in so many slots; a checkpoint holds for one number.
SLOTS = 256


class Limiter(StatefulProcessor):
    """The open windows of a slot's keys as one table: (key, opened, hits). Windows that the watermark has passed leave it.

    All keys of a slot are numbered together, so a batch costs a few calls for each slot, not for each key.
    """

    def __init__(self, key: str, kind: str, limit: int, size: int):
        self.key, self.kind, self.limit, self.size = key, kind, limit, size

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", f"keys array<{self.kind}>, opened array<long>, hits array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat([f[[self.key, "event_id", "t"]] for f in rows], ignore_index=True)
        held = self.windows.get() if self.windows.exists() else ([], [], [])
        before, who = {k: i for i, k in enumerate(held[0])}, {}
        own = got[self.key].tolist()
        code = np.fromiter((who.setdefault(k, len(who)) for k in own), np.int64, len(own))
        t, ids = got["t"].to_numpy(), got["event_id"].to_numpy()
        order = np.lexsort((ids, t, code))
        code, t, ids = code[order], t[order], ids[order]
        start, end = np.searchsorted(code, np.arange(len(who))), np.searchsorted(code, np.arange(len(who)), side="right")
        opened, hits, last = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.full(len(who), False)
        for k, c in who.items():
            if k in before:
                opened[c], hits[c], last[c] = held[1][before[k]], held[2][before[k]], True
        open_, n = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        for c in range(len(who)):
            i, j = int(start[c]), int(end[c])
            while i < j:  # a round for each window
                if not last[c] or opened[c] + self.size < t[i]:
                    opened[c], hits[c], last[c] = t[i], 0, True
                k = i + int(np.searchsorted(t[i:j], opened[c] + self.size, side="right"))
                open_[i:k], n[i:k] = opened[c], hits[c] + np.arange(1, k - i + 1)
                hits[c], i = hits[c] + k - i, k
        self.keep([*held[0], *who], [*held[1], *opened.tolist()], [*held[2], *hits.tolist()], timerValues)
        over = n > self.limit
        left = np.floor((open_ + self.size - t) / 1e6 + 0.5).astype(np.int64)
        yield pd.DataFrame({self.key: [own[i] for i in order], "event_id": ids, "allowed": ~over, "remaining": np.maximum(self.limit - n, 0).astype(np.int32), "retry_after": np.where(over, np.maximum(left, 1), 0).astype(np.int32)})

    def keep(self, keys, opened, hits, timerValues) -> None:
        """Hold the last window of each key that has not ended by the watermark, and ask to be called when all have."""
        mark = timerValues.getCurrentWatermarkInMs()
        last = {k: (o, n) for k, o, n in zip(keys, opened, hits)}
        rows = [(k, o, n) for k, (o, n) in last.items() if (o + self.size) // 1000 + 1 > mark]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.windows.update(tuple(list(c) for c in zip(*rows)))
            self.handle.registerTimer(max((o + self.size) // 1000 + 1 for _, o, _ in rows))
        else:
            self.windows.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.windows.exists():
            self.keep(*self.windows.get(), timerValues)
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, key: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, allowed, remaining, retry_after) of each request of a stream, by the rule of operators.rate.

    The session gets the RocksDB state store, which keeps slots of keys on disk and in the checkpoint folder. Requests without a
    key are not limited and have no row; a request that comes later than `late` has none either.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = requests.schema[key].dataType.simpleString()
    timed = requests.filter(F.col(key).isNotNull()).withWatermark("ts", late).select(key, "event_id", F.unix_micros("ts").alias("t"), "ts")
    schema = f"{key} {kind}, event_id long, allowed boolean, remaining int, retry_after int"
    slots = timed.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")).groupBy("slot")
    return slots.transformWithStateInPandas(Limiter(key, kind, limit, seconds * 1_000_000), schema, "append", "EventTime")


def validated(events: DataFrame, good: str, bad: str, types: tuple = ACTIVITY_TYPES):
    """A foreachBatch writer that splits a stream into accepted and rejected rows, once for each batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        told = activity_status(batch, types).persist()
        for path, rows in ((good, told.filter("ok")), (bad, told.filter("not ok"))):
            rows.drop("ok").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        told.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{good}-state").trigger(availableNow=True).start()


def windowed_counts(scenes: DataFrame, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    g = scenes.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), "n", "total")


def by_month(daily: DataFrame) -> DataFrame:
    """(start, n, total) of the months of closed daily windows."""
    return daily.groupBy(F.date_trunc("month", "start").alias("start")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
