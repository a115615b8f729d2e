"""Request limits: the table operator and the stream against a fold in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from verdantia.operators import rate as R
from verdantia.sources.io import scratch
from verdantia.streaming import activity as A

SECOND = 1_000_000


def fold(rows, limit, seconds):
    """{id: (allowed, remaining, retry_after)} of (key, id, microseconds), and the last window of each key."""
    out, state = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        opened, n = state.get(k, (None, 0))
        opened, n = (t, 1) if opened is None or opened + seconds * SECOND < t else (opened, n + 1)
        state[k] = (opened, n)
        left = (opened + seconds * SECOND - t) / 1e6
        out[i] = (n <= limit, max(limit - n, 0), max(1, int(left + 0.5)) if n > limit else 0)
    return out, state


def hits(n, keys, span, seed):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(keys)}", i, r.randrange(span) * SECOND // 4) for i in range(n)]
    return rows + [("same", n + i, 7 * SECOND) for i in range(9)] + [("edge", n + 20 + i, t * SECOND) for i, t in enumerate((0, 60, 120, 181, 181, 300))] + [("gap", n + 30 + i, t * SECOND) for i, t in enumerate((-400, -340, -339, 10**7, 10**7 + 61))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, event_id long, us long").select("k", "event_id", F.timestamp_micros("us").alias("ts"))


@pytest.mark.parametrize("span,seconds,limit", [(400, 10, 2), (40, 60, 3)])
def test_table(spark, span, seconds, limit):
    rows = hits(600, 4, span, span)
    want, state = fold(rows, limit, seconds)
    df = frame(spark, rows + [(None, 900, 5), ("nowhen", 901, None)])
    got = R.fixed_window_counter(df, "k", "ts", limit, seconds).collect()
    assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in got} == want
    now = 30 * SECOND
    past, state = fold([x for x in rows if x[2] <= now], limit, seconds)
    held = {k: 0 if o + seconds * SECOND < now else n for k, (o, n) in state.items()}
    told = R.rate_status(df, "k", "ts", limit, seconds, F.timestamp_micros(F.lit(now))).collect()
    assert {r.k: (r.allowed, r.remaining) for r in told} == {k: (n < limit, max(limit - n, 0)) for k, n in held.items()}
    assert {r.k: r.retry_after for r in told} == {k: max(1, int((state[k][0] + seconds * SECOND - now) / 1e6 + 0.5)) if n >= limit else 0 for k, n in held.items()}


def test_a_key_with_many_requests_is_in_no_array_and_no_group(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_300_000).alias("ts"))
    found = R.fixed_window_counter(df, "k", "ts", 20, 60)
    opened = R.openings(df.select(F.lit("hot").alias("key"), F.unix_micros("ts").alias("t"), F.col("event_id").alias("id")), 60 * SECOND).count()
    every = 60_000_000 // 1_300_000 + 1  # requests of a window
    assert opened == -(-n // every)
    assert found.filter("allowed").count() == 20 * (n // every) + min(20, n % every)
    plan = R.counted(df, "k", "ts", 60)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan


def test_stream_restarts_from_its_checkpoint(spark):
    """Decisions of two runs over one checkpoint equal those of one fold; the second run meets windows that the first has opened."""
    rows = sorted(((k, i, t + 1_700_000_000 * SECOND) for k, i, t in hits(400, 3, 4000, 5) if t < 10**12), key=lambda r: r[2])
    src, out = scratch(spark, "requests"), scratch(spark, "decisions")
    schema = frame(spark, rows[:1]).schema
    for part in (rows[:170], rows[170:300], rows[300:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        stream = A.rate_limit(A.read_stream(spark, src, schema), "k", 2, 60)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    got = {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert got == fold(rows, 2, 60)[0]
