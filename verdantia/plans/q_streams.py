"""Queries of the streams, run over what the tables hold."""

from pyspark.sql import functions as F

from ..operators import rate as R
from ..operators import windows as O
from ..sources.io import scratch
from ..streaming import activity as A
from .catalog import query
from .q_windows import COUNTED, DECIDED


def event_stream(v, extra: tuple = (), ends: str = ""):
    """The activity view written as files and read as a stream, in time order.

    ends: an interval after the last event at which a row without a key comes, so that the watermark closes all before it.
    """
    made = v.activity.withColumns(dict(extra)) if extra else v.activity
    if ends:
        made = made.unionByName(made.agg((F.max("ts") + F.expr(f"interval {ends}")).alias("ts")), allowMissingColumns=True)
    return A.replay(made, scratch(v.spark, "events"))


@query("""SELECT user_id, event_type, entity, arg_min(event_id, ts) AS event_id, count(*) AS merged FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type, entity ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type, entity ORDER BY ts, event_id) AS prev FROM activity WHERE entity IS NOT NULL) a) b) c GROUP BY user_id, event_type, entity, s""")
def stm_activity_dedup(v):
    """Sessions leave the state as they close; the gap is six hours, as in the batch twin."""
    stream = event_stream(v, ends="2 days")
    return A.run_now(A.dedup_sessions(stream, ["user_id", "event_type", "entity"], 21600, "1 hour"), "sessions").select("user_id", "event_type", "entity", "event_id", "merged")


@query(DECIDED)
def stm_rate_limit(v):
    return A.run_now(A.rate_limit(event_stream(v), "user_id", 2, 86400), "limits", partitions=2 * v.spark.sparkContext.defaultParallelism)


@query(f""", {COUNTED}, latest AS (SELECT max(t) AS moment FROM hits), last AS (SELECT user_id, arg_max(open, t) AS open, max(CASE WHEN open = top THEN n END) AS n FROM (SELECT *, max(open) OVER (PARTITION BY user_id) AS top FROM counted) c GROUP BY user_id),
used AS (SELECT user_id, open + 86400000000 - moment AS rest, CASE WHEN open + 86400000000 < moment THEN 0 ELSE n END AS n FROM last, latest)
SELECT user_id, n < 2 AS allowed, CAST(greatest(2 - n, 0) AS INTEGER) AS remaining, CASE WHEN n >= 2 THEN greatest(1, CAST(round(rest / 1000000.0) AS INTEGER)) ELSE 0 END AS retry_after FROM used""")
def stm_rate_status(v):
    """What each key may still do at the time of the last request of all."""
    latest = v.activity.agg(F.max("ts").alias("latest")).first()[0]
    return R.rate_status(v.activity, "user_id", "ts", 2, 86400, F.lit(latest))


@query("SELECT event_id, (SELECT count(*) FROM activity WHERE user_id = 7 AND event_type <> 'view') AS total FROM activity WHERE user_id = 7 AND event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10")
def stm_activity_feed(v):
    mine = v.activity.filter("user_id = 7 and event_type != 'view'")
    return O.page(mine, [F.desc("ts"), F.desc("event_id")], 2, 10).select("event_id", "total")


@query("SELECT event_type IN ('click', 'view', 'purchase', 'signup') AND event_id % 130 BETWEEN 1 AND 120 AS ok, count(*) AS n FROM activity GROUP BY 1")
def stm_event_validate(v):
    stream = event_stream(v, (("title", F.repeat(F.lit("t"), (F.col("event_id") % 130).cast("int"))), ("description", F.lit("d"))))
    good, bad = scratch(v.spark, "good"), scratch(v.spark, "bad")
    A.validated(stream, good, bad, ("click", "view", "purchase", "signup")).awaitTermination()
    rows = v.spark.read.parquet(good).select(F.lit(True).alias("ok")).unionAll(v.spark.read.parquet(bad).select(F.lit(False).alias("ok")))
    return rows.groupBy("ok").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('month', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM activity GROUP BY 1")
def stm_scene_monthly(v):
    """The stream keeps a day's sums until the day is over; months are sums of its closed days."""
    daily = A.run_now(A.windowed_counts(event_stream(v, ends="3 days"), "value", late="1 hour"), "daily")
    return A.by_month(daily).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
