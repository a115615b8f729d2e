"""Mixing sources to target weights (operator 3), with DataFrame functions only.

Targets share a budget of words by weight; no source gives more than `repeats` times its size, and what it cannot give is
shared again by weight among the others until none is above. A source's documents stand in a fixed shuffled order and
are cut, `repeats` passes in a row, into blocks of equal numbers of words. The schedule has 2**k slots; slot i takes the
van der Corput point bit_reverse(i) / 2**k through the cumulative targets to its source, and its rank among that source's
slots names the block it takes. So every stretch of the mix is close to the target shares, and a source's slots and
blocks number the same up to one.

Null text has size 0; a null source is a source of its own, last in order; equal rows are separate documents; an empty
table gives an empty result; other columns are ignored. Sums are exact integers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Slots: at least 2**LEAST, and blocks of at most MOST words.
LEAST, MOST = 16, 16384
#: Sources that are broadcast at most (about 100 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def sizes(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("look"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, ord, source_size, target): one row per source; the windows run over sources, not documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("ord", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int"))
    by = by.withColumns({"w": w.cast("double"), "cap": F.col("source_size") * repeats})
    # full sources come first in the order of cap / weight: a source is full if the level that would be left for it
    # and all after it, once those before are full, is at its cap or above
    fill = W.orderBy(F.col("cap") / F.col("w"), "ord")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    by = by.withColumns({"used": F.coalesce(F.sum("cap").over(before), F.lit(0)), "wrest": F.sum("w").over(rest), "total": F.sum("source_size").over(W.partitionBy())})
    by = by.withColumn("level", (F.col("total") * share - F.col("used")) / F.col("wrest"))
    by = by.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    by = by.withColumn("last", F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy()))
    return by.select("source", "ord", "source_size", "total", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("last") * F.col("w")).alias("target"))


def plan(goal: DataFrame, share: float) -> DataFrame:
    """goal with the slot bounds [lo, hi) of each source, the exponent k and the words of all slots."""
    words = F.ceil(F.col("total") * share).cast("long")
    k = F.greatest(F.lit(LEAST), F.ceil(F.log2(F.greatest(words, F.lit(1)) / MOST))).cast("int")
    upto = F.sum("target").over(W.orderBy("ord"))
    all_ = F.sum("target").over(W.partitionBy())
    goal = goal.withColumns({"words": words, "slots": F.pow(F.lit(2.0), k).cast("long"), "upto": upto, "all": all_})
    hi = F.when(F.col("all") > 0, F.least(F.round(F.col("upto") / F.col("all") * F.col("slots")).cast("long"), F.col("slots"))).otherwise(F.lit(0).cast("long"))
    goal = goal.withColumns({"hi": hi, "k": k, "step": F.greatest(F.col("words"), F.lit(1)).cast("double") / F.col("slots")})
    return goal.withColumn("lo", F.lag("hi", 1, 0).over(W.orderBy("ord")))


def schedule(planned: DataFrame) -> DataFrame:
    """(slot, source, ord, block): the mix in order; slots of a source take its blocks one after another."""
    width = 4096
    chunk = planned.filter("hi > lo").select("ord", "source", "lo", "hi", "k", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("chunk"))
    point = chunk.select("ord", "source", "k", F.explode(F.sequence(F.greatest("lo", F.col("chunk") * width), F.least(F.col("hi"), (F.col("chunk") + 1) * width) - 1)).alias("point"))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), F.col("k"), F.lit("0"))), 2, 10).cast("long")
    slots = point.select("ord", "source", slot.alias("slot")).withColumn("part", F.floor(F.col("slot") / width))
    count = slots.groupBy("ord", "part").agg(F.count("*").alias("n"))
    before = count.withColumn("before", F.sum("n").over(W.partitionBy("ord").orderBy("part")) - F.col("n")).drop("n")
    ranked = slots.withColumn("rank", F.row_number().over(W.partitionBy("ord", "part").orderBy("slot")) - 1)
    return ranked.join(before, ["ord", "part"]).select("slot", "source", "ord", (F.col("rank") + F.col("before")).alias("block"))


def small(planned: DataFrame) -> DataFrame:
    return F.broadcast(planned) if planned.count() <= BROADCAST_ROWS else planned


def streams(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """sized with its source's plan and `start`, the words before it in the source's shuffled order."""
    rows = sized.join(small(planned), sized["source"].eqNullSafe(planned["source"])).drop(planned["source"])
    rows = rows.withColumn("place", F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.lit(""))))).withColumn("slice", F.substring("place", 1, 3))
    sums = rows.groupBy("ord", "slice").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("ord").orderBy("slice")) - F.col("n")).drop("n")
    local = W.partitionBy("ord", "slice").orderBy("place", "size", "look").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(local), F.lit(0)))
    return rows.join(before, ["ord", "slice"]).withColumn("start", F.col("before") + F.col("within"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(key, source, size, source_size, target, taken) of every document."""
    sized = cut(sizes(docs, text, source, key))
    planned = cut(plan(targets(sized, weights, share, repeats), share))
    rows = streams(sized, planned)
    edge = lambda b: F.floor(b * F.col("step"))  # first word of block b
    words = rows.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    words = words.withColumn("end", F.col("start") + F.col("size"))
    blocks = F.sequence(F.greatest(F.floor(F.col("start") / F.col("step")) - 1, F.lit(0)), F.floor(F.col("end") / F.col("step")) + 1)
    words = words.select("ord", "place", "id", "size", "start", "end", "step", F.explode(blocks).alias("block"))
    part = F.greatest(F.least("end", edge(F.col("block") + 1)) - F.greatest("start", edge(F.col("block"))), F.lit(0))
    words = words.withColumn("part", part).filter("part > 0")
    took = words.join(schedule(planned).select("ord", "block"), ["ord", "block"]).groupBy("ord", "place", "id", "size", "start").agg(F.sum("part").alias("part"))
    # a document's first pass starts at `start`, its next at start + source_size
    took = took.join(small(planned.select("ord", "source_size")), "ord").withColumn("start", F.expr("start % source_size")).groupBy("ord", "place", "id", "size", "start").agg(F.sum("part").cast("long").alias("taken"))
    took = took.select(*(F.col(c).alias(f"{c}_") for c in ("ord", "place", "id", "size", "start")), "taken")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("ord", "place", "id", "size", "start")]
    out = rows.join(took, same, "left")
    return out.select(F.col("id").alias(key), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(ord % 3) + 1] AS DOUBLE) AS w, source_size * 2 AS cap FROM by_source),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goal AS (
  SELECT source, ord, source_size, CASE WHEN cap <= level * w THEN CAST(cap AS DOUBLE) ELSE (SELECT max(level) FROM levels WHERE cap > level * w) * w END AS target FROM levels),
slots AS (
  SELECT CAST(ceil(sum(source_size) * 1.5::DOUBLE) AS BIGINT) AS words, CAST(1 AS BIGINT) << CAST(greatest(16, ceil(log2(greatest(ceil(sum(source_size) * 1.5::DOUBLE), 1) / 16384))) AS INTEGER) AS slots FROM goal),
bounds AS (
  SELECT g.*, words, slots, greatest(words, 1)::DOUBLE / slots AS step,
         CAST(round((SELECT sum(h.target ORDER BY h.ord) FROM goal h WHERE h.ord <= g.ord) / (SELECT sum(target) FROM goal) * slots) AS BIGINT) AS hi
  FROM goal g, slots),
planned AS (SELECT *, CAST(floor((hi - lag(hi, 1, 0) OVER (ORDER BY ord)) * step) AS BIGINT) AS upto FROM bounds),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.upto,
         coalesce(sum(s.size) OVER (PARTITION BY p.ord ORDER BY substr(place, 1, 3), place, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(start + size, upto) - start, 0) + greatest(least(start + size + source_size, upto) - start - source_size, 0) AS BIGINT) AS taken
FROM placed
"""


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source")
