"""Ranks, running totals, sessions, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import written
from .spatial import first_by


def rank_candidates(df: DataFrame, per: list[str], key: str = "block_id") -> DataFrame:
    """1-based rank: scored before excluded, lowest score first, then id."""
    order = W.partitionBy(*per).orderBy(F.col("score").isNull(), F.col("score").asc_nulls_last(), key)
    return df.withColumn("rank", F.row_number().over(order))


def top2_gap(df: DataFrame, key: str, value: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(value)))
    top = df.withColumn("_r", rank).filter("_r <= 2")
    return top.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("second"))


def prefix_sum(df: DataFrame, lead: str, value: str, ties: tuple = (), descending: bool = False, name: str = "running", rows: int = 1_000_000) -> DataFrame:
    """Running total over a global order without a single-partition window.

    The order is `lead`, then `ties`, which should make it total: rows are dealt by ranges of it, about `rows` to each, and
    written with their range's number. Sums of ranges, a row for each, give what stands before a range; windows run within
    ranges. Equal leads are split by their ties.
    """
    base = written(df)
    order = [F.col(lead).desc() if descending else F.col(lead).asc(), *ties]
    ranges = max(1, -(-base.count() // rows))
    if ranges == 1:  # a single range of at most `rows` rows
        return base.withColumn(name, F.sum(value).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    cut = written(base.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()))
    sums = cut.groupBy("_p").agg(F.sum(value).alias("_b"))
    kind = sums.schema["_b"].dataType
    ahead = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_b").over(ahead).cast(kind), F.lit(0).cast(kind)).alias("_b"))
    local = F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn(name, local).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col(name)).drop("_p", "_b")


def within_budget(ranked: DataFrame, lead: str, value: str, limit: float, ties: tuple = ()) -> DataFrame:
    """The longest beginning of the order, highest lead first, whose running total stays within the limit."""
    return prefix_sum(ranked, lead, value, ties, descending=True).filter(F.col("running") <= limit)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks with ties: distinct values are counted and summed up first, so windows run over values."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    n = prefix_sum(n, column, "_n", name="_upto").select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(n, column, "left")


def gap_sessions(events: DataFrame, keys: list[str], ts: str, seconds: int, first: list[str]) -> DataFrame:
    """Merges an event into the session before it when less than `seconds` have passed since the last one; a NULL key never merges."""
    w = W.partitionBy(*keys).orderBy(ts, "event_id")
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    some = F.lit(False)
    for k in keys:
        some = some | F.col(k).isNull()
    fresh = some | gap.isNull() | (gap >= seconds * 1_000_000)
    made = events.withColumn("_s", F.sum(fresh.cast("long")).over(w))
    return made.groupBy(*keys, "_s").agg(*(F.min_by(c, F.struct(ts, "event_id")).alias(c) for c in first), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("merged")).drop("_s")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a page with the total and whether more follow; the page itself is a bounded top-n."""
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order).limit(number * size)
    rn = F.row_number().over(W.orderBy(*order))  # over at most number * size rows
    rows = top.withColumn("rn", rn).filter(F.col("rn") > (number - 1) * size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > number * size)


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= cap).drop("_rn")


def nested_prefixes(df: DataFrame, order: list[Column], sizes: dict[str, int]) -> DataFrame:
    """(scenario, rank, row): nested beginnings of one ranking; only the longest is sorted."""
    top = df.orderBy(*order).limit(max(sizes.values()))
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    names = F.filter(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("k")) for n, k in sizes.items())), lambda s: s["k"] >= F.col("rank"))
    return ranked.withColumn("s", F.explode(names)).withColumn("scenario", F.col("s.scenario")).drop("s")


def top_overlap(df: DataFrame, old: str, new: str, n: int, key: str) -> DataFrame:
    a = df.filter(F.col(old).isNotNull()).orderBy(F.desc(old), key).limit(n).select(key)
    b = df.filter(F.col(new).isNotNull()).orderBy(F.desc(new), key).limit(n).select(key)
    return a.join(b, key, "left_semi").agg(F.count("*").alias("common"))


def union_layers(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def union_tagged(groups: list[tuple[str, DataFrame]], name: str = "label") -> DataFrame:
    return union_layers([df.withColumn(name, F.lit(label)) for label, df in groups])


def dedupe_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return first_by(df, key, [order])


def cells_minus(a: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Cells (cx, cy) of a that none of the others has, once each; one pass of flags, no join. A cell without a number is in no other."""
    marked = [a.select("cx", "cy", F.lit(False).alias("gone"))] + [x.select("cx", "cy", F.lit(True).alias("gone")).dropna() for x in others]
    return union_layers(marked).groupBy("cx", "cy").agg(F.max("gone").alias("gone")).filter("not gone").drop("gone")


def impervious_or(*columns: str) -> Column:
    """1 if any is 1, NULL only if all are."""
    any_ = F.lit(False)
    for c in columns:
        any_ = any_ | F.coalesce(F.col(c) == 1, F.lit(False))
    return F.when(F.coalesce(*columns).isNotNull(), any_.cast("int"))


def impervious_masked(seg: str, *others: str) -> Column:
    """NULL wherever seg is."""
    return F.when(F.col(seg).isNotNull(), F.greatest((F.col(seg) == 1).cast("int"), *(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)) for c in others)))


def mask_gap_overlap(wards: DataFrame, boundary: DataFrame) -> DataFrame:
    """Cells of the boundary in no ward, of wards outside the boundary, and in more than one ward."""
    w, b = wards.select("ward_id", "cx", "cy").distinct(), boundary.select("cx", "cy").distinct()
    n = w.groupBy("cx", "cy").agg(F.count("*").alias("n")).join(b.withColumn("b", F.lit(1)), ["cx", "cy"], "full_outer")
    return n.agg(F.count_if(F.col("n").isNull()).alias("gap"), F.count_if(F.col("b").isNull()).alias("extension"), F.count_if(F.col("n") > 1).alias("overlap"))
