"""Zonal, temporal and summary aggregates: one grouped pass each, partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def zonal_fraction(px: DataFrame, zone: str, hit: Column, valid: Column) -> DataFrame:
    """(zone, frac, hits, valid, completeness): completeness is valid pixels to all of the zone's."""
    g = px.groupBy(zone).agg(F.count_if(hit & valid).alias("hits"), F.count_if(valid).alias("valid"), F.count("*").alias("pixels"))
    return g.select(zone, F.try_divide("hits", "valid").alias("frac"), "hits", "valid", F.try_divide("valid", "pixels").alias("completeness"))


def zonal_union(px: DataFrame, zone: str) -> DataFrame:
    """Five counts over the impervious layers, the union's fraction, and whether it holds each source."""
    one = {c: F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("seg", "bldg", "road")}
    any_ = one["seg"] | one["bldg"] | one["road"]
    valid = F.col("seg").isNotNull() | F.col("bldg").isNotNull() | F.col("road").isNotNull()
    g = px.groupBy(zone).agg(*(F.count_if(x).alias(f"n_{c}") for c, x in one.items()), F.count_if(any_).alias("n_union"), F.count_if(valid).alias("n_valid"))
    return g.withColumns({"frac": F.try_divide("n_union", "n_valid"), "holds": F.col("n_union") >= F.greatest("n_seg", "n_bldg", "n_road")})


def zonal_mean(px: DataFrame, zone: str, column: str) -> DataFrame:
    g = px.groupBy(zone).agg(F.avg(column).alias("mean"), F.count(column).alias("valid"), F.count("*").alias("pixels"))
    return g.select(zone, "mean", "valid", F.try_divide("valid", "pixels").alias("completeness"))


def temporal_median(scenes: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Per pixel over scenes; approximate bounds the state of a pixel with very many scenes."""
    return scenes.groupBy("r", "c").agg((F.approx_percentile(column, 0.5) if approximate else F.median(column)).alias("median"))


def temporal_mode(scenes: DataFrame, column: str) -> DataFrame:
    """The most common class of each pixel, the smallest of equals."""
    n = scenes.filter(F.col(column).isNotNull()).groupBy("r", "c", column).count()
    return n.groupBy("r", "c").agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("mode"))


def seasonal_strict(scenes: DataFrame, keys: list[str], column: str, months: tuple = (1, 2, 3)) -> DataFrame:
    """Mean of the monthly means; NULL unless every month is there."""
    m = scenes.filter(F.col("mon").isin(*months) & F.col(column).isNotNull()).groupBy(*keys, "mon").agg(F.avg(column).alias("m"))
    return m.groupBy(*keys).agg(F.when(F.count("*") == len(months), F.avg("m")).alias("mean"), F.count("*").alias("months"))


def class_balance(px: DataFrame, column: str) -> DataFrame:
    n = px.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def patches(px: DataFrame, size: int, stride: int) -> DataFrame:
    """px with every patch (top, left), on a grid of `stride`, that holds the pixel."""
    at = lambda c: F.explode(F.sequence(F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)), F.floor(F.col(c) / stride)))
    return px.withColumn("top", at("r")).withColumn("left", at("c")).withColumns({"top": F.col("top") * stride, "left": F.col("left") * stride})


def patch_nodata(px: DataFrame, column: str, size: int, stride: int, most: float = 0.3) -> DataFrame:
    g = patches(px, size, stride).groupBy("top", "left").agg(F.avg(F.col(column).isNull().cast("int")).alias("nodata"), F.count("*").alias("n"))
    return g.filter(F.col("nodata") <= most)


def crosswalk(px: DataFrame, a: str, b: str) -> DataFrame:
    n = px.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    return percent_of_total(n, a)


def percent_of_total(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """counts with their share of the total and of their key, in percent; windows run over the counts."""
    return counts.withColumns({"pct_all": 100.0 * F.col(n) / F.sum(n).over(W.partitionBy()), "pct_row": 100.0 * F.col(n) / F.sum(n).over(W.partitionBy(key))})


def study_area(pairs: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """Per area: block counts, counts by risk, eligible and scored area, area-weighted score to four places.

    Areas are whole square metres, as those of boxes are, or, if exact, to four places.
    """
    s = F.col("score")
    shown = lambda x: F.round(x, 4) if exact else x.cast("long")
    named = {"critical": s < 25, "high": (s >= 25) & (s < 50), "moderate": (s >= 50) & (s < 75), "low": s >= 75}
    return pairs.groupBy(key).agg(
        F.count("*").alias("blocks"), F.count(s).alias("scored"), *(F.count_if(x).alias(n) for n, x in named.items()), shown(F.sum("area")).alias("eligible_m2"), shown(F.sum(F.when(s.isNotNull(), F.col("area")))).alias("scored_m2"),
        F.round(F.try_divide(F.sum(s * F.col("area")), F.sum(F.when(s.isNotNull(), F.col("area")))), 4).alias("weighted_score"),
    )


def counts_map(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, name): a map from value to count."""
    n = df.groupBy(*keys, column).count()
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name))


def dissolve(cells: DataFrame, order: str, version: str) -> DataFrame:
    """One row: distinct cells of all features and the first one's version."""
    one = cells.agg(F.min_by(version, order).alias("version"))
    return cells.select("cx", "cy").distinct().agg(F.count("*").alias("cells")).crossJoin(one)  # two single rows
