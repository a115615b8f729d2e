"""Transforms of pixel and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def band_normalise(px: DataFrame, tile: list[str], column: str) -> DataFrame:
    """Min-max within each tile; a constant tile gives 0."""
    w = W.partitionBy(*tile)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return px.withColumn("norm", F.when(hi == lo, 0.0).otherwise(F.try_divide(F.col(column) - lo, hi - lo)))


def rasterize_boxes(feats: DataFrame, value: str, order: str, x0: int, y0: int, size: int) -> DataFrame:
    """Pixels whose centre a box holds; a later feature wins."""
    idx = lambda lo, hi, o: F.sequence(F.ceil((F.col(lo) - o) / size - 0.5), F.floor((F.col(hi) - o) / size - 0.5))
    some = feats.filter((F.ceil((F.col("minx") - x0) / size - 0.5) <= F.floor((F.col("maxx") - x0) / size - 0.5)) & (F.ceil((F.col("miny") - y0) / size - 0.5) <= F.floor((F.col("maxy") - y0) / size - 0.5)))
    at = some.withColumn("c", F.explode(idx("minx", "maxx", x0))).withColumn("r", F.explode(idx("miny", "maxy", y0)))
    return at.groupBy("r", "c").agg(F.max_by(value, order).alias("value"))


def bilinear(coarse: DataFrame, fine: DataFrame, factor: int) -> DataFrame:
    """Coarse values (gr, gc, v) at fine pixels (r, c); NULL neighbours drop out and the other weights are scaled up."""
    y, x = (F.col("r") + 0.5) / factor - 0.5, (F.col("c") + 0.5) / factor - 0.5
    at = fine.select("r", "c", y.alias("y"), x.alias("x")).withColumns({"gr": F.explode(F.array(F.floor("y"), F.floor("y") + 1))}).withColumn("gc", F.explode(F.array(F.floor("x"), F.floor("x") + 1)))
    w = (1 - F.abs(F.col("y") - F.col("gr"))) * (1 - F.abs(F.col("x") - F.col("gc")))
    met = at.join(coarse, ["gr", "gc"], "left").withColumn("w", F.when(F.col("v").isNotNull(), w))
    return met.groupBy("r", "c").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("value"))


def label_clean(label: Column, ndvi: Column, floor: float, canopy: int = 0) -> Column:
    """Canopy labels with a low or missing index become NULL."""
    return F.when((label == canopy) & F.coalesce(ndvi < floor, F.lit(True)), None).otherwise(label)


def mosaic(images: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Last valid pixel on top."""
    return images.filter(F.col(value).isNotNull()).groupBy("r", "c").agg(F.max_by(value, F.struct(*order)).alias(value))


def bartlett(i: Column, size: int) -> Column:
    return 1 - F.abs((i - (size - 1) / 2) / ((size + 1) / 2))


def vote_merge(preds: DataFrame) -> DataFrame:
    """(r, c, class) from (r, c, class, weight, probability): the largest weighted sum, the smallest class of equals."""
    sums = preds.groupBy("r", "c", "class").agg(F.sum(F.col("weight") * F.col("probability")).alias("score"), F.sum("weight").alias("w"))
    return sums.groupBy("r", "c").agg(F.when(F.sum("w") > 0, F.max_by("class", F.struct("score", -F.col("class")))).alias("class"))


def tile_plan(px: DataFrame, patch: int, stride: int, margin: int) -> DataFrame:
    """(top, left) of tiles with a margin around the image of pixels px, the last of a row reaching its end."""
    low = F.lit(-margin).cast("long")
    starts = lambda n: F.explode(F.sequence(low, F.greatest(low, F.col(n) + margin - patch + stride), F.lit(stride).cast("long")))
    size = px.agg((F.max("r") + 1).cast("long").alias("h"), (F.max("c") + 1).cast("long").alias("w")).filter("h is not null")
    last = lambda n, at: F.col(at) < F.greatest(low + 1, F.col(n) + margin - patch + stride)
    return size.withColumn("top", starts("h")).withColumn("left", starts("w")).filter(last("h", "top") & last("w", "left")).select("top", "left")


def spatial_split(left: Column, train_end: int, val_end: int, patch: int = 256, buffer: int = 256) -> Column:
    """train, val or test by the left edge; patches that reach into a buffer are NULL."""
    return F.when(left + patch <= train_end, "train").when((left >= train_end + buffer) & (left + patch <= val_end), "val").when(left >= val_end + buffer, "test")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n) over equal bins, the last one closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0))), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def class_weights(counts: DataFrame, n: str = "n") -> DataFrame:
    w = W.partitionBy()
    return counts.withColumn("w", F.sqrt(F.sum(n).over(w) / (F.count("*").over(w) * F.col(n))))
