"""Spatial joins as equi-joins on covering cells.

A box or ring covers a set of square cells; both sides meet on the cell and an exact expression decides. A pair that
meets in several cells counts where the pair's own first common cell is, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import written
from . import rings
from .grid import CELL, X0, Y0, dealt
from .nearest import nearest_distance, segment_distance  # noqa: F401


def cell(x: Column, origin: int, size: int) -> Column:
    return F.floor((x - origin) / size)


def cover(df: DataFrame, size: int = CELL, grow: float = 0) -> DataFrame:
    """df with a row for each cell (cx, cy) that its box, grown by `grow`, touches."""
    span = lambda lo, hi, o: F.sequence(cell(F.col(lo) - grow, o, size), cell(F.col(hi) + grow, o, size))
    return df.withColumn("cx", F.explode(span("minx", "maxx", X0))).withColumn("cy", F.explode(span("miny", "maxy", Y0)))


def cell_counts(boxes: DataFrame, keys: list[str], size: int = CELL) -> DataFrame:
    """(keys, cx, cy, n): how many boxes of each combination of keys touch each cell; boxes over the same cells are made cells once."""
    ends = {f"{c}{i}": cell(F.col(f"{e}{c}"), o, size) for c, o in (("x", X0), ("y", Y0)) for i, e in enumerate(("min", "max"))}
    ranges = boxes.select(*keys, *(e.alias(n) for n, e in ends.items())).groupBy(*keys, *ends).agg(F.count("*").alias("m"))
    cells = dealt(ranges, *ends).withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    return cells.groupBy(*keys, "cx", "cy").agg(F.sum("m").alias("n"))


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}maxx") - F.col(f"{p}minx")) * (F.col(f"{p}maxy") - F.col(f"{p}miny"))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) if c not in ("cx", "cy") else F.col(c) for c in df.columns))


def overlaps(a: DataFrame, b: DataFrame, touch: bool = False, size: int = CELL) -> DataFrame:
    """Pairs of boxes with the exact area they share; columns prefixed a_ and b_."""
    both = prefixed(cover(a, size), "a_").join(prefixed(cover(b, size), "b_"), ["cx", "cy"])
    lox, loy = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
    w, h = F.least("a_maxx", "b_maxx") - lox, F.least("a_maxy", "b_maxy") - loy
    first = (F.col("cx") == cell(lox, X0, size)) & (F.col("cy") == cell(loy, Y0, size))
    hit = (w >= 0) & (h >= 0) if touch else (w > 0) & (h > 0)
    return both.filter(first & hit).withColumn("area", w * h).drop("cx", "cy")


#: Rivals that first_overlap looks at in its first round, and how many times as many in each of the next.
FIRST, TIMES = 1000, 4


def first_overlap(a: DataFrame, key: str, b: DataFrame, order: str, values: list[str], size: int = CELL) -> DataFrame:
    """(key, order, values): for each box of a, the box of b with the smallest number `order` that it shares area with, if any.

    Boxes of b come in rounds, the smallest numbers first, each round four times as many; what has found one is done. So
    where boxes are crowded, most are done after few of b, and where they are not, the rounds cost no more than one join of all.
    Equal boxes meet once: of b the first one stands for all.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    rivals = written(b.filter(F.col(order).isNotNull()).groupBy(*box).agg(F.min(F.struct(order, *values)).alias("v")).select(*box, "v"))
    left = written(a.select(*box).distinct())
    ends, n = [], rivals.count()
    ranks = [FIRST * (TIMES ** (i + 1) - 1) // (TIMES - 1) for i in range(40)]
    shares = [r / n for r in ranks if r < n]
    if shares:  # how many come in a round need not be exact
        ends = sorted(set(rivals.agg(F.percentile_approx(f"v.{order}", F.array(*map(F.lit, shares)), F.lit(10_000))).first()[0]))
    done = []
    for low, high in zip([None, *ends], [*ends, None]):
        some = rivals
        some = some if low is None else some.filter(F.col(f"v.{order}") > low)
        some = some if high is None else some.filter(F.col(f"v.{order}") <= high)
        mine, other = prefixed(cover(dealt(left, *box), size), "a_"), prefixed(cover(dealt(some, *box), size), "b_")
        lox, loy = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
        hit = (F.least("a_maxx", "b_maxx") > lox) & (F.least("a_maxy", "b_maxy") > loy)
        pairs = mine.join(other.hint("merge"), ["cx", "cy"]).filter(hit)
        met = written(pairs.groupBy(*(F.col(f"a_{c}").alias(c) for c in box)).agg(F.min("b_v").alias("v")))
        done.append(met)
        if high is not None:
            left = written(left.join(met.select(*box).hint("merge"), box, "left_anti"))
            if left.isEmpty():
                break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return a.select(key, *box).join(found.hint("merge"), box).select(key, "v.*")


def points_in(points: DataFrame, boxes: DataFrame, strict: bool = False, size: int = CELL) -> DataFrame:
    """Points (x, y) with the boxes that hold them; box columns prefixed b_."""
    at = points.withColumns({"cx": cell(F.col("x"), X0, size), "cy": cell(F.col("y"), Y0, size)})
    both = at.join(prefixed(cover(boxes, size), "b_"), ["cx", "cy"]).drop("cx", "cy")
    x, y = F.col("x"), F.col("y")
    if strict:
        return both.filter((x > F.col("b_minx")) & (x < F.col("b_maxx")) & (y > F.col("b_miny")) & (y < F.col("b_maxy")))
    return both.filter(x.between(F.col("b_minx"), F.col("b_maxx")) & y.between(F.col("b_miny"), F.col("b_maxy")))


def points_in_rings(points: DataFrame, polygons: DataFrame, key: str = "ward_id", size: int = CELL) -> DataFrame:
    """Points (x, y) with the polygons that hold them, named b_<key>."""
    return rings.points_in(points, polygons, key, size).withColumnRenamed(key, f"b_{key}")


def ring_overlaps(boxes: DataFrame, box_key: str, polygons: DataFrame, key: str, size: int = CELL) -> DataFrame:
    """(a_<box_key>, b_<key>, area) of boxes and the polygons that share area with them; holes count off."""
    return rings.overlaps(boxes, box_key, polygons, key, size).withColumnsRenamed({box_key: f"a_{box_key}", key: f"b_{key}"})


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def segment_boxes(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"minx": F.least("x1", "x2"), "miny": F.least("y1", "y2"), "maxx": F.greatest("x1", "x2"), "maxy": F.greatest("y1", "y2")})


def within_buffer(points: DataFrame, lines: DataFrame, distance: float, key: str, size: int = CELL) -> DataFrame:
    """Points no further than distance from some segment; equal points and equal segments meet once."""
    spots = points.select("x", "y").distinct().withColumns({"cx": cell(F.col("x"), X0, size), "cy": cell(F.col("y"), Y0, size)})
    own = segment_boxes(lines.select("x1", "y1", "x2", "y2").distinct())
    near = spots.join(prefixed(cover(own, size, distance), "b_").hint("merge"), ["cx", "cy"])  # cells are more than their estimated size tells
    hit = near.filter(segment_distance(F.col("x"), F.col("y"), "b_") <= distance)
    return points.join(hit.select("x", "y").distinct().hint("merge"), ["x", "y"], "left_semi").select(*points.columns)


def distance_pairs(points: DataFrame, key: str, r: float) -> DataFrame:
    """(i, j, distance) with i < j of all points closer than r: cells of side r, each point offered to its nine neighbours."""
    at = points.select(F.col(key).alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"), F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy"))
    offer = points.select(F.col(key).alias("i"), F.col("x").alias("ix"), F.col("y").alias("iy"))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / r) - 1, F.floor(F.col(c) / r) + 1))
    offer = offer.withColumn("cx", around("ix")).withColumn("cy", around("iy"))
    pairs = offer.join(at, ["cx", "cy"]).filter("i < j").withColumn("distance", F.hypot(F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy")))
    return pairs.filter(F.col("distance") < r).select("i", "j", "distance")


def touched_blocks(pixels: DataFrame, size: int = CELL) -> DataFrame:
    """Pixel boxes with every block they touch; a pixel on an edge stands in several."""
    return cover(pixels, size).withColumn("block_id", block_name(F.col("cy"), F.col("cx"))).drop("cx", "cy")


def block_name(bi: Column, bj: Column) -> Column:
    return F.concat(F.lit("PN_"), bi.cast("string"), F.lit("_"), bj.cast("string"))


def ward_assign(blocks: DataFrame, wards: DataFrame, gap_share: float = 0.01, least: float = 1e-4) -> DataFrame:
    """(block_id, ward_id, status): largest overlap; ambiguous if the second is within gap_share of the block's area.

    Wards are boxes, or polygons where they have rings and holes.
    """
    if "rings" in wards.columns:
        over = ring_overlaps(blocks, "block_id", wards, "ward_id")
    else:
        over = overlaps(blocks.select("block_id", "minx", "miny", "maxx", "maxy"), wards.select("ward_id", "minx", "miny", "maxx", "maxy"))
    rank = F.row_number().over(W.partitionBy("a_block_id").orderBy(F.desc("area"), "b_ward_id"))
    top = over.withColumn("rank", rank).filter("rank <= 2").groupBy(F.col("a_block_id").alias("block_id")).agg(
        F.max(F.when(F.col("rank") == 1, F.col("area"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("area"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("b_ward_id"))).alias("ward"),
    )
    made = blocks.withColumn("block_area", box_area()).join(top, "block_id", "left")
    status = F.when(F.coalesce("best", F.lit(0.0)) <= least, "no_overlap").when(F.col("best") - F.coalesce("second", F.lit(0.0)) <= gap_share * F.col("block_area"), "ambiguous_overlap").otherwise("assigned")
    return made.withColumn("status", status).select("block_id", F.when(F.col("status") == "assigned", F.col("ward")).alias("ward_id"), "status")


def area_weighted(cells: DataFrame, blocks: DataFrame, value: str, key: str, boundary: tuple | DataFrame | None = None) -> DataFrame:
    """Spread a value over blocks by the share of the source cell's own area, clipped to a boundary.

    The boundary is a box, or a table of polygons (rings, holes and a key of their own) that don't overlap.
    """
    src = cells.withColumn("src_area", box_area())
    if isinstance(boundary, DataFrame):
        pairs = overlaps(src, blocks.select("block_id", "minx", "miny", "maxx", "maxy"))
        ends = {c: f(f"a_{c}", f"b_{c}") for c, f in (("minx", F.greatest), ("miny", F.greatest), ("maxx", F.least), ("maxy", F.least))}
        pairs = pairs.select(F.struct(f"a_{key}", "b_block_id").alias("pair"), F.col(f"a_{value}").alias("value"), "a_src_area", *(c.alias(n) for n, c in ends.items()))
        edge = next(c for c in boundary.columns if c not in ("rings", "holes"))
        shared = rings.overlaps(pairs, "pair", boundary, edge).groupBy("pair").agg(F.sum("area").alias("area"))
        met = pairs.select("pair", "value", "a_src_area").join(shared, "pair")
        return met.groupBy(F.col("pair.b_block_id").alias("block_id")).agg(
            F.sum(F.col("value") * F.col("area") / F.col("a_src_area")).alias("value"), F.count_distinct(f"pair.a_{key}").alias("cells"), F.sum("area").alias("area"),
        )
    if boundary:
        x0, y0, x1, y1 = boundary
        src = src.withColumns({"minx": F.greatest("minx", F.lit(x0)), "miny": F.greatest("miny", F.lit(y0)), "maxx": F.least("maxx", F.lit(x1)), "maxy": F.least("maxy", F.lit(y1))}).filter("minx < maxx and miny < maxy")
    over = overlaps(src, blocks.select("block_id", "minx", "miny", "maxx", "maxy"))
    return over.groupBy(F.col("b_block_id").alias("block_id")).agg(
        F.sum(F.col(f"a_{value}") * F.col("area") / F.col("a_src_area")).alias("value"), F.count_distinct(f"a_{key}").alias("cells"), F.sum("area").alias("area"),
    )
