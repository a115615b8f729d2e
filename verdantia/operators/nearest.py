"""Distance to the nearest segment, by a pyramid of occupied cells.

A cell that a segment touches is occupied; four by four cells make one of the next level, up to a level of few cells. From there
down, each cell of points keeps the occupied cells that may hold its nearest segment: those no further away, at best, than
another is at worst. So a point far off everything meets a few cells of each level, however many segments there are, and
only the segments of the last ones are measured. Cells shrink as segments get denser, down to their mean length. Equal segments
are one, and equal points are measured once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import written
from .grid import CELL, X0, Y0
from .rings import under_edges

#: Cells along a side of the topmost level, at most; every cell of points is held against all of them. And the step between levels.
TOP_SIDE, STEP = 8, 4


def segment_distance(x, y, p: str = ""):
    """Distance from a point to the segment (x1, y1)-(x2, y2)."""
    x1, y1, x2, y2 = (F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def candidates(places: DataFrame, occupied: DataFrame, size: float) -> DataFrame:
    """(px, py, cx, cy): for each cell of points, the occupied cells of the lowest level that may hold its nearest segment."""
    ends = occupied.agg(*(f(c) for c in ("cx", "cy") for f in (F.min, F.max))).first()
    levels = [occupied]
    while any(hi // STEP ** (len(levels) - 1) - lo // STEP ** (len(levels) - 1) >= TOP_SIDE for lo, hi in (ends[:2], ends[2:])):
        levels.append(levels[-1].select(*(F.floor(F.col(c) / STEP).alias(c) for c in ("cx", "cy"))).distinct())
    near = places.crossJoin(F.broadcast(levels[-1]))  # TOP_SIDE * TOP_SIDE cells at most
    for level in range(len(levels) - 1, -1, -1):
        wide = size * STEP**level
        if level < len(levels) - 1:
            below = levels[level].select("cx", "cy", F.floor(F.col("cx") / STEP).alias("ux"), F.floor(F.col("cy") / STEP).alias("uy"))
            near = near.withColumnsRenamed({"cx": "ux", "cy": "uy"}).join(below, ["ux", "uy"]).select("px", "py", "cx", "cy")
        side = lambda p, c: (F.col(p) * size, (F.col(p) + 1) * size, F.col(c) * wide, (F.col(c) + 1) * wide)  # noqa: B023, E731
        gap, far = [], []
        for p, c in (("px", "cx"), ("py", "cy")):
            a, b, lo, hi = side(p, c)
            gap.append(F.greatest(lo - b, a - hi, F.lit(0.0)))
            far.append(F.greatest(hi - a, b - lo))
        near = near.withColumns({"best": F.hypot(*gap), "worst": F.hypot(*far)})
        near = near.withColumn("worst", F.min("worst").over(W.partitionBy("px", "py"))).filter("best <= worst").select("px", "py", "cx", "cy")
    return near


def fine(lines: DataFrame, size: float) -> float:
    """`size` halved as often as cells keep the mean length of a segment, and room for one segment each, were they spread evenly."""
    ends = [f(g(f"{c}1", f"{c}2")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))]
    n, long, x0, x1, y0, y1 = lines.agg(F.count("*"), F.avg(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))), *ends).first()
    least = max(long or 0.0, math.sqrt((x1 - x0) * (y1 - y0) / n)) if n else size
    return size / 2 ** max(0, math.floor(math.log2(size / max(least, size / 1024)))) if math.isfinite(least) else size


def nearest_distance(points: DataFrame, lines: DataFrame, key: str, size: float = CELL) -> DataFrame:
    """(key, distance) to the nearest segment; -1 if there is none, NULL for a point without coordinates."""
    lines = written(lines.select(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).dropna().distinct())
    size = fine(lines, size)
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    at = written(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    touched = under_edges(lines, size, X0, Y0)
    cells = written(touched.select("x1", "y1", "x2", "y2", F.explode(F.sequence(F.ceil((F.col("xa") - X0) / size) - 1, F.floor((F.col("xb") - X0) / size))).alias("cx"), "cy"))
    occupied = cells.select("cx", "cy").distinct()
    nowhere = at.filter(~there).select(key, F.lit(None).cast("double").alias("distance"))
    if cells.isEmpty():
        return nowhere.unionByName(at.filter(there).select(key, F.lit(-1.0).alias("distance")))
    spots = at.filter(there).select("x", "y").distinct()
    placed = written(spots.withColumns({"px": F.floor((F.col("x") - X0) / size), "py": F.floor((F.col("y") - Y0) / size)}))
    near = candidates(placed.select("px", "py").distinct(), occupied, size)
    met = placed.join(near, ["px", "py"]).join(cells, ["cx", "cy"])
    found = written(met.groupBy("x", "y").agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("distance")))
    return nowhere.unionByName(at.filter(there).join(found, ["x", "y"]).select(key, "distance"))
