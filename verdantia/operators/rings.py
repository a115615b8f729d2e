"""Polygons with parts and holes as edges, grid rows and cells.

A polygon is a row with `rings` and `holes`, both array<array<struct<x double, y double>>>; rings may repeat their first point.
Everything follows from its edges, exploded over the grid rows that they cross: crossings of a row's middle line, sorted and
paired, are the spans inside (even-odd rule, so holes and parts need no care); the cells under the edges are its boundary. A
cell off the boundary is wholly inside or outside, so exact tests are for boundary cells alone, and need the edges of
one grid row only. Nothing is exploded over a bounding box, and no polygon is sent whole to its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clip import area_within, clip_ring, holds, let
from ..functions.scalar import ring_area, ring_contains
from .grid import CELL, X0, Y0, dealt

EDGE = ("x1", "y1", "x2", "y2", "w")


def edge_array() -> Column:
    """The edges of a row's polygon as an array of (x1, y1, x2, y2, w); w turns the sum over edges of x dy into the area (1 or -1; holes count off)."""
    signed = lambda c, s: F.transform(F.coalesce(c, F.array()), lambda r: F.struct(r.alias("ring"), F.lit(float(s)).alias("s")))

    def of(part):
        ring = part["ring"]
        after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        both = F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
        ox, oy = ring[0]["x"], ring[0]["y"]
        twice = lambda q: F.aggregate(q, F.lit(0.0), lambda s, e: s + (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy))
        weighed = lambda q, w: F.transform(F.filter(q, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"])), lambda e: F.struct(*(e[c].alias(c) for c in EDGE[:4]), w.alias("w")))
        return let(both, lambda q: let(part["s"] * F.signum(twice(q)), lambda w: weighed(q, w)))

    return F.flatten(F.transform(F.filter(F.concat(signed("rings", 1), signed("holes", -1)), lambda p: F.size(p["ring"]) > 2), of))


def edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2, w): edge_array(), a row for each edge."""
    return polygons.select(key, F.explode(edge_array()).alias("e")).select(key, "e.*")


def spans(edge_rows: DataFrame, key: str | list[str], x0, y0, size: float) -> DataFrame:
    """(key, r, c0, c1): the cells c0 to c1 of grid row r whose middle the polygon holds.

    A middle on a left or lower edge is inside, on a right or upper one outside, so polygons that share an edge share no cell.
    x0 and y0 are numbers, or columns that `key` lists, where each polygon has a grid of its own.
    """
    keys = [key] if isinstance(key, str) else key
    at = lambda v, o: F.ceil((v - o) / size - 0.5)  # the first row or column whose middle is not below v
    lo, hi = at(F.least("y1", "y2"), y0), at(F.greatest("y1", "y2"), y0) - 1
    some = edge_rows.filter(lo <= hi).withColumn("r", F.explode(F.sequence(lo, hi)))
    y = y0 + (F.col("r") + 0.5) * size
    x = (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1"))) + F.col("x1")
    xs = some.groupBy(*keys, "r").agg(F.sort_array(F.collect_list(x)).alias("xs"))  # as many as edges cross the row
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs"), F.lit(2)), lambda i: F.struct(at(F.get("xs", i - 1), x0).alias("c0"), (at(F.get("xs", i), x0) - 1).alias("c1")))
    return xs.select(*keys, "r", F.explode(pairs).alias("s")).select(*keys, "r", "s.c0", "s.c1").filter("c0 <= c1")


def rasterize(polygons: DataFrame, key: str, value: str, x0: float, y0: float, size: float) -> DataFrame:
    """(r, c, value): pixels whose middle a polygon holds; of several the one with the largest key wins."""
    named = polygons.filter(F.col(key).isNotNull()).select(key, "rings", "holes")
    inside = spans(edges(named, key), key, x0, y0, size).join(polygons.select(key, value), key)
    return inside.select(key, value, "r", F.explode(F.sequence("c0", "c1")).alias("c")).groupBy("r", "c").agg(F.max_by(value, key).alias("value"))


def under_edges(edge_rows: DataFrame, size: float, x0: float, y0: float) -> DataFrame:
    """edge_rows with each grid row cy that an edge touches, and the part (xa, xb) of its x there."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edge_rows.withColumn("cy", F.explode(F.sequence(F.ceil((lo - y0) / size) - 1, F.floor((hi - y0) / size))))
    bottom = F.lit(y0) + F.col("cy") * size
    x_at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * F.least(F.greatest((y - F.col("y1")) / (F.col("y2") - F.col("y1")), F.lit(0.0)), F.lit(1.0))
    flat = F.col("y1") == F.col("y2")
    a, b = F.when(flat, F.col("x1")).otherwise(x_at(bottom)), F.when(flat, F.col("x2")).otherwise(x_at(bottom + size))
    return rows.withColumns({"xa": F.least(a, b), "xb": F.greatest(a, b)})


def cover(polygons: DataFrame, key: str, size: float = CELL, x0: float = X0, y0: float = Y0) -> DataFrame:
    """(key, cx, cy, edges): the cells that a polygon touches, within the cells of its bounding box.

    edges is NULL for a cell wholly inside, else an array of the edges that touch the cell's grid row.
    """
    each = edges(polygons, key)
    there = under_edges(each, size, x0, y0)
    cx = F.explode(F.sequence(F.ceil((F.col("xa") - x0) / size) - 1, F.floor((F.col("xb") - x0) / size)))
    rim = there.select(key, "cy", cx.alias("cx"), F.lit(True).alias("rim"))
    fill = spans(each, key, x0, y0, size).select(key, F.col("r").alias("cy"), F.explode(F.sequence("c0", "c1")).alias("cx"), F.lit(False).alias("rim"))
    cells = rim.unionByName(fill).groupBy(key, "cx", "cy").agg(F.max("rim").alias("rim"))
    strips = there.groupBy(key, "cy").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    lowest = lambda c, o: F.floor((F.min(F.least(f"{c}1", f"{c}2")) - o) / size)
    ends = each.groupBy(key).agg(lowest("x", x0).alias("cx0"), lowest("y", y0).alias("cy0"))
    met = cells.join(strips, [key, "cy"], "left").join(ends, key).filter((F.col("cx") >= F.col("cx0")) & (F.col("cy") >= F.col("cy0")))
    return met.select(key, "cx", "cy", F.when(F.col("rim"), F.col("edges")).alias("edges"))


def pixel_counts(pixels: DataFrame, counts: list[str], polygons: DataFrame, key: str, x0: float, y0: float, size: float, width: int = 256) -> DataFrame:
    """(key, counts): sums of the counts of those pixels (r, c) whose middle a polygon holds; polygons that hold none have no row.

    Counts are summed up along each row of pixels, within strips of `width`. A span inside a polygon is a difference of two of
    these sums for each strip that it meets, however many pixels it has, so polygons and pixels never meet one by one.
    """
    strip = lambda c: F.floor(F.col(c) / width)
    some = pixels.select("r", strip("c").alias("s"), F.pmod("c", F.lit(width)).cast("int").alias("i"), *counts)
    every = some.select("r", "s").distinct().select("r", "s", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"), *(F.lit(0).alias(c) for c in counts))
    along = W.partitionBy("r", "s").orderBy("i")
    run = some.unionByName(every).groupBy("r", "s", "i").agg(*(F.sum(c).alias(c) for c in counts)).select("r", "s", "i", *(F.sum(c).over(along).alias(c) for c in counts))
    strips = run.groupBy("r", "s").agg(F.sort_array(F.collect_list(F.struct("i", *counts))).alias("run"))
    met = spans(edges(dealt(polygons, key), key), key, x0, y0, size).withColumn("s", F.explode(F.sequence(strip("c0"), strip("c1"))))
    # the strips are the side that is hashed: spans are many more than their estimated size tells, and would be broadcast
    met = met.join(strips.hint("shuffle_hash"), ["r", "s"])
    first, last = (F.col("c0") - F.col("s") * width).cast("int"), F.least(F.col("c1") - F.col("s") * width, F.lit(width - 1)).cast("int")
    upto = lambda c, i: F.when(i >= 0, F.get("run", i)[c]).otherwise(0)
    return met.groupBy(key).agg(*(F.sum(upto(c, last) - upto(c, first - 1)).alias(c) for c in counts))


def points_in(points: DataFrame, polygons: DataFrame, key: str, size: float = CELL, x0: float = X0, y0: float = Y0) -> DataFrame:
    """points (x, y) with the key of each polygon that holds them; points meet cells once, and only boundary cells are tested."""
    at = points.withColumns({"cx": F.floor((F.col("x") - x0) / size), "cy": F.floor((F.col("y") - y0) / size)})
    both = at.join(cover(polygons, key, size, x0, y0), ["cx", "cy"])
    return both.filter(F.col("edges").isNull() | holds("edges", F.col("x"), F.col("y"))).drop("cx", "cy", "edges")


def overlaps(boxes: DataFrame, box_key: str, polygons: DataFrame, key: str, size: float = CELL, x0: float = X0, y0: float = Y0) -> DataFrame:
    """(box_key, key, area) of boxes and the polygons that share area with them: sums over the cells that both touch."""
    cell = lambda v, o: F.floor((F.col(v) - o) / size)
    at = boxes.select(box_key, *(F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy"))).filter("minx < maxx and miny < maxy")
    at = at.withColumn("cx", F.explode(F.sequence(cell("minx", x0), cell("maxx", x0)))).withColumn("cy", F.explode(F.sequence(cell("miny", y0), cell("maxy", y0))))
    left, low = F.lit(float(x0)) + F.col("cx") * size, F.lit(float(y0)) + F.col("cy") * size
    own = {"minx": F.greatest("minx", left), "miny": F.greatest("miny", low), "maxx": F.least("maxx", left + size), "maxy": F.least("maxy", low + size)}
    both = at.withColumns(own).filter("minx < maxx and miny < maxy").join(cover(polygons, key, size, x0, y0), ["cx", "cy"])
    corner = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    area = F.when(F.col("edges").isNull(), (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).otherwise(area_within("edges", *corner))
    return both.groupBy(box_key, key).agg(F.sum(area).alias("area")).filter("area > 1e-9")


def areas(polygons: DataFrame, key: str) -> DataFrame:
    """(key, area)"""
    e = edges(polygons, key)
    ends = e.groupBy(key).agg(F.min("x1").alias("ox"))
    term = F.col("w") * (F.col("y2") - F.col("y1")) * ((F.col("x1") + F.col("x2")) / 2 - F.col("ox"))
    return e.join(ends, key).groupBy(key).agg(F.sum(term).alias("area"))


def boxes(polygons: DataFrame, key: str) -> DataFrame:
    """(key, minx, miny, maxx, maxy)"""
    ends = {f"{f.__name__}{c}": f(g(f"{c}1", f"{c}2")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))}
    return edges(polygons, key).groupBy(key).agg(*(e.alias(n) for n, e in ends.items()))


def lattice(polygons: DataFrame, key: str, spacing: float) -> DataFrame:
    """(key, x, y): points inside each polygon, `spacing` apart, from its lower left corner plus half of that.

    A polygon without any, but of a quarter of spacing * spacing at least, gets the middle of the widest span at half its height.
    Boxes and areas come from a row's own edges, so polygons are shuffled once, by their grid rows.
    """
    along = lambda c, of: F.transform("es", lambda e: of(e[f"{c}1"], e[f"{c}2"]))
    ends = {f"min{c}": F.array_min(along(c, F.least)) for c in "xy"} | {f"max{c}": F.array_max(along(c, F.greatest)) for c in "xy"}
    once = lambda c: F.explode(F.array(c))  # computed once a row: no later filter takes its expression apart
    own = dealt(polygons, key).select(key, once(edge_array()).alias("es")).filter(F.size("es") > 0)
    own = own.select(key, "es", once(F.struct(*(e.alias(n) for n, e in ends.items()))).alias("b")).select(key, "es", "b.*")
    each = own.select(key, "minx", "miny", F.explode("es").alias("e")).select(key, "minx", "miny", "e.*")
    rows = spans(each, [key, "minx", "miny"], F.col("minx"), F.col("miny"), spacing)
    points = rows.withColumn("c", F.explode(F.sequence("c0", "c1")))
    points = points.select(key, (F.col("minx") + (F.col("c") + 0.5) * spacing).alias("x"), (F.col("miny") + (F.col("r") + 0.5) * spacing).alias("y"))
    area = F.aggregate("es", F.lit(0.0), lambda s, e: s + e["w"] * (e["y2"] - e["y1"]) * ((e["x1"] + e["x2"]) / 2 - F.col("minx")))
    # the middle span of each polygon, which counts where no row has a span
    y = (F.col("miny") + F.col("maxy")) / 2
    cut = F.filter("es", lambda e: (e["y1"] > F.col("y")) != (e["y2"] > F.col("y")))
    xs = F.sort_array(F.transform(cut, lambda e: (e["x2"] - e["x1"]) * ((F.col("y") - e["y1"]) / (e["y2"] - e["y1"])) + e["x1"]))
    wide = F.array_max(F.transform(F.sequence(F.lit(1), F.size("xs"), F.lit(2)), lambda i: F.struct((F.get("xs", i) - F.get("xs", i - 1)).alias("wide"), ((F.get("xs", i) + F.get("xs", i - 1)) / 2).alias("x"))))
    large = own.filter(area >= spacing * spacing / 4).select(key, "es", once(y).alias("y")).select(key, "y", once(xs).alias("xs"))
    middle = large.filter(F.size("xs") > 0).select(key, wide["x"].alias("x"), "y", F.lit(False).alias("held"))
    held = rows.select(key, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("held"))
    alone = middle.unionByName(held).groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("held").alias("held")).filter("not held").drop("held")
    return points.unionByName(alone)


def sized(ring: Column) -> Column:
    """The area of a ring, whichever way it runs, about its first point."""
    return let(ring, lambda q: F.when(F.size(q) < 3, 0.0).otherwise(F.abs(ring_area(F.transform(q, lambda p: F.struct((p["x"] - q[0]["x"]).alias("x"), (p["y"] - q[0]["y"]).alias("y")))))))


def clip(polygons: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """polygons with the parts of their rings and holes within a box; those that have none are dropped."""
    side = [F.lit(float(v)) for v in (minx, miny, maxx, maxy)]
    within = lambda c: F.filter(F.transform(F.coalesce(c, F.array()), lambda r: clip_ring(r, *side)), lambda r: sized(r) > 0)
    return polygons.withColumns({"rings": within("rings"), "holes": within("holes")}).filter(F.size("rings") > 0)


def parts(polygons: DataFrame, key: str) -> DataFrame:
    """(key, part, part_id, rings, holes): a row for each outer ring, from 0, with the holes in it; empty rings are dropped.

    Of rings within one another, a hole belongs to the smallest that holds its first point.
    """
    some = polygons.withColumns({"rings": F.filter("rings", lambda r: sized(r) > 0), "holes": F.filter(F.coalesce("holes", F.array()), lambda r: sized(r) > 0)})
    held = lambda h: F.filter(F.transform("rings", lambda r, i: F.when(ring_contains(r, h[0]["x"], h[0]["y"]), F.struct(sized(r).alias("area"), i.alias("i")))), lambda s: s.isNotNull())
    owned = F.transform("holes", lambda h: F.struct(F.array_min(held(h))["i"].alias("i"), h.alias("hole")))
    each = some.withColumn("owned", owned).select(key, "owned", F.posexplode("rings").alias("part", "ring"))
    mine = F.transform(F.filter("owned", lambda o: o["i"] == F.col("part")), lambda o: o["hole"])
    return each.select(key, F.col("part").cast("long").alias("part"), F.concat_ws("_", F.col(key).cast("string"), F.col("part").cast("string")).alias("part_id"), F.array("ring").alias("rings"), mine.alias("holes"))
