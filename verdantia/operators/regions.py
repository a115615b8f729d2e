"""Connected regions of equal class, their areas and outlines.

A tile's pixels are labelled in one task, which holds TILE x TILE of them at most; then only labels that meet across tile
borders form a graph, and its components are found by stars, in rounds that grow with the logarithm of the number of labels.
So a region's length costs nothing, and no region meets in one task. Adjacent pixels are in one region exactly if they are
of one class, so outlines come from tiles with a border of one pixel around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import written

TILE = 256


def tile_labels(tile: int):
    """Adds, to the pixels of a tile, the smallest pixel (lr, lc) of each one's region within the tile."""

    def run(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        kind = table.column("class").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        low_r, low_c = r // tile * tile, c // tile * tile
        at = (r - low_r) * tile + (c - low_c)
        grid = np.full(tile * tile, -1, np.int64)
        grid[at] = kind
        square = grid.reshape(tile, tile)
        ids = np.arange(tile * tile).reshape(tile, tile)
        side, up = (square[:, :-1] == square[:, 1:]) & (square[:, 1:] >= 0), (square[:-1] == square[1:]) & (square[1:] >= 0)
        a = np.concatenate([ids[:, :-1][side], ids[:-1][up]])
        b = np.concatenate([ids[:, 1:][side], ids[1:][up]])
        label = np.arange(tile * tile)
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, label[label]):
                label = label[label]
        own = label[at]
        return table.select(["r", "c", "class"]).append_column("lr", pa.array(low_r + own // tile)).append_column("lc", pa.array(low_c + own % tile))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): the smallest node that it is connected with.

    Large and small stars in turn: every node's larger, then its smaller neighbours are tied to its smallest one, until
    each component is one star. Nodes of any comparable type; null ones are left out.
    """
    have = written(edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = have.unionByName(have.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        made = written(small.distinct())
        if made.count() == have.count() and made.join(have, ["u", "v"], "left_anti").isEmpty():
            break
        have = made
    return have.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(have.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def label(px: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """(r, c, column, region): region is the struct (r, c) of the region's smallest pixel; pixels without a class are left out."""
    kind = px.schema[column].dataType.simpleString()
    cells = px.filter(F.col(column).isNotNull()).select(F.col("r").cast("long"), F.col("c").cast("long"), F.col(column).alias("class"))
    dealt = cells.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    local = written(dealt.groupBy("tr", "tc").applyInArrow(tile_labels(tile), f"r long, c long, class {kind}, lr long, lc long"))
    name = F.struct(F.col("lr").alias("r"), F.col("lc").alias("c"))
    met = []
    for along, across in (("r", "c"), ("c", "r")):
        last = local.filter(F.pmod(across, F.lit(tile)) == tile - 1).select(along, (F.col(across) + 1).alias(across), "class", name.alias("u"))
        first = local.filter(F.pmod(across, F.lit(tile)) == 0).select(along, across, "class", name.alias("v"))
        met.append(last.join(first, ["r", "c", "class"]).select("u", "v"))
    roots = components(met[0].unionByName(met[1]))
    found = local.withColumn("node", name).join(roots, "node", "left")
    return found.select("r", "c", F.col("class").alias(column), F.coalesce("root", "node").alias("region"))


def tile_sides(tile: int):
    """Straight sides (region, x1, y1, x2, y2) of the regions of a tile, in pixels, each region on the left; rows outside it are its border."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * tile, key[1].as_py() * tile
        r, c = table.column("r").to_numpy() - r0 + 1, table.column("c").to_numpy() - c0 + 1
        kind = table.column("class").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        grid = np.full((tile + 2, tile + 2), -1, np.int64)
        grid[r, c] = kind
        name = np.full((tile + 2, tile + 2), -1, np.int64)
        region, regions = table.column("region").combine_chunks(), None
        pair = np.stack([region.field("r").to_numpy(zero_copy_only=False), region.field("c").to_numpy(zero_copy_only=False)], axis=1)
        regions, code = np.unique(pair, axis=0, return_inverse=True)
        name[r, c] = code.ravel()
        inner, own = grid[1:-1, 1:-1], name[1:-1, 1:-1]
        out = []
        for beside, way in ((grid[:-2, 1:-1], "south"), (grid[2:, 1:-1], "north"), (grid[1:-1, :-2], "west"), (grid[1:-1, 2:], "east")):
            edge = (inner >= 0) & (inner != beside)
            flat = way in ("south", "north")
            line, step = np.nonzero(edge if flat else edge.T)  # sorted along each line
            who = (own if flat else own.T)[line, step]
            new = np.append(True, (line[1:] != line[:-1]) | (step[1:] != step[:-1] + 1) | (who[1:] != who[:-1]))[: len(line)]
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(line))[: len(lo)] - 1
            a, b, at = step[lo], step[hi] + 1, line[lo] + (way in ("north", "east"))
            if way in ("north", "west"):
                a, b = b, a
            x1, y1, x2, y2 = (a, at, b, at) if flat else (at, a, at, b)
            out.append(np.stack([*regions[who[lo]].T, x1 + c0, y1 + r0, x2 + c0, y2 + r0]))
        rr, rc, x1, y1, x2, y2 = np.concatenate(out, axis=1)
        named = pa.StructArray.from_arrays([pa.array(rr), pa.array(rc)], ["r", "c"])
        return pa.table({"region": named, "x1": x1.astype(float), "y1": y1.astype(float), "x2": x2.astype(float), "y2": y2.astype(float)})

    return run


def outlines(labelled: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """(region, x1, y1, x2, y2, w): the sides of every region, in pixels, as edges that `operators.rings` takes.

    The sum of x dy over a region's edges is its number of pixels; holes run the other way by themselves.
    """
    kind = labelled.schema[column].dataType.simpleString()
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / tile) for d in (-1, 0, 1))))
    rows = labelled.select("r", "c", F.col(column).alias("class"), "region").withColumn("tr", F.explode(near("r"))).withColumn("tc", F.explode(near("c")))
    sides = rows.groupBy("tr", "tc").applyInArrow(tile_sides(tile), "region struct<r:long,c:long>, x1 double, y1 double, x2 double, y2 double")
    return sides.withColumn("w", F.lit(1.0))


def trace(table: pa.Table) -> pa.Table:
    """Rings of one region from its sides: at a corner where the region meets itself, the ring turns left, so parts stay apart."""
    x1, y1, x2, y2 = (table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
    starts: dict[tuple, list[int]] = {}
    for i, p in enumerate(zip(x1, y1)):
        starts.setdefault(p, []).append(i)
    rings, used = [], np.zeros(len(x1), bool)
    for first in np.lexsort((x1, y1)):
        if used[first]:
            continue
        ring, i = [], first
        while not used[i]:
            used[i] = True
            dx, dy = x2[i] - x1[i], y2[i] - y1[i]
            if not ring or ring[-1][2] != (np.sign(dx), np.sign(dy)):
                ring.append((x1[i], y1[i], (np.sign(dx), np.sign(dy))))
            ahead = [j for j in starts[x2[i], y2[i]] if not used[j]]
            if ahead:
                i = max(ahead, key=lambda j: dx * (y2[j] - y1[j]) - dy * (x2[j] - x1[j]))
        if len(ring) > 1 and ring[0][2] == ring[-1][2]:
            ring[0] = (*ring[-1][:2], ring[0][2])
            ring.pop()
        rings.append([{"x": x, "y": y} for x, y, _ in ring])
    twice = [sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(q, q[1:] + q[:1])) for q in rings]
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    parts = [[q for q, t in zip(rings, twice) if t > 0], [q for q, t in zip(rings, twice) if t < 0]]
    return pa.table({"region": table.column("region")[:1], "rings": pa.array([parts[0]], kind), "holes": pa.array([parts[1]], kind)})


def polygons(labelled: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """(region, rings, holes) of every region, in pixels. A polygon is one value, so its outline meets in one task."""
    ring = "array<array<struct<x:double,y:double>>>"
    return outlines(labelled, column, tile).groupBy("region").applyInArrow(trace, f"region struct<r:long,c:long>, rings {ring}, holes {ring}")
