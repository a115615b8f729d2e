"""Polygons laid over one another: the pieces of the plane by which polygons cover them, with exact areas.

Polygons meet in grid cells. A cell that only whole polygons cover is one piece. In a cell with edges, heights are cut where
edges begin, end, cross one another or leave the cell; between two cuts the edges stand in one order, and each gap between
neighbours is a trapezoid that one set of polygons covers. Gaps, extensions, overlaps and unions are sums over pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import CELL, X0, Y0
from .rings import cover

#: Square metres from which a gap or extension counts, and above which an overlap is no sliver.
SIGNIFICANT, SLIVER = 100.0, 1.0


def cell_pieces(ids: list[int], edges: list[np.ndarray | None], x0: float, y0: float, size: float) -> dict[tuple, float]:
    """{covering polygons: area} of a cell; edges (rows x1, y1, x2, y2) are None for a polygon that covers the cell."""
    whole = [i for i, e in zip(ids, edges) if e is None]
    rows = [(i, e) for i, e in zip(ids, edges) if e is not None]
    who = np.concatenate([np.full(len(e), i) for i, e in rows])
    e = np.concatenate([e for _, e in rows]) - [x0, y0, x0, y0]
    tilted = (e[:, 1] != e[:, 3]) & (np.minimum(e[:, 0], e[:, 2]) < size)  # edges right of the cell bound nothing in it
    e, who = e[tilted], who[tilted]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    base = e[:, 0] - slope * e[:, 1]  # x = base + slope * y
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    steep, at = np.append(slope, [0, 0]), np.append(base, [0, size])  # the cell's sides cut heights too
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (at[None, :] - at[:, None]) / (steep[:, None] - steep[None, :])
    cross = cross[np.isfinite(cross)]
    cuts = np.concatenate([[0.0, size], low, high, cross])
    cuts = np.unique(cuts[(cuts >= 0) & (cuts <= size)])
    out: dict[tuple, float] = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        here = np.flatnonzero((low <= a) & (high >= b))
        middle = base[here] + slope[here] * ((a + b) / 2)
        here = here[np.argsort(middle, kind="stable")]
        ends = [np.clip(base[here] + slope[here] * y, 0, size) for y in (a, b)]
        mean = np.concatenate([[0.0], (ends[0] + ends[1]) / 2, [size]])
        wide = np.maximum(np.diff(mean), 0) * (b - a)
        inside = set(whole)
        for k, area in enumerate(wide):
            if k:
                inside ^= {int(who[here[k - 1]])}
            if area > 0 and inside:
                name = tuple(sorted(inside))
                out[name] = out.get(name, 0.0) + float(area)
    return out


def rim_pieces(x0: float, y0: float, size: float):
    def run(batches):
        for batch in batches:
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for row in batch.to_pylist():
                edges = [None if p["edges"] is None else np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in p["edges"]], float).reshape(-1, 4) for p in row["polygons"]]
                found = cell_pieces(list(range(len(edges))), edges, x0 + row["cx"] * size, y0 + row["cy"] * size, size)
                for name, area in found.items():
                    for c, v in zip(cols, (row["cx"], row["cy"], [row["polygons"][i]["id"] for i in name], area)):
                        c.append(v)
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.float64())], ["cx", "cy", "ids", "area"])

    return run


def pieces(polygons: DataFrame, key: str, size: float = CELL, x0: float = X0, y0: float = Y0) -> DataFrame:
    """(cx, cy, ids, area): in each cell, the area that exactly the polygons `ids` (sorted, as strings) cover."""
    named = polygons.select(F.col(key).cast("string").alias("id"), "rings", "holes")
    met = cover(named, "id", size, x0, y0).groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("id", "edges"))).alias("polygons"), F.max(F.col("edges").isNotNull()).alias("rim"))
    plain = met.filter("not rim").select("cx", "cy", F.col("polygons.id").alias("ids"), F.lit(float(size) * size).alias("area"))
    rim = met.filter("rim").select("cx", "cy", "polygons").mapInArrow(rim_pieces(x0, y0, size), "cx long, cy long, ids array<string>, area double")
    return plain.unionByName(rim)


def dissolve(polygons: DataFrame, key: str, by: str, size: float = CELL) -> DataFrame:
    """(by, polygons, area): the area that the polygons of each group cover together, counted once."""
    sep = "\x1f"
    group = F.col(by).cast("string")
    named = polygons.select(F.concat(group, F.lit(sep), F.col(key).cast("string")).alias("id"), "rings", "holes")
    groups = F.array_distinct(F.transform("ids", lambda i: F.substring_index(i, sep, 1)))
    areas = pieces(named, "id", size).select(F.explode(groups).alias(by), "area").groupBy(by).agg(F.sum("area").alias("area"))
    n = polygons.groupBy(group.alias(by)).agg(F.count("*").alias("polygons"))
    return n.join(areas, by, "left").select(by, "polygons", F.coalesce("area", F.lit(0.0)).alias("area"))


def mask(wards: DataFrame, boundary: DataFrame, key: str, size: float = CELL) -> DataFrame:
    """Pieces of wards and boundary: (inside, wards, area); inside: the boundary covers it."""
    both = wards.select(F.concat(F.lit("w"), F.col(key).cast("string")).alias("id"), "rings", "holes")
    edge = boundary.select(F.concat(F.lit("b"), F.monotonically_increasing_id().cast("string")).alias("id"), "rings", "holes")
    own = F.transform(F.filter("ids", lambda i: i.startswith("w")), lambda i: F.substring(i, 2, 1 << 20))
    return pieces(both.unionByName(edge), "id", size).select(F.exists("ids", lambda i: i.startswith("b")).alias("inside"), own.alias("wards"), "area")


def overlap_pairs(found: DataFrame, sliver: float = SLIVER) -> DataFrame:
    """(a, b, area) of wards that share more than a sliver, a before b, from mask()."""
    some = found.filter(F.size("wards") > 1)
    first = some.select("wards", "area", F.posexplode("wards").alias("i", "a"))
    pairs = first.select("a", "area", F.explode(F.slice("wards", F.col("i") + 2, F.size("wards"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("area").alias("area")).filter(F.col("area") > sliver)


def mask_report(found: DataFrame, significant: float = SIGNIFICANT, sliver: float = SLIVER) -> DataFrame:
    """One row: areas of gaps and extensions, raw and if significant, of overlaps, pairs, and gaps in percent of the boundary."""
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("area"))), F.lit(0.0))
    inside, bare = F.col("inside"), F.size("wards") == 0
    sums = found.agg(total(inside & bare).alias("gap_m2"), total(~inside & ~bare).alias("extension_m2"), total(inside).alias("boundary_m2"))
    over = overlap_pairs(found, sliver).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("overlap_m2"), F.count("*").alias("pairs"))
    held = lambda c: F.when(F.col(c) >= significant, F.col(c)).otherwise(0.0)
    return sums.crossJoin(over).select(
        "gap_m2", "extension_m2", held("gap_m2").alias("significant_gap_m2"), held("extension_m2").alias("significant_extension_m2"), "overlap_m2", "pairs", (100 * F.try_divide("gap_m2", "boundary_m2")).alias("gap_percent"),
    )
