"""Minimum distances between points: of each close pair, the later point goes, as a greedy pass in the order of keys does it.

A point is decided once all smaller points near it are. Points meet in square tiles with a border of one distance; a pass over
a tile's points in key order decides all that do not wait for an undecided point of the border. Tiles shift by half
a side from round to round, so what one round leaves at a border lies within a tile in the next: a chain of points that
wait for one another costs a round for each tile's length, not for each link. Crowded tiles are split by sixteen, down to
the least side, so a tile holds a bounded number of points unless that many stand within a few distances. Of points at one
place only the first can stay, so the others go before the first round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import written

#: Points of a tile, about; the least side of a tile in distances, and how often it doubles to the largest one.
CROWD, LEAST_SIDE, DOUBLINGS = 200_000, 8, 14
OPEN, KEPT, GONE = 0, 1, 2
#: Points count as closer than a distance if they are so by this much.
REACH_LESS = 1e-4


def decide(spacing: float):
    """Statuses of a tile's own points that its rows determine; rows come with `own` and their status so far."""
    reach = spacing - REACH_LESS

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        x, y = (table.column(c).to_numpy()[order] for c in "xy")
        px, py = x.tolist(), y.tolist()
        status, own = table.column("status").to_numpy()[order].copy(), table.column("own").to_numpy(zero_copy_only=False)[order]
        if not (own & (status == OPEN)).any():
            return pa.table({"place": table.column("place").to_numpy()[order][own], "status": status[own].astype(np.int32)})
        cell = np.stack([np.floor(x / spacing), np.floor(y / spacing)], axis=1).astype(np.int64).tolist()
        near: dict[tuple, list[int]] = {}  # kept and open points so far, by cell of one distance
        for i, (cx, cy) in enumerate(cell):
            if status[i] == OPEN and own[i]:
                waits = False
                for j in (j for a in (cx - 1, cx, cx + 1) for b in (cy - 1, cy, cy + 1) for j in near.get((a, b), ())):
                    if math.hypot(px[i] - px[j], py[i] - py[j]) <= reach:
                        if status[j] == KEPT:
                            status[i] = GONE
                            break
                        waits = True
                else:
                    if not waits:
                        status[i] = KEPT
            if status[i] != GONE:
                near.setdefault((cx, cy), []).append(i)
        mine = np.flatnonzero(own)
        return pa.table({"place": table.column("place").to_numpy()[order][mine], "status": status[mine].astype(np.int32)})

    return run


def tiles(at: DataFrame, spacing: float, shift: float) -> DataFrame:
    """(fx, fy, level, tx, ty): the tile of every least cell that has points: the largest without a crowd, or the cell itself."""
    cells = written(at.groupBy(*(cell(c, spacing, shift).alias(f"f{c}") for c in "xy")).agg(F.count("*").alias("n")))
    up = lambda c, k: F.floor(F.col(c) / (1 << k))
    best = cells.select("fx", "fy", F.lit(0).alias("level"))
    for k in range(2, DOUBLINGS + 1, 2):
        full = cells.groupBy(up("fx", k).alias("ux"), up("fy", k).alias("uy")).agg(F.sum("n").alias("n")).filter(F.col("n") <= CROWD)
        fits = cells.select("fx", "fy", up("fx", k).alias("ux"), up("fy", k).alias("uy")).join(full, ["ux", "uy"], "left_semi")
        best = best.unionByName(fits.select("fx", "fy", F.lit(k).alias("level")))
    best = best.groupBy("fx", "fy").agg(F.max("level").alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    return written(best.withColumns({"tx": F.floor(F.col("fx") / side), "ty": F.floor(F.col("fy") / side)}))


def cell(c: str | Column, spacing: float, shift: float) -> Column:
    return F.floor(((F.col(c) if isinstance(c, str) else c) + shift) / (LEAST_SIDE * spacing))


def enforce_spacing(units: DataFrame, key: str, spacing: float) -> DataFrame:
    """units without the later point of each pair closer than spacing; points without (finite) coordinates stay, keys are distinct."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    there = F.coalesce((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")) & F.col(key).isNotNull(), F.lit(False))
    at = units.filter(there).select(F.col(key).alias("place"), x.alias("x"), y.alias("y"))
    if spacing > REACH_LESS:
        at = at.groupBy("x", "y").agg(F.min("place").alias("place")).select("place", "x", "y")
    at = written(at)
    kind = at.schema["place"].dataType.simpleString()
    sides = LEAST_SIDE * spacing * (1 << DOUBLINGS)
    shifts = [0.0, sides / 2 + LEAST_SIDE * spacing / 2]
    maps = [tiles(at, spacing, s) for s in shifts]
    state, turn = written(at.withColumn("status", F.lit(OPEN))), 0
    while True:
        shift, named = shifts[turn % 2], maps[turn % 2]
        corners = F.array_distinct(F.array(*(F.struct(cell(F.col("x") + a * spacing, spacing, shift).alias("fx"), cell(F.col("y") + b * spacing, spacing, shift).alias("fy")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        own = (F.col("f.fx") == cell("x", spacing, shift)) & (F.col("f.fy") == cell("y", spacing, shift))
        rows = state.withColumn("f", F.explode(corners)).select("place", "x", "y", "status", own.alias("own"), "f.fx", "f.fy").join(named, ["fx", "fy"])
        rows = rows.groupBy("level", "tx", "ty", "place", "x", "y", "status").agg(F.max("own").alias("own"))
        told = rows.groupBy("level", "tx", "ty").applyInArrow(decide(spacing), f"place {kind}, status int")
        made = written(state.drop("status").join(told, "place"))
        state = made.filter(F.col("status") != GONE)
        turn += 1
        if made.filter(F.col("status") == OPEN).isEmpty():
            break
    return units.filter(~there).unionByName(units.join(state.select(F.col("place").alias(key)).hint("merge"), key, "left_semi").select(*units.columns))
