"""Carbon and planting: allometry chain, lattices, spacing, priorities, scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .spacing import enforce_spacing  # noqa: F401
from .windows import nested_prefixes, within_budget


def carbon_chain(canopy: Column, height: Column, model: str = "urban_generic") -> dict[str, Column]:
    """trees, agb_kg and co2_t of a canopy area and height: crown 0.6 h, its area at least 1 m2."""
    crown = 0.6 * height
    area = F.greatest(math.pi * (crown / 2) * (crown / 2), F.lit(1.0))
    trees = F.when((height > 0.01) & (canopy > 0), canopy / area).otherwise(0.0)
    agb = trees * S.agb(S.dbh_from_crown(crown), model)
    return {"trees": trees, "agb_kg": agb, "co2_t": S.co2(agb)}


def height_policy(blocks: DataFrame, heights: DataFrame, allow_fallback: bool) -> DataFrame:
    """Measured height and its source; the fallback only where allowed, else a missing height stops the run."""
    met = blocks.join(heights, "block_id", "left")
    if not allow_fallback and not met.filter("measured is null").isEmpty():
        raise ValueError("a block has no measured height")
    return met.withColumns({"height": F.coalesce("measured", S.height_fallback(F.col("canopy_m2") / F.col("block_area"))), "height_source": F.when(F.col("measured").isNotNull(), "measured").otherwise("fallback")}).drop("measured")


def block_co2(blocks: DataFrame, model: str = "urban_generic") -> DataFrame:
    made = blocks.withColumns(carbon_chain(F.col("canopy_m2"), F.col("height"), model))
    return made.withColumns({"trees": F.round("trees", 1), "agb_kg": F.round("agb_kg", 2), "co2_t": F.round("co2_t", 4), "allometry": F.lit(model)})


def lattice(cands: DataFrame, spacing: int) -> DataFrame:
    """Points strictly inside each box from its corner plus half a step; a box without any gets its centre if it is not tiny."""
    half = spacing / 2
    steps = lambda lo, hi: F.when(F.col(hi) - F.col(lo) > half, F.sequence(F.lit(0), (F.ceil((F.col(hi) - F.col(lo) - half) / spacing) - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    made = cands.withColumns({"ix": steps("minx", "maxx"), "iy": steps("miny", "maxy")})
    grid = made.withColumn("j", F.explode("iy")).withColumn("i", F.explode("ix")).select(*cands.columns, (F.col("minx") + half + F.col("i") * spacing).alias("x"), (F.col("miny") + half + F.col("j") * spacing).alias("y"))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    alone = made.filter((F.size("ix") * F.size("iy") == 0) & (area >= spacing * spacing / 4)).select(*cands.columns, ((F.col("minx") + F.col("maxx")) / 2.0).alias("x"), ((F.col("miny") + F.col("maxy")) / 2.0).alias("y"))
    return grid.unionByName(alone)


def priority(score: Column, water: Column) -> Column:
    """Score (NULL: 0), less a tenth beyond 1000 m from water; -1 stands for no water at all."""
    far = F.when(water == -1, 9999).otherwise(water) > 1000
    return F.coalesce(score, F.lit(0.0)) * F.when(far, 0.9).otherwise(1.0)


def select_budget(units: DataFrame, most: int | None = None, area: float | None = None, cost: float | None = None) -> DataFrame:
    """The beginning of the ranking (priority, unit id) that keeps every limit."""
    out = units
    if most is not None:
        out = out.orderBy(F.desc("priority"), "unit_id").limit(most)
    for column, limit in (("area", area), ("cost", cost)):
        if limit is not None:
            out = within_budget(out, "priority", column, limit, ("unit_id",)).drop("running")
    return out


def scenario_stats(rows: DataFrame, value: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 4)
    return rows.groupBy("scenario").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("sd"), F.min(value).alias("lo"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(value).alias("hi"), (F.count("*") * F.lit(0.5)).alias("carbon"),
    )


def scenarios(units: DataFrame, sizes: dict[str, int]) -> DataFrame:
    return scenario_stats(nested_prefixes(units, [F.desc("priority"), F.col("unit_id")], sizes), "priority")


def tiles_of(feats: DataFrame, z: int, x0: float = 73.7, y0: float = 18.4) -> DataFrame:
    """feats (lon/lat boxes) with every tile they touch."""
    w, s = S.tile_xy(F.col("west"), F.col("south"), z)
    e, n = S.tile_xy(F.col("east"), F.col("north"), z)
    return feats.withColumn("z", F.lit(z)).withColumn("tx", F.explode(F.sequence(w, e))).withColumn("ty", F.explode(F.sequence(n, s)))


def quantize(lon: Column, lat: Column, z: int, extent: int = 4096) -> list[Column]:
    """Coordinates within the tile (tx, ty)."""
    n = float(1 << z)
    x = (lon + 180) / 360 * n
    y = (1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n
    return [F.floor((x - F.col("tx")) * extent), F.floor((y - F.col("ty")) * extent)]
