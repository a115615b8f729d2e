"""Filters, validators and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD_LAND_USE = ("military", "railway", "quarry", "landfill")
# Fixed values of the activity log and of the class layers.
ACTIVITY_TYPES = ("viewed_block", "analyzed_study_area", "viewed_carbon", "viewed_scenario", "viewed_planting_opportunity", "exported_report", "research_saved")
CATEGORIES = ("explore", "carbon", "analysis", "planting")
ACTIONS = ("viewed", "analyzed", "saved", "exported")
ENTITY_TYPES = ("block", "study_area", "ward", "scenario", "planting_unit", "report", "session")
LAND_COVER = {0: "water", 1: "trees", 2: "grass", 3: "flooded_vegetation", 4: "crops", 5: "shrub_and_scrub", 6: "built", 7: "bare", 8: "snow_and_ice"}
SEGMENTATION = {0: "canopy", 1: "impervious", 2: "pervious", 3: "water"}


def cloud_scenes(df: DataFrame, d0: str, d1: str, pct: int) -> DataFrame:
    return df.filter((F.col("ts") >= F.lit(d0).cast("timestamp")) & (F.col("ts") < F.lit(d1).cast("timestamp")) & (F.col("cloud") < pct))


def widen_window(df: DataFrame, narrow: tuple, wide: tuple, pct: int) -> DataFrame:
    """Scenes of the narrow window, or of the wide one where it has none, with the window used."""
    near = cloud_scenes(df, *narrow, pct)
    used = narrow if not near.isEmpty() else wide
    return cloud_scenes(df, *used, pct).withColumn("date_used", F.lit(f"{used[0]}/{used[1]}"))


def scl_mask(df: DataFrame) -> DataFrame:
    return df.filter(F.col("scl").isin(4, 5, 6, 7))


def qa_bits(df: DataFrame) -> DataFrame:
    """Pixels with neither the cloud bit (3) nor the shadow bit (4)."""
    qa = F.col("qa").cast("int")
    return df.filter((qa.bitwiseAND(F.lit(8)) == 0) & (qa.bitwiseAND(F.lit(16)) == 0))


def valid_range(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None, inclusive: bool = False) -> DataFrame:
    x = F.col(column)
    if lo is not None:
        df = df.filter(x >= lo if inclusive else x > lo)
    return df.filter(x < hi) if hi is not None else df


def boundary_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask.filter("inside = 1").select("r", "c"), ["r", "c"])


def edge_cells(blocks: DataFrame, share: float, area: str) -> DataFrame:
    middle = blocks.agg(F.median(area).alias("middle"))  # one row
    return blocks.crossJoin(F.broadcast(middle)).filter(F.col(area) >= share * F.col("middle")).drop("middle")


def viewport(df: DataFrame, minx, miny, maxx, maxy, limit: int = 10000, key: str = "block_id") -> DataFrame:
    hit = (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
    return df.filter(hit).orderBy(key).limit(limit)


def inside_bounds(x: Column, y: Column, minx, miny, maxx, maxy) -> Column:
    return x.between(minx, maxx) & y.between(miny, maxy)


def split_land_use(df: DataFrame, column: str = "landuse") -> tuple[DataFrame, DataFrame]:
    """(excluded, rest); a missing land use is no reason to exclude."""
    bad = F.coalesce(F.col(column).isin(*BAD_LAND_USE), F.lit(False))
    return df.filter(bad), df.filter(~bad)


def patch_pairs(images: DataFrame, masks: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return images.join(masks, key, "left_semi").join(excluded, key, "left_anti")


def study_area_status(df: DataFrame, bounds: tuple, most_km2: float = 50.0) -> DataFrame:
    """status and the first reason that applies."""
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    x0, y0, x1, y1 = bounds
    reason = (
        F.when(F.col("minx").isNull() | F.col("maxx").isNull() | F.col("miny").isNull() | F.col("maxy").isNull(), "malformed")
        .when(~F.coalesce(F.col("kind"), F.lit("")).isin("Polygon", "MultiPolygon"), "not_polygon")
        .when(area <= 0, "empty")
        .when((F.col("minx") < x0) | (F.col("miny") < y0) | (F.col("maxx") > x1) | (F.col("maxy") > y1), "out_of_bounds")
        .when(area > most_km2 * 1e6, "too_large")
    )
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))


def radius_ok(r: Column) -> Column:
    return F.coalesce(r.between(10, 50000), F.lit(False))


def tile_ok(z: Column, x: Column, y: Column) -> Column:
    side = F.pow(F.lit(2.0), z).cast("long")
    return z.between(0, 22) & (x >= 0) & (x < side) & (y >= 0) & (y < side)


def block_id_ok(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{1,50}$")


def incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have NULL, NaN or an infinity in each column."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.agg(*(F.count_if(bad(c)).alias(c) for c in columns))


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    found = {c: n for c, n in incomplete(df, columns).first().asDict().items() if n}
    if found:
        raise ValueError(f"incomplete factors: {found}")
    return df


def pm25_problem(df: DataFrame, dev: bool = False) -> DataFrame:
    if "pm25" not in df.columns:
        df = df.withColumn("pm25", F.lit(None).cast("double"))
    n = F.count_if(F.col("pm25").isNull())
    return df.agg(n.alias("missing"), (F.lit(dev) | (n == 0)).alias("ok"))


def config_problem(config: DataFrame) -> DataFrame:
    """(weights sum to 1, weights within [0, 1], directions known) of a (factor, weight, direction) table."""
    return config.agg(
        (F.abs(F.sum("weight") - 1) <= 1e-6).alias("sums_to_one"), F.every(F.col("weight").between(0, 1)).alias("in_range"), F.every(F.col("direction").isin("positive", "negative")).alias("directions_known"),
    )


def aligned(layers: DataFrame, columns: list[str]) -> DataFrame:
    return layers.agg((F.count_distinct(F.struct(*columns)) <= 1).alias("aligned"), F.count("*").alias("layers"))


def boundary_report(wards: DataFrame) -> DataFrame:
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return wards.agg(
        F.count("*").alias("features"), F.count_if(area > 0).alias("valid"), F.count_if(area <= 0).alias("empty"), F.sum(area).cast("long").alias("area_m2"),
        (F.count("ward_id") - F.count_distinct("ward_id")).alias("repeated_ids"), F.count_if(F.col("name").isNull()).alias("missing_names"),
    )


def carbon_violations(df: DataFrame) -> DataFrame:
    f = F.col("canopy_m2") / F.col("block_area")
    return df.agg(
        (F.count("block_id") - F.count_distinct("block_id")).alias("repeated_ids"), F.count_if(F.col("canopy_m2") < 0).alias("negative_canopy"),
        F.count_if(F.col("canopy_m2") > F.col("block_area") + 1).alias("canopy_above_block"), F.count_if(~f.between(0, 1.01)).alias("fraction"), F.count_if(F.col("height") < 0).alias("negative_height"),
    )


def activity_status(df: DataFrame, types: tuple = ACTIVITY_TYPES) -> DataFrame:
    """Checked events: allowed type, category, action and entity type where there is one, title of 1 to 120 characters.

    Long descriptions and ids are cut.
    """
    ok = F.col("event_type").isin(*types) & F.length("title").between(1, 120)
    for column, allowed in (("category", CATEGORIES), ("action_type", ACTIONS), ("entity_type", ENTITY_TYPES)):
        if column in df.columns:
            ok = ok & (F.col(column).isNull() | F.col(column).isin(*allowed))
    return df.withColumns({"ok": F.coalesce(ok, F.lit(False)), "description": F.substring("description", 1, 300), "entity": F.substring("entity", 1, 100)})


def planting_roles(events: DataFrame, roles: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): events of `kind` need the role researcher or admin."""
    told = events.join(roles, "user_id", "left")
    ok = (F.col("event_type") != kind) | F.coalesce(F.col("role").isin("researcher", "admin"), F.lit(False))
    return told.filter(ok), told.filter(~ok)


def lookup(column: Column, table: dict) -> Column:
    """A value by key; NULL for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column)


def result_type(kind: Column) -> Column:
    # Place types by group.
    groups = {
        "Locality": "residential neighbourhood suburb village quarter city_block",
        "Road": "secondary primary tertiary trunk road street highway motorway",
        "Landmark": "historic attraction museum monument ruins tourism place_of_worship park",
        "Area": "city town county state administrative",
    }
    k, out = F.lower(kind), F.when(kind.isNull() | (kind == ""), "Place")
    for name, words in groups.items():
        out = out.when(k.isin(*words.split()), name)
    return out.otherwise(F.concat(F.upper(F.substring(k, 1, 1)), k.substr(F.lit(2), F.length(k))))
