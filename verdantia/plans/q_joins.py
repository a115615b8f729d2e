"""Queries of joins."""

from pyspark.sql import functions as F

from ..operators import scoring
from ..operators import spatial as O
from .catalog import query

OVER = "greatest(least({a}.maxx, {b}.maxx) - greatest({a}.minx, {b}.minx), 0) * greatest(least({a}.maxy, {b}.maxy) - greatest({a}.miny, {b}.miny), 0)"


def over(a, b):
    return OVER.format(a=a, b=b)


@query("SELECT r, c, seg, te, people FROM px WHERE seg IS NOT NULL AND te IS NOT NULL")
def jn_pixel_stack(v):
    """Layers that share a table need no join."""
    return v.px.filter("seg is not null and te is not null").select("r", "c", "seg", "te", "people")


@query("SELECT r, c, block_id FROM px")
def jn_pixel_to_block(v):
    x, y = 300000 + F.col("c") * 10 + 5, 2000000 + F.col("r") * 10 + 5
    return v.px.select("r", "c", O.block_name(O.cell(y, O.Y0, 250), O.cell(x, O.X0, 250)).alias("block_id"))


def pixel_boxes(v):
    return v.px.withColumns({"minx": F.lit(300000) + F.col("c") * 10, "miny": F.lit(2000000) + F.col("r") * 10, "maxx": F.lit(300010) + F.col("c") * 10, "maxy": F.lit(2000010) + F.col("r") * 10})


TOUCH = """ti AS (SELECT r, c, people, te, seg, unnest(range(CAST(floor(r * 10 / 250) AS BIGINT), CAST(floor((r * 10 + 10) / 250) AS BIGINT) + 1)) AS cy FROM px),
touch AS (SELECT *, 'PN_' || cy || '_' || cx AS tblock FROM (SELECT *, unnest(range(CAST(floor(c * 10 / 250) AS BIGINT), CAST(floor((c * 10 + 10) / 250) AS BIGINT) + 1)) AS cx FROM ti) t)"""


@query(f", {TOUCH} SELECT r, c, tblock AS block_id FROM touch")
def jn_pixel_touch_block(v):
    return O.touched_blocks(pixel_boxes(v)).select("r", "c", "block_id")


@query("SELECT score_status, count(*) AS n, round(avg(ndvi), 6) AS ndvi FROM factors f JOIN elig e ON f.block_id = e.block_id GROUP BY score_status")
def jn_eligibility(v):
    yes, no = scoring.split_eligible(v.factors, v.elig)
    return yes.unionByName(no).groupBy("score_status").agg(F.count("*").alias("n"), F.round(F.avg("ndvi"), 6).alias("ndvi"))


@query("SELECT b.block_id, coalesce(u.n, 0) AS n FROM blocks b LEFT JOIN (SELECT 'PN_' || CAST(floor((y - 2000000) / 250) AS BIGINT) || '_' || CAST(floor((x - 300000) / 250) AS BIGINT) AS block_id, count(*) AS n FROM units GROUP BY 1) u ON b.block_id = u.block_id")
def jn_attach_left_zero(v):
    n = v.units.groupBy(O.block_name(O.cell(F.col("y"), O.Y0, 250), O.cell(F.col("x"), O.X0, 250)).alias("block_id")).agg(F.count("*").alias("n"))
    return v.blocks.select("block_id").join(n, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT block_id, pixels FROM blocks WHERE block_id IN (SELECT block_id FROM scored WHERE score > 50)")
def jn_inner_restrict(v):
    return v.blocks.join(v.scored.filter("score > 50"), "block_id", "left_semi").select("block_id", "pixels")


@query(f"SELECT a.area_id, b.block_id, {over('a', 'b')} AS area FROM areas a JOIN blocks b ON a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny")
def jn_polygon_cells(v):
    """Blocks that an area overlaps or touches: a block is offered to the cells around its corner too."""
    a = O.prefixed(O.cover(v.areas), "a_")
    b = O.prefixed(v.blocks.withColumns({"cx": F.explode(F.sequence(F.col("bj"), F.col("bj") + 1)), "cy": F.col("bi")}).withColumn("cy", F.explode(F.sequence(F.col("cy"), F.col("cy") + 1))), "b_")
    w, h = F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx"), F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny")
    both = a.join(b, ["cx", "cy"]).filter((w >= 0) & (h >= 0)).select(F.col("a_area_id").alias("area_id"), F.col("b_block_id").alias("block_id"), (w * h).alias("area"))
    return both.distinct()


@query("SELECT a.area_id, u.unit_id FROM areas a JOIN units u ON u.x BETWEEN a.minx AND a.maxx AND u.y BETWEEN a.miny AND a.maxy")
def jn_point_in_polygon(v):
    return O.points_in(v.units.drop("area_id"), v.areas).select(F.col("b_area_id").alias("area_id"), "unit_id")


#: Corners of an area with a notch from its upper edge to its middle, as SQL.
NOTCHED = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("(minx + maxx) / 2.0E0", "(miny + maxy) / 2.0E0"), ("minx", "maxy")]


def crossing(a: tuple, b: tuple) -> str:
    (ax, ay), (bx, by) = a, b
    return f"CASE WHEN (({ay}) > y) <> (({by}) > y) AND x < (({bx}) - ({ax})) * ((y - ({ay})) / CAST(nullif(({by}) - ({ay}), 0) AS DOUBLE)) + ({ax}) THEN 1 ELSE 0 END"


@query("SELECT a.area_id, u.unit_id FROM areas a JOIN units u ON u.x BETWEEN a.minx AND a.maxx AND u.y BETWEEN a.miny AND a.maxy WHERE (" + " + ".join(crossing(a, b) for a, b in zip(NOTCHED, NOTCHED[1:] + NOTCHED[:1])) + ") % 2 = 1")
def jn_point_in_ring(v):
    """As jn_point_in_polygon, for rings that are no boxes."""
    ring = F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in NOTCHED))
    none = F.expr("cast(array() as array<array<struct<x:double,y:double>>>)")
    rings = v.areas.select("area_id", F.array(ring).alias("rings"), none.alias("holes"))
    return O.points_in_rings(v.units.drop("area_id"), rings, "area_id").select(F.col("b_area_id").alias("area_id"), "unit_id")


@query("""SELECT unit_id, area_id FROM (SELECT u.unit_id, a.area_id, row_number() OVER (PARTITION BY u.unit_id ORDER BY CASE WHEN u.x > a.minx AND u.x < a.maxx AND u.y > a.miny AND u.y < a.maxy THEN 0 ELSE 1 END, a.area_id) AS k
FROM areas a JOIN units u ON u.x BETWEEN a.minx AND a.maxx AND u.y BETWEEN a.miny AND a.maxy) t WHERE k = 1""")
def jn_lateral_first(v):
    x, y = F.col("x"), F.col("y")
    inner = (x > F.col("b_minx")) & (x < F.col("b_maxx")) & (y > F.col("b_miny")) & (y < F.col("b_maxy"))
    both = O.points_in(v.units.drop("area_id"), v.areas).withColumn("edge", F.when(inner, 0).otherwise(1))
    return O.first_by(both, ["unit_id"], ["edge", "b_area_id"]).select("unit_id", F.col("b_area_id").alias("area_id"))


@query("SELECT feat_id, 'PN_' || CAST(floor(((miny + maxy) / 2 - 2000000) / 250) AS BIGINT) || '_' || CAST(floor(((minx + maxx) / 2 - 300000) / 250) AS BIGINT) AS block_id FROM feats")
def jn_centroid_first(v):
    return v.feats.select("feat_id", O.block_name(O.cell((F.col("miny") + F.col("maxy")) / 2, O.Y0, 250), O.cell((F.col("minx") + F.col("maxx")) / 2, O.X0, 250)).alias("block_id"))


CELLS = "{t}x AS (SELECT feat_id, landuse, kind, unnest(range(CAST(floor((minx - 300000) / 10) AS BIGINT), CAST(floor((maxx - 300000) / 10) AS BIGINT) + 1)) AS cx, miny, maxy FROM feats), {t} AS (SELECT feat_id, landuse, kind, cx, unnest(range(CAST(floor((miny - 2000000) / 10) AS BIGINT), CAST(floor((maxy - 2000000) / 10) AS BIGINT) + 1)) AS cy FROM {t}x)"


def cells(v, keys):
    """Cells of 10 m with the number of features of each combination of keys that touch them."""
    return O.cell_counts(v.feats, keys, 10)


@query(f""", {CELLS.format(t='fc')}, op AS (SELECT * FROM fc WHERE kind = 'canopy'), lu AS (SELECT * FROM fc WHERE kind <> 'canopy')
SELECT landuse, covered, count(*) AS cells FROM (SELECT lu.landuse, true AS covered FROM op JOIN lu ON op.cx = lu.cx AND op.cy = lu.cy UNION ALL
SELECT NULL, false FROM op WHERE NOT EXISTS (SELECT 1 FROM lu WHERE op.cx = lu.cx AND op.cy = lu.cy)) t GROUP BY ALL""")
def jn_overlay_split(v):
    """Features are counted by cell before they meet, so a crowded cell joins once for each land use."""
    all_ = cells(v, ["kind", "landuse"])
    open_ = all_.filter("kind = 'canopy'").groupBy("cx", "cy").agg(F.sum("n").alias("n"))
    use = all_.filter("kind != 'canopy'").groupBy("cx", "cy", "landuse").agg(F.sum("n").alias("m"))
    met = open_.join(use.hint("merge"), ["cx", "cy"], "left")  # cells are more than their estimated size tells
    return met.groupBy("landuse", F.col("m").isNotNull().alias("covered")).agg(F.sum(F.col("n") * F.coalesce("m", F.lit(1))).alias("cells"))


def _pairs(v):
    b = v.feats.filter("kind = 'building'").select("feat_id", "minx", "miny", "maxx", "maxy")
    return O.overlaps(b, v.feats.filter("kind != 'building'").select("feat_id", "kind", "minx", "miny", "maxx", "maxy"))


PAIRS = f"pairs AS (SELECT a.feat_id, b.feat_id AS other, b.kind, {over('a', 'b')} AS area FROM feats a JOIN feats b ON a.kind = 'building' AND b.kind <> 'building' AND {over('a', 'b')} > 0)"


@query(f", {PAIRS} SELECT feat_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY feat_id ORDER BY other) AS k FROM pairs) t WHERE k = 1")
def jn_first_intersect(v):
    others = v.feats.filter("kind != 'building'").withColumnRenamed("feat_id", "other")
    return O.first_overlap(v.feats.filter("kind = 'building'"), "feat_id", others, "other", ["kind"]).select("feat_id", "kind")


@query(f", {PAIRS}, sums AS (SELECT feat_id, kind, sum(area) AS area FROM pairs GROUP BY feat_id, kind) SELECT feat_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY feat_id ORDER BY area DESC, kind) AS k FROM sums) t WHERE k = 1")
def jn_max_overlap(v):
    sums = _pairs(v).groupBy("a_feat_id", "b_kind").agg(F.sum("area").alias("area"))
    return O.first_by(sums, ["a_feat_id"], [F.desc("area"), "b_kind"]).select(F.col("a_feat_id").alias("feat_id"), F.col("b_kind").alias("kind"))


@query(f""", ov AS (SELECT b.block_id, w.ward_id, {over('b', 'w')} AS area FROM blocks b JOIN wards w ON {over('b', 'w')} > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY area DESC, ward_id) AS k FROM ov),
top AS (SELECT b.block_id, max(CASE WHEN k = 1 THEN area END) AS best, max(CASE WHEN k = 2 THEN area END) AS second, max(CASE WHEN k = 1 THEN ward_id END) AS ward FROM blocks b LEFT JOIN rk ON b.block_id = rk.block_id GROUP BY b.block_id),
st AS (SELECT *, CASE WHEN coalesce(best, 0) <= 0.0001 THEN 'no_overlap' WHEN best - coalesce(second, 0) <= 625 THEN 'ambiguous_overlap' ELSE 'assigned' END AS status FROM top)
SELECT block_id, CASE WHEN status = 'assigned' THEN ward END AS ward_id, status FROM st""")
def jn_ward_assign(v):
    return O.ward_assign(v.blocks, v.wards)


@query(f""", src AS (SELECT area_id, area_id * 10 + 7 AS pop, greatest(minx, 300100) AS minx, greatest(miny, 2000100) AS miny, least(maxx, 302500) AS maxx, least(maxy, 2002500) AS maxy, (maxx - minx) * (maxy - miny) AS src_area FROM areas),
cl AS (SELECT * FROM src WHERE minx < maxx AND miny < maxy)
SELECT b.block_id, round(sum(s.pop * {over('s', 'b')} / s.src_area), 6) AS value, count(DISTINCT s.area_id) AS cells, CAST(sum({over('s', 'b')}) AS BIGINT) AS area FROM cl s JOIN blocks b ON {over('s', 'b')} > 0 GROUP BY b.block_id""")
def jn_area_weighted_alloc(v):
    src = v.areas.withColumn("pop", F.col("area_id") * 10 + 7)
    got = O.area_weighted(src, v.blocks, "pop", "area_id", (300100, 2000100, 302500, 2002500))
    return got.select("block_id", F.round("value", 6).alias("value"), "cells", F.col("area").cast("long").alias("area"))


@query("SELECT b.block_id, c.value, CASE WHEN c.value IS NULL THEN 0 ELSE 1 END AS completeness FROM blocks b LEFT JOIN (SELECT n_nationkey % 5 AS gi, CAST(floor(n_nationkey / 5) AS BIGINT) AS gj, n_nationkey * 3 AS value FROM nation WHERE n_nationkey % 6 <> 1) c ON CAST(floor(b.bi / 3) AS BIGINT) = c.gi AND CAST(floor(b.bj / 3) AS BIGINT) = c.gj")
def jn_direct_cell_lookup(v):
    coarse = v.nation.filter("n_nationkey % 6 != 1").select((F.col("n_nationkey") % 5).cast("long").alias("gi"), F.floor(F.col("n_nationkey") / 5).alias("gj"), (F.col("n_nationkey") * 3).alias("value"))
    made = v.blocks.withColumns({"gi": F.floor(F.col("bi") / 3), "gj": F.floor(F.col("bj") / 3)}).join(coarse, ["gi", "gj"], "left")
    return made.select("block_id", "value", F.when(F.col("value").isNull(), 0).otherwise(1).alias("completeness"))


@query("SELECT seg, bldg, count(*) AS n FROM px WHERE seg IS NOT NULL AND bldg IS NOT NULL GROUP BY seg, bldg")
def jn_raster_crosswalk(v):
    a, b = v.px.select("r", "c", "seg").filter("seg is not null"), v.px.select("r", "c", "bldg").filter("bldg is not null")
    return a.join(b, ["r", "c"]).groupBy("seg", "bldg").agg(F.count("*").alias("n"))


@query("SELECT r.unit_id, r.priority FROM ranked r JOIN bridge b ON r.unit_id = b.unit_id WHERE b.scenario = 'b_250'")
def jn_scenario_units(v):
    return v.ranked.join(v.bridge.filter("scenario = 'b_250'").select("unit_id"), "unit_id").select("unit_id", "priority")


DIST = "sqrt(pow({p}.x - ({w}.x1 + {t} * ({w}.x2 - {w}.x1)), 2) + pow({p}.y - ({w}.y1 + {t} * ({w}.y2 - {w}.y1)), 2))".format(p="u", w="w", t="least(greatest(((u.x - w.x1) * (w.x2 - w.x1) + (u.y - w.y1) * (w.y2 - w.y1)) / 2500.0, 0.0), 1.0)")


@query(f"SELECT u.unit_id, round(min({DIST}), 4) AS distance FROM units u, water w GROUP BY u.unit_id")
def jn_nearest_distance(v):
    return O.nearest_distance(v.units.select("unit_id", "x", "y"), v.water, "unit_id").select("unit_id", F.round("distance", 4).alias("distance"))


@query("SELECT a.c_custkey AS i, b.c_custkey AS j, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance FROM units a JOIN units b ON a.c_custkey < b.c_custkey AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 900")
def jn_distance_pairs(v):
    return O.distance_pairs(v.units, "c_custkey", 30).select("i", "j", F.round("distance", 4).alias("distance"))


@query(f"SELECT DISTINCT u.unit_id FROM units u JOIN water w ON {DIST} <= 60.5")
def jn_road_buffer(v):
    return O.within_buffer(v.units.select("unit_id", "x", "y"), v.water, 60.5, "unit_id").select("unit_id")


@query("SELECT block_id, score AS new_score, old_score FROM scored WHERE bi < 9 AND bj > 2")
def jn_old_new(v):
    return v.scored.filter("bj > 2").select("block_id", "old_score").join(v.scored.filter("bi < 9").select("block_id", F.col("score").alias("new_score")), "block_id")


@query("SELECT count(*) AS orphans FROM units WHERE area_id NOT IN (SELECT area_id FROM areas WHERE area_id % 4 <> 0)")
def jn_orphans(v):
    return v.units.join(v.areas.filter("area_id % 4 != 0").select(F.col("area_id").cast("int")), "area_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT CAST(count(CASE WHEN a IS NULL THEN 1 END) AS BIGINT) AS only_right, CAST(count(CASE WHEN b IS NULL THEN 1 END) AS BIGINT) AS only_left FROM (SELECT x.block_id AS a, y.block_id AS b FROM (SELECT block_id FROM blocks WHERE bi > 2) x FULL OUTER JOIN (SELECT block_id FROM scored WHERE bj < 9) y ON x.block_id = y.block_id) t")
def jn_id_set_equal(v):
    a = v.blocks.filter("bi > 2").select("block_id", F.lit(1).alias("a"))
    b = v.scored.filter("bj < 9").select("block_id", F.lit(1).alias("b"))
    return a.join(b, "block_id", "full_outer").agg(F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"))


@query("SELECT u.unit_id, 'PN_' || (300000 + CAST(floor((u.x - 300000) / 250) AS BIGINT) * 250) || '_' || (2000000 + CAST(floor((u.y - 2000000) / 250) AS BIGINT) * 250) AS parent, s.score FROM units u LEFT JOIN scored s ON s.minx = 300000 + CAST(floor((u.x - 300000) / 250) AS BIGINT) * 250 AND s.miny = 2000000 + CAST(floor((u.y - 2000000) / 250) AS BIGINT) * 250")
def jn_parent_block(v):
    at = v.units.withColumns({"minx": F.floor(F.col("x") / 250) * 250, "miny": F.floor(F.col("y") / 250) * 250})
    made = at.join(v.scored.select("minx", "miny", "score"), ["minx", "miny"], "left")
    return made.select("unit_id", O.block_name(F.col("minx"), F.col("miny")).alias("parent"), "score")


@query("SELECT DISTINCT md5(printf('%.4f,%.4f', x / 1000.0, y / 1000.0)) AS cache_key, CASE WHEN c_nationkey_ok THEN CAST(x % 50 AS BIGINT) END AS pm25 FROM (SELECT x, y, x % 3 = 0 AS c_nationkey_ok FROM units) t")
def jn_cached_enrich(v):
    key = F.md5(F.format_string("%.4f,%.4f", F.col("x") / 1000.0, F.col("y") / 1000.0))
    here = v.units.withColumn("cache_key", key).dropDuplicates(["cache_key"])
    readings = v.units.filter("x % 3 = 0").select(key.alias("cache_key"), (F.col("x") % 50).alias("pm25")).dropDuplicates(["cache_key"])
    return here.join(readings, "cache_key", "left").select("cache_key", "pm25")
