"""Queries of carbon, planting and map tiles."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import planting as O
from ..operators import spatial as P
from .catalog import query
from .q_joins import over

CHAIN = """chain AS (SELECT *, CASE WHEN height > 0.01 AND canopy_m2 > 0 THEN canopy_m2 / greatest(pi() * (0.6::DOUBLE * height / 2) * (0.6::DOUBLE * height / 2), 1.0) ELSE 0.0 END AS trees,
  CASE WHEN height > 0 THEN 0.1066::DOUBLE * pow(0.6::DOUBLE * height * 100 / 20.0, 2.4572::DOUBLE) ELSE 0.0 END AS one FROM carbon), co AS (SELECT *, trees * one AS agb, trees * one * 0.47::DOUBLE * (44.0::DOUBLE / 12.0) / 1000 AS co2 FROM chain)"""


@query(f", {CHAIN} SELECT block_id, round(trees, 4) AS trees, round(agb, 3) AS agb_kg, round(co2, 4) AS co2_t FROM co")
def cb_chain(v):
    got = v.carbon.withColumns(O.carbon_chain(F.col("canopy_m2"), F.col("height")))
    return got.select("block_id", F.round("trees", 4).alias("trees"), F.round("agb_kg", 3).alias("agb_kg"), F.round("co2_t", 4).alias("co2_t"))


@query(f", {CHAIN} SELECT block_id, round(trees, 1) AS trees, round(agb, 2) AS agb_kg, round(co2, 4) AS co2_t, 'urban_generic' AS allometry FROM co")
def cb_block_co2(v):
    return O.block_co2(v.carbon).select("block_id", "trees", "agb_kg", "co2_t", "allometry")


@query("SELECT block_id, round(tree_density * 62500, 4) AS canopy_m2 FROM factors")
def cb_canopy_from_scores(v):
    return v.factors.select("block_id", F.round(F.col("tree_density") * 62500, 4).alias("canopy_m2"))


@query("SELECT block_id, CASE WHEN block_id LIKE '%_5' THEN CASE WHEN canopy_m2 / 62500 <= 0.0001 THEN 0.0 ELSE round(least(greatest(3 + 12 * (canopy_m2 / 62500), 0.0), 15.0), 6) END ELSE height END AS height, CASE WHEN block_id LIKE '%_5' THEN 'fallback' ELSE 'measured' END AS height_source FROM carbon")
def cb_height_policy(v):
    heights = v.carbon.filter(~F.col("block_id").endswith("_5")).select("block_id", F.col("height").alias("measured"))
    return O.height_policy(v.carbon.drop("height"), heights, True).select("block_id", F.round("height", 6).alias("height"), "height_source")


@query("SELECT feat_id, round(0.1066::DOUBLE * pow(cbrt(6.0 * (maxx - minx) * 3 / pi()) * 5, 2.4572::DOUBLE), 4) AS agb FROM feats WHERE kind = 'canopy'")
def cb_volume_co2(v):
    volume = ((F.col("maxx") - F.col("minx")) * 3).cast("double")
    return v.feats.filter("kind = 'canopy'").select("feat_id", F.round(S.agb(S.dbh_from_volume(volume)), 4).alias("agb"))


@query(f", {CHAIN} SELECT count(*) AS n, round(max(abs(co2 - round(co2, 4))), 3) AS max_diff, max(abs(co2 - round(co2, 4))) <= 0.1 AS ok FROM co")
def cb_independent_check(v):
    stored = O.block_co2(v.carbon).select("block_id", F.col("co2_t").alias("stored"))
    again = v.carbon.withColumns(O.carbon_chain(F.col("canopy_m2"), F.col("height"))).join(stored, "block_id")
    gap = F.max(F.abs(F.col("co2_t") - F.col("stored")))
    return again.agg(F.count("*").alias("n"), F.round(gap, 3).alias("max_diff"), (gap <= 0.1).alias("ok"))


@query(f""", o AS (SELECT a.area_id, {over('a', 'f')} AS area FROM areas a JOIN feats f ON f.kind = 'canopy' AND {over('a', 'f')} > 0), s AS (SELECT area_id, CAST(sum(area) AS BIGINT) AS canopy FROM o GROUP BY area_id)
SELECT area_id, canopy, round(canopy / greatest(pi() * 9, 1.0) * 0.1066::DOUBLE * pow(30.0, 2.4572::DOUBLE) * 0.47::DOUBLE * (44.0::DOUBLE / 12.0) / 1000, 3) AS co2_t FROM s""")
def cb_study_area(v):
    o = P.overlaps(v.areas, v.feats.filter("kind = 'canopy'")).groupBy(F.col("a_area_id").alias("area_id")).agg(F.sum("area").cast("long").alias("canopy"))
    return o.select("area_id", "canopy", F.round(O.carbon_chain(F.col("canopy"), F.lit(10.0))["co2_t"], 3).alias("co2_t"))


WATER = "sqrt(pow(c.x - (w.x1 + {t} * (w.x2 - w.x1)), 2) + pow(c.y - (w.y1 + {t} * (w.y2 - w.y1)), 2))".format(t="least(greatest(((c.x - w.x1) * (w.x2 - w.x1) + (c.y - w.y1) * (w.y2 - w.y1)) / 2500.0, 0.0), 1.0)")


@query(f""", c AS (SELECT *, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y, (maxx - minx) * (maxy - miny) AS area FROM feats WHERE kind = 'canopy' AND NOT coalesce(landuse IN ('military', 'railway', 'quarry', 'landfill'), false)),
near AS (SELECT c.feat_id, min({WATER}) AS distance FROM c, water w GROUP BY c.feat_id),
d AS (SELECT c.*, 'PN_' || CAST(floor((y - 2000000) / 250) AS BIGINT) || '_' || CAST(floor((x - 300000) / 250) AS BIGINT) AS block_id FROM c WHERE area >= 500)
SELECT d.block_id, 'CAND_' || d.feat_id AS candidate_id, area, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y,
  CASE WHEN leisure IN ('park', 'garden') OR landuse = 'recreation_ground' THEN 'candidate_public_like_open_space' WHEN amenity = 'school' THEN 'context_dependent' ELSE 'candidate_other_open_space' END AS candidate_class, s.score, round(n.distance, 4) AS distance
FROM d JOIN near n ON n.feat_id = d.feat_id LEFT JOIN scored s ON s.block_id = d.block_id""")
def pl_candidates(v):
    """Open space without bad land use, of 500 m2 and more, with class, block, score and distance to water."""
    from ..operators.filters import split_land_use

    _, rest = split_land_use(v.feats.filter("kind = 'canopy'"))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    c = rest.withColumns({"area": area, "x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2}).filter("area >= 500")
    c = c.select(F.concat(F.lit("CAND_"), F.col("feat_id").cast("string")).alias("candidate_id"), "area", "x", "y", S.candidate_class(F.col("landuse"), F.col("leisure"), F.col("amenity")).alias("candidate_class"), P.block_name(P.cell(F.col("y"), P.Y0, 250), P.cell(F.col("x"), P.X0, 250)).alias("block_id"))
    near = P.nearest_distance(c.select("candidate_id", "x", "y"), v.water, "candidate_id").withColumn("distance", F.round("distance", 4))
    return c.join(v.scored.select("block_id", "score"), "block_id", "left").join(near, "candidate_id", "left")


@query("""SELECT f.feat_id, round(coalesce(CAST(count(CASE WHEN p.seg = 0 THEN 1 END) AS DOUBLE) / nullif(count(p.seg), 0), 0.0), 6) AS canopy, round(coalesce(CAST(count(CASE WHEN p.seg = 1 THEN 1 END) AS DOUBLE) / nullif(count(p.seg), 0), 0.0), 6) AS imperv
FROM feats f LEFT JOIN px p ON 300005 + p.c * 10 BETWEEN f.minx AND f.maxx AND 2000005 + p.r * 10 BETWEEN f.miny AND f.maxy GROUP BY f.feat_id""")
def pl_raster_fractions(v):
    centres = v.px.select("seg", (F.col("c") * 10 + 300005).alias("x"), (F.col("r") * 10 + 2000005).alias("y"))
    n = P.points_in(centres, v.feats.select("feat_id", "minx", "miny", "maxx", "maxy")).groupBy(F.col("b_feat_id").alias("feat_id")).agg(F.count_if(F.col("seg") == 0).alias("a"), F.count_if(F.col("seg") == 1).alias("b"), F.count("seg").alias("n"))
    share = lambda c: F.round(F.coalesce(F.try_divide(c, "n"), F.lit(0.0)), 6)
    return v.feats.select("feat_id").join(n, "feat_id", "left").select("feat_id", share("a").alias("canopy"), share("b").alias("imperv"))


LATTICE = """st AS (SELECT feat_id, minx, miny, maxx, maxy, CAST(ceil((maxx - minx - 5.0) / 10) AS BIGINT) AS nx, CAST(ceil((maxy - miny - 5.0) / 10) AS BIGINT) AS ny FROM feats),
lat AS (SELECT feat_id, minx + 5.0 + i * 10 AS x, miny + 5.0 + j * 10 AS y FROM (SELECT *, unnest(range(0, ny)) AS j FROM (SELECT *, unnest(range(0, nx)) AS i FROM st WHERE nx > 0) a WHERE ny > 0) b
  UNION ALL SELECT feat_id, (minx + maxx) / 2.0, (miny + maxy) / 2.0 FROM st WHERE (nx <= 0 OR ny <= 0) AND (maxx - minx) * (maxy - miny) >= 25)"""


@query(f", {LATTICE} SELECT feat_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM lat")
def pl_generate_units(v):
    return O.lattice(v.feats.select("feat_id", "minx", "miny", "maxx", "maxy"), 10).select("feat_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query()
def pl_enforce_spacing(v):
    return O.enforce_spacing(v.units.select("c_custkey", "x", "y"), "c_custkey", 60.0)


@query("SELECT unit_id, round(coalesce(CAST(value AS DOUBLE), 0.0) * CASE WHEN c_custkey % 2500 > 1000 OR c_custkey % 7 = 0 THEN 0.9 ELSE 1.0 END, 4) AS priority FROM units")
def pl_score_units(v):
    water = F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_custkey") % 2500)
    return v.units.select("unit_id", F.round(O.priority(F.col("value").cast("double"), water), 4).alias("priority"))


@query("""SELECT unit_id FROM (SELECT *, sum(cost) OVER (ORDER BY priority DESC, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (SELECT *, sum(area) OVER (ORDER BY priority DESC, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a
FROM (SELECT * FROM ranked ORDER BY priority DESC, unit_id LIMIT 1000) t) u WHERE a <= 30000) w WHERE c <= 120000""")
def pl_select_budget(v):
    return O.select_budget(v.ranked, 1000, 30000, 120000).select("unit_id")


@query("SELECT s.scenario, count(*) AS n, round(avg(priority), 4) AS mean, min(priority) AS lo FROM bridge s JOIN ranked r ON s.unit_id = r.unit_id GROUP BY s.scenario")
def pl_scenarios(v):
    return O.scenarios(v.ranked, {"a_100": 100, "b_250": 250, "c_500": 500, "d_none": 0}).select("scenario", "n", "mean", "lo")


@query("SELECT CAST((SELECT count(*) FROM units a JOIN units b ON a.c_custkey < b.c_custkey AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 10 - 0.0001) AS BIGINT) AS too_close, (SELECT count(*) FROM units WHERE segment IS NULL) AS unknown, (SELECT count(*) * 0.5::DOUBLE FROM units) AS carbon")
def pl_selection_qa(v):
    near = P.distance_pairs(v.units, "c_custkey", 10).filter(F.col("distance") <= 10 - 1e-4).agg(F.count("*").alias("too_close"))
    rest = v.units.agg(F.count_if(F.col("segment").isNull()).alias("unknown"), (F.count("*") * F.lit(0.5)).alias("carbon"))
    return near.crossJoin(rest)


def lonlat(v):
    lon, lat = 73.7 + (F.col("minx") - 300000) / 100000.0, 18.4 + (F.col("miny") - 2000000) / 100000.0
    return v.areas.select("area_id", lon.alias("west"), lat.alias("south"), (73.7 + (F.col("maxx") - 300000) / 100000.0).alias("east"), (18.4 + (F.col("maxy") - 2000000) / 100000.0).alias("north"))


TY = "(1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / pi()) / 2 * 65536"
TILES = f"""ll AS (SELECT area_id, 73.7::DOUBLE + (minx - 300000) / 100000.0 AS w, 18.4::DOUBLE + (miny - 2000000) / 100000.0 AS s, 73.7::DOUBLE + (maxx - 300000) / 100000.0 AS e, 18.4::DOUBLE + (maxy - 2000000) / 100000.0 AS n FROM areas),
tl AS (SELECT *, unnest(range(CAST(floor({TY.format(y='n')}) AS BIGINT), CAST(floor({TY.format(y='s')}) AS BIGINT) + 1)) AS ty FROM (SELECT *, unnest(range(CAST(floor((w + 180) / 360 * 65536) AS BIGINT), CAST(floor((e + 180) / 360 * 65536) AS BIGINT) + 1)) AS tx FROM ll) a)"""


@query(f", {TILES} SELECT area_id, tx, ty FROM tl")
def tile_assign(v):
    return O.tiles_of(lonlat(v), 16).select("area_id", "tx", "ty")


@query(f", {TILES} SELECT area_id, tx, ty, CAST(floor(((w + 180) / 360 * 65536 - tx) * 4096) AS BIGINT) AS qx, CAST(floor(({TY.format(y='s')} - ty) * 4096) AS BIGINT) AS qy FROM tl")
def tile_features(v):
    at = O.tiles_of(lonlat(v), 16)
    qx, qy = O.quantize(F.col("west"), F.col("south"), 16)
    return at.select("area_id", "tx", "ty", qx.alias("qx"), qy.alias("qy"))


@query("SELECT z, unit_id FROM (SELECT z, u.unit_id, row_number() OVER (PARTITION BY z ORDER BY u.unit_id) AS k FROM units u, (SELECT 12 + r_regionkey AS z FROM region) r WHERE z >= 14) t WHERE k <= 40")
def tile_units_zoom_gate(v):
    from ..operators.windows import cap_per_group

    at = v.units.select("unit_id", F.explode(F.array(*(F.lit(z) for z in range(12, 17)))).alias("z")).filter("z >= 14")
    return cap_per_group(at, ["z"], [F.col("unit_id")], 40).select("z", "unit_id")


@query(f", {TILES} SELECT tx, ty, count(*) AS n, CAST(sum(length(CAST(area_id AS VARCHAR)) + 16) AS BIGINT) AS bytes FROM tl GROUP BY tx, ty")
def tile_stats(v):
    return O.tiles_of(lonlat(v), 16).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum(F.length(F.col("area_id").cast("string")) + 16).alias("bytes"))
