"""Queries of scalar functions."""

import math

from pyspark.sql import functions as F

from ..functions import scalar as S
from .catalog import query


@query("SELECT l_orderkey, l_linenumber, red, round(CAST(nir - red AS DOUBLE) / (nir + red), 6) AS ndvi FROM obs")
def fn_ndvi(v):
    return v.obs.select("l_orderkey", "l_linenumber", "red", F.round(S.ndvi(F.col("nir"), F.col("red")), 6).alias("ndvi"))


@query("SELECT r, c, round((median(nir) - median(red)) / (median(nir) + median(red)), 6) AS ndvi FROM obs GROUP BY r, c")
def fn_ndvi_of_medians(v):
    m = v.obs.groupBy("r", "c").agg(F.median("nir").alias("nir"), F.median("red").alias("red"))
    return m.select("r", "c", F.round(S.ndvi(F.col("nir"), F.col("red")), 6).alias("ndvi"))


@query("SELECT dn, count(*) AS n, round(dn * 0.00341802::DOUBLE + 149.0 - 273.15, 4) AS celsius FROM obs GROUP BY dn")
def fn_lst_celsius(v):
    return v.obs.groupBy("dn").agg(F.count("*").alias("n")).select("dn", "n", F.round(S.lst_celsius(F.col("dn")), 4).alias("celsius"))


@query("SELECT CASE WHEN nd >= 35 THEN 0 WHEN nd < 10 THEN 1 WHEN nd IS NOT NULL THEN 2 END AS class, count(*) AS n FROM px GROUP BY 1")
def fn_ndvi_class(v):
    return v.px.groupBy(S.ndvi_class(F.col("nd"), 35, 10).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT r, c, round(CASE WHEN hi = lo THEN 0 ELSE CAST(te - lo AS DOUBLE) / (hi - lo) END, 6) AS norm FROM (SELECT r, c, te, min(te) OVER (PARTITION BY bi, bj) AS lo, max(te) OVER (PARTITION BY bi, bj) AS hi FROM px) t")
def fn_band_normalise(v):
    from ..operators.pixels import band_normalise

    return band_normalise(v.px, ["bi", "bj"], "te").select("r", "c", F.round("norm", 6).alias("norm"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 1000.0), 200000.0) AS x FROM orders")
def fn_clip(v):
    return v.orders.select("o_orderkey", S.clip(F.col("o_totalprice"), 1000.0, 200000.0).alias("x"))


@query("SELECT block_id, round(population_exposure / greatest(62500.0 / 10000, 0.01), 6) AS density FROM factors")
def fn_pop_density(v):
    return v.factors.select("block_id", F.round(S.pop_density(F.col("population_exposure"), F.lit(62500.0)), 6).alias("density"))


@query("SELECT unit_id, 'PN_' || CAST(floor((x - 300000) / 250) AS BIGINT) || '_' || CAST(floor((y - 2000000) / 250) AS BIGINT) AS by_index, 'PN_' || CAST(floor(x / 250) AS BIGINT) * 250 || '_' || CAST(floor(y / 250) AS BIGINT) * 250 AS by_corner FROM units")
def fn_block_id(v):
    return v.units.select("unit_id", S.block_id_index(F.col("x"), F.col("y"), 300000, 2000000).alias("by_index"), S.block_id_corner(F.col("x"), F.col("y")).alias("by_corner"))


@query("SELECT 'R' || lpad(CAST(bi AS VARCHAR), 2, '0') || '_C' || lpad(CAST(bj AS VARCHAR), 2, '0') AS pilot_id, round(73.8 + bj * (250 / (111320 * cos(radians(18.5)))), 8) AS west FROM blocks")
def fn_pilot_grid(v):
    dx = 250 / (111320 * math.cos(math.radians(18.5)))
    return v.blocks.select(S.pilot_id(F.col("bi"), F.col("bj")).alias("pilot_id"), F.round(73.8 + F.col("bj") * dx, 8).alias("west"))


@query("SELECT block_id, round(73.8 + bj * 0.01 - 500 / (111320.0 * cos(radians(18.4 + bi * 0.01))), 8) AS w, round(18.4 + bi * 0.01 - 500 / 111320.0, 8) AS s FROM blocks")
def fn_bounds_from_point(v):
    w, s, _, _ = S.bounds_from_point(73.8 + F.col("bj") * 0.01, 18.4 + F.col("bi") * 0.01, 500)
    return v.blocks.select("block_id", F.round(w, 8).alias("w"), F.round(s, 8).alias("s"))


@query()
def fn_utm43n(v):
    x, y = S.utm43n(73.7 + F.col("x") % 1000 / 3000, 18.4 + F.col("y") % 1000 / 3000)
    return v.units.select("unit_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query("SELECT unit_id, CAST(x + 70000 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM units")
def fn_wgs84(v):
    """There and back again."""
    lon, lat = S.wgs84(F.col("x") + 70000.0, F.col("y").cast("double"))
    there = v.units.select("unit_id", lon.alias("lon"), lat.alias("lat"))
    x, y = S.utm43n(F.col("lon"), F.col("lat"))
    return there.select("unit_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT unit_id, CAST(floor((73.7 + x % 1000 / 3000.0 + 180) / 360 * 16384) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(18.4 + y % 1000 / 3000.0)) + 1 / cos(radians(18.4 + y % 1000 / 3000.0))) / pi()) / 2 * 16384) AS BIGINT) AS ty FROM units")
def fn_web_mercator_tile(v):
    tx, ty = S.tile_xy(73.7 + F.col("x") % 1000 / 3000, 18.4 + F.col("y") % 1000 / 3000, 14)
    return v.units.select("unit_id", tx.alias("tx"), ty.alias("ty"))


def rings(v):
    return v.feats.select("feat_id", "minx", "miny", "maxx", "maxy", S.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("ring"))


@query("SELECT feat_id, CAST((maxx - minx) * (maxy - miny) AS DOUBLE) AS area, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM feats")
def fn_polygon_area(v):
    """Areas and centroids by the shoelace sum, with the ring moved to its corner so that no digits are lost."""
    moved = rings(v).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] - F.col("minx")).alias("x"), (p["y"] - F.col("miny")).alias("y"))))
    cx, cy = S.ring_centroid(F.col("ring"))
    return moved.select("feat_id", S.ring_area(F.col("ring")).alias("area"), F.round(cx + F.col("minx"), 6).alias("cx"), F.round(cy + F.col("miny"), 6).alias("cy"))


@query("SELECT unit_id, 32 AS points, round(16 * sin(2 * pi() / 32) * 10000, 4) AS area FROM units")
def fn_circle_polygon(v):
    ring = S.circle(F.col("x") - F.col("x"), F.col("y") - F.col("y"), 100.0)
    return v.units.select("unit_id", F.size(ring).alias("points"), F.round(S.ring_area(ring), 4).alias("area"))


@query("SELECT f.feat_id, b.block_id, round(CAST(greatest(least(f.maxx, b.maxx) - greatest(f.minx, b.minx), 0) * greatest(least(f.maxy, b.maxy) - greatest(f.miny, b.miny), 0) AS DOUBLE), 4) AS area FROM feats f JOIN blocks b ON least(f.maxx, b.maxx) > greatest(f.minx, b.minx) AND least(f.maxy, b.maxy) > greatest(f.miny, b.miny)")
def fn_clip_area(v):
    from ..functions.clip import clip_area
    from ..operators.spatial import overlaps

    f = rings(v).select("feat_id", "ring", "minx", "miny", "maxx", "maxy")
    both = overlaps(f, v.blocks.select("block_id", "minx", "miny", "maxx", "maxy"))
    box = [F.col(f"b_{c}").cast("double") for c in ("minx", "miny", "maxx", "maxy")]
    return both.select(F.col("a_feat_id").alias("feat_id"), F.col("b_block_id").alias("block_id"), F.round(clip_area(F.col("a_ring"), *box), 4).alias("area"))


PT = "printf('%d.000 %d.000', {x}, {y})"


@query("SELECT feat_id, sha256('POLYGON ((' || " + " || ', ' || ".join(PT.format(x=x, y=y) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))) + " || '))') AS hash FROM feats")
def fn_geom_hash(v):
    return rings(v).select("feat_id", S.geom_hash(F.col("ring")).alias("hash"))


@query()
def fn_uuid5(v):
    return v.units.select("unit_id", S.uuid5("49e464c3-0db8-5061-a5ff-945f95238334", F.col("unit_id")).alias("uuid"))


@query("SELECT unit_id, md5(printf('%.4f,%.4f', y / 1000.0, x / 1000.0)) AS cache_key FROM units")
def fn_cache_key(v):
    return v.units.select("unit_id", S.cache_key(F.col("y") / 1000.0, F.col("x") / 1000.0).alias("cache_key"))


@query("SELECT feat_id, (maxx - minx) * 100 / 20.0 AS dbh FROM feats")
def fn_dbh_from_crown(v):
    return v.feats.select("feat_id", S.dbh_from_crown(F.col("maxx") - F.col("minx")).alias("dbh"))


@query("SELECT feat_id, round(cbrt(6.0 * (maxx - minx) / pi()) * 5, 6) AS sphere, round(2 * sqrt(3.0 * (maxx - minx) / (pi() * 8)) * 5, 6) AS cone FROM feats")
def fn_dbh_from_volume(v):
    w = (F.col("maxx") - F.col("minx")).cast("double")
    return v.feats.select("feat_id", F.round(S.dbh_from_volume(w), 6).alias("sphere"), F.round(S.dbh_from_volume(w, shape="cone"), 6).alias("cone"))


@query("SELECT feat_id, round(0.1066::DOUBLE * pow(maxx - minx, 2.4572::DOUBLE), 4) AS urban, round(0.0346::DOUBLE * pow(maxx - minx, 2.9451::DOUBLE), 4) AS temperate FROM feats")
def fn_agb(v):
    w = (F.col("maxx") - F.col("minx")).cast("double")
    return v.feats.select("feat_id", F.round(S.agb(w), 4).alias("urban"), F.round(S.agb(w, "temperate_jenkins"), 4).alias("temperate"))


@query("SELECT block_id, round(canopy_m2 * 0.47::DOUBLE * (44.0::DOUBLE / 12.0) / 1000, 6) AS co2 FROM carbon")
def fn_co2(v):
    return v.carbon.select("block_id", F.round(S.co2(F.col("canopy_m2")), 6).alias("co2"))


@query("SELECT block_id, CASE WHEN canopy_m2 / 62500 <= 0.0001 THEN 0.0 ELSE round(least(greatest(3 + 12 * (canopy_m2 / 62500), 0.0), 15.0), 6) END AS height FROM carbon")
def fn_height_fallback(v):
    return v.carbon.select("block_id", F.round(S.height_fallback(F.col("canopy_m2") / 62500), 6).alias("height"))


@query("SELECT block_id, round(height / (block_area / 10000), 6) AS density FROM carbon")
def fn_density_per_ha(v):
    return v.carbon.select("block_id", F.round(S.density_per_ha(F.col("height"), F.col("block_area")), 6).alias("density"))


@query("""SELECT s.block_id, CASE WHEN score < 25 THEN 'Critical' WHEN score < 50 THEN 'High' WHEN score < 75 THEN 'Moderate' WHEN score IS NOT NULL THEN 'Low' ELSE 'Unscored' END AS tier, CASE
  WHEN score IS NULL THEN 'Unscored block — excluded from baseline evaluation (e.g. water body, quarry, or data gap).'
  WHEN score < 25 THEN 'Critical Ecological Need: Score ' || printf('%.1f', floor(score)) || ' reflects severe vegetative deficit with High impervious cover and ' || printf('%.1f°C', height) || ' surface temperature.'
  WHEN score < 50 THEN 'High Intervention Need: Score ' || printf('%.1f', floor(score)) || ' indicates high thermal and vegetative vulnerability (tree density: Low, population heat exposure: 0.00).'
  WHEN score < 75 THEN 'Moderate Stress: Score ' || printf('%.1f', floor(score)) || ' with canopy baseline of ' || printf('%.0f m²', canopy_m2) || '. Secondary candidate for selective canopy infill.'
  ELSE 'Low Need / Stable: Score ' || printf('%.1f', floor(score)) || ' indicates preserved vegetation (' || printf('%.1f t CO₂e', height) || ' standing carbon). Priority is canopy conservation.' END AS text FROM scored s JOIN carbon c ON s.block_id = c.block_id""")
def fn_need_text(v):
    made = v.scored.join(v.carbon.select("block_id", "canopy_m2", "height"), "block_id")
    none = F.lit(None).cast("double")
    text = S.need_text(F.floor("score").cast("double"), none, F.col("height"), none, none, F.col("canopy_m2"), F.col("height"))
    return made.select("block_id", S.need_tier(F.col("score")).alias("tier"), text.alias("text"))


@query("""SELECT feat_id, CASE WHEN leisure IN ('park', 'garden') OR landuse = 'recreation_ground' THEN 'Public Like Open Space' WHEN amenity = 'school' THEN 'Context-dependent' ELSE 'Other open space' END AS label FROM feats""")
def fn_class_display(v):
    return v.feats.select("feat_id", S.class_display(S.candidate_class(F.col("landuse"), F.col("leisure"), F.col("amenity"))).alias("label"))


@query("SELECT CASE WHEN leisure IN ('park', 'garden') OR landuse = 'recreation_ground' THEN 'candidate_public_like_open_space' WHEN amenity = 'school' THEN 'context_dependent' ELSE 'candidate_other_open_space' END AS class, count(*) AS n FROM feats GROUP BY 1")
def fn_candidate_class(v):
    return v.feats.groupBy(S.candidate_class(F.col("landuse"), F.col("leisure"), F.col("amenity")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT feat_id, concat_ws(';', 'landuse=' || landuse, 'leisure=' || leisure, 'amenity=' || amenity) AS source FROM feats")
def fn_source_landuse(v):
    return v.feats.select("feat_id", S.source_landuse(F.col("landuse"), F.col("leisure"), F.col("amenity")).alias("source"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first FROM part")
def fn_list_first(v):
    return v.part.select("p_partkey", F.try_element_at(F.split("p_name", " "), F.lit(1)).alias("first"))


@query("SELECT event_id, CASE WHEN length(props->>'$.k') <= 2 THEN props->>'$.k' END AS k FROM activity")
def fn_json_allow(v):
    return v.activity.select("event_id", F.try_element_at(S.allowed_keys(F.col("props"), ["k"], 2), F.lit("k")).alias("k"))


@query("SELECT unit_id, CASE WHEN c_custkey % 4 <> 3 THEN CAST(x AS DOUBLE) END AS x, CASE WHEN c_custkey % 4 <> 3 THEN CAST(y AS DOUBLE) END AS y FROM units")
def fn_parse_point(v):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.format_string("POINT(%d %d)", "x", "y")).when(k == 1, F.format_string("SRID=32643;POINT (%d %d)", "x", "y")).when(k == 2, F.format_string('{"type":"Point","coordinates":[%d,%d]}', "x", "y")).otherwise(F.format_string("SRID=4326;POINT(%d %d)", "x", "y"))
    return v.units.select("unit_id", S.parse_point(text).alias("p")).select("unit_id", "p.x", "p.y")


@query("SELECT mon, count(*) AS n, min(date_trunc('month', ts)) = date_trunc('month', min(ts)) AS same FROM obs GROUP BY mon")
def fn_month(v):
    return v.obs.groupBy(F.month("ts").alias("mon")).agg(F.count("*").alias("n"), (F.min(F.date_trunc("month", "ts")) == F.date_trunc("month", F.min("ts"))).alias("same"))


@query("SELECT DISTINCT r - r % 25 AS top, c - c % 25 AS \"left\" FROM px")
def fn_patch_parse(v):
    name = F.concat(F.lit("patch_"), (F.col("r") - F.col("r") % 25).cast("string"), F.lit("_"), (F.col("c") - F.col("c") % 25).cast("string"))
    top, left = S.patch_corner(F.col("name"))
    return v.px.select(name.alias("name")).distinct().select(top.cast("long").alias("top"), left.cast("long").alias("left"))
