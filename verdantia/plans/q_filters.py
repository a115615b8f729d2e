"""Queries of filters, validators and projections."""

from pyspark.sql import functions as F

from ..operators import filters as O
from .catalog import query

YEAR = ("1995-01-01", "1996-01-01")


@query("SELECT cloud, count(*) AS n FROM obs WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01' AND cloud < 10 GROUP BY cloud")
def flt_cloud_scene(v):
    return O.cloud_scenes(v.obs, *YEAR, 10).groupBy("cloud").agg(F.count("*").alias("n"))


@query("SELECT '1990-01-01/2005-01-01' AS date_used, count(*) AS n FROM obs WHERE ts >= TIMESTAMP '1990-01-01' AND ts < TIMESTAMP '2005-01-01' AND cloud < 20")
def flt_widen_window(v):
    return O.widen_window(v.obs, ("1950-01-01", "1951-01-01"), ("1990-01-01", "2005-01-01"), 20).groupBy("date_used").agg(F.count("*").alias("n"))


@query("SELECT scl, count(*) AS n FROM obs WHERE scl IN (4, 5, 6, 7) GROUP BY scl")
def flt_scl_mask(v):
    return O.scl_mask(v.obs).groupBy("scl").agg(F.count("*").alias("n"))


@query("SELECT qa, count(*) AS n FROM obs WHERE (qa & 8) = 0 AND (qa & 16) = 0 GROUP BY qa")
def flt_qa_bits(v):
    return O.qa_bits(v.obs).groupBy("qa").agg(F.count("*").alias("n"))


@query("SELECT te, count(*) AS n FROM obs WHERE te > 300 AND te < 400 AND people >= 0 GROUP BY te")
def flt_valid_range(v):
    return O.valid_range(O.valid_range(v.obs, "te", 300, 400), "people", 0, inclusive=True).groupBy("te").agg(F.count("*").alias("n"))


@query("SELECT block_id, count(*) AS n FROM px WHERE inside = 1 GROUP BY block_id")
def flt_boundary_mask(v):
    return O.boundary_mask(v.px.select("r", "c", "block_id"), v.px.select("r", "c", "inside")).groupBy("block_id").agg(F.count("*").alias("n"))


@query("SELECT block_id, pixels FROM blocks WHERE pixels >= 0.98 * (SELECT median(pixels) FROM blocks)")
def flt_edge_cells(v):
    return O.edge_cells(v.blocks, 0.98, "pixels").select("block_id", "pixels")


@query("SELECT block_id, score FROM scored WHERE minx <= 301000 AND maxx >= 300500 AND miny <= 2001500 AND maxy >= 2000800 ORDER BY block_id LIMIT 12")
def flt_bbox_viewport(v):
    return O.viewport(v.scored, 300500, 2000800, 301000, 2001500, 12).select("block_id", "score")


@query("SELECT unit_id, x BETWEEN 300500 AND 302000 AND y BETWEEN 2000100 AND 2002500 AS inside FROM units")
def flt_coverage_bounds(v):
    return v.units.select("unit_id", O.inside_bounds(F.col("x"), F.col("y"), 300500, 2000100, 302000, 2002500).alias("inside"))


@query("SELECT kind, count(*) AS n FROM feats WHERE kind IN ('building', 'canopy') GROUP BY kind")
def flt_geom_type(v):
    return v.feats.filter(F.col("kind").isin("building", "canopy")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT coalesce(landuse IN ('military', 'railway', 'quarry', 'landfill'), false) AS excluded, count(*) AS n FROM feats GROUP BY 1")
def flt_incompatible_landuse(v):
    bad, rest = O.split_land_use(v.feats)
    return bad.withColumn("excluded", F.lit(True)).unionByName(rest.withColumn("excluded", F.lit(False))).groupBy("excluded").agg(F.count("*").alias("n"))


@query("SELECT feat_id, (maxx - minx) * (maxy - miny) AS area FROM feats WHERE (maxx - minx) * (maxy - miny) >= 1000")
def flt_min_area(v):
    return O.valid_range(v.feats.withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))), "area", 1000, inclusive=True).select("feat_id", "area")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 37 = 0)")
def flt_patch_pairs(v):
    key = F.col("l_orderkey").alias("o_orderkey")
    return O.patch_pairs(v.orders, v.lineitem.select(key), v.lineitem.filter("l_partkey % 37 = 0").select(key), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("""SELECT area_id, CASE WHEN area_id % 9 = 4 THEN 'malformed' WHEN area_id % 5 = 0 THEN 'not_polygon' WHEN maxx > 302300 OR maxy > 2002500 THEN 'out_of_bounds' WHEN (maxx - minx) * (maxy - miny) > 600000 THEN 'too_large' END AS reason,
  CASE WHEN area_id % 9 = 4 OR area_id % 5 = 0 OR maxx > 302300 OR maxy > 2002500 OR (maxx - minx) * (maxy - miny) > 600000 THEN 'rejected' ELSE 'ok' END AS status FROM areas""")
def val_study_area(v):
    made = v.areas.withColumn("kind", F.when(F.col("area_id") % 5 == 0, "Point").otherwise("Polygon")).withColumn("minx", F.when(F.col("area_id") % 9 != 4, F.col("minx")))
    return O.study_area_status(made, (300000, 2000000, 302300, 2002500), 0.6).select("area_id", "reason", "status")


@query("SELECT o_orderkey, o_totalprice BETWEEN 10 AND 50000 AS ok FROM orders")
def val_radius(v):
    return v.orders.select("o_orderkey", O.radius_ok(F.col("o_totalprice")).alias("ok"))


@query("SELECT p_partkey, p_size - 20 BETWEEN 0 AND 22 AND p_partkey % 5000 - 10 >= 0 AND p_partkey % 5000 - 10 < pow(2, p_size - 20) AND p_partkey % 777 < pow(2, p_size - 20) AS ok FROM part")
def val_tile_coord(v):
    return v.part.select("p_partkey", O.tile_ok(F.col("p_size") - 20, F.col("p_partkey") % 5000 - 10, F.col("p_partkey") % 777).alias("ok"))


@query("SELECT p_name, regexp_full_match(p_name, '[A-Za-z0-9_-]{1,50}') AS ok FROM part UNION ALL SELECT block_id, true FROM blocks")
def val_block_id(v):
    names = v.part.select("p_name").unionAll(v.blocks.select("block_id"))
    return names.select("p_name", O.block_id_ok(F.col("p_name")).alias("ok"))


FACTORS = ["ndvi", "tree_density", "pm25", "temperature", "impervious_surfaces", "population_exposure"]


@query("SELECT " + ", ".join(f"CAST(count(CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 1 END) AS BIGINT) AS {c}" for c in FACTORS) + " FROM factors")
def val_factor_complete(v):
    return O.incomplete(v.factors, FACTORS)


@query("SELECT CAST(count(CASE WHEN block_id LIKE '%_3' THEN 1 END) AS BIGINT) AS missing, count(CASE WHEN block_id LIKE '%_3' THEN 1 END) = 0 AS ok FROM factors")
def val_pm25_present(v):
    return O.pm25_problem(v.factors.withColumn("pm25", F.when(~F.col("block_id").endswith("_3"), F.col("pm25"))))


@query("SELECT abs(sum(0.2) - 1) < 1e-6 AS sums_to_one, bool_and(0.2 >= 0 AND 0.2 <= 1) AS in_range, bool_and(CASE WHEN r_regionkey = 4 THEN 'sideways' ELSE 'positive' END IN ('positive', 'negative')) AS directions_known FROM region")
def val_config(v):
    made = v.region.select(F.col("r_name").alias("factor"), F.lit(0.2).alias("weight"), F.when(F.col("r_regionkey") == 4, "sideways").otherwise("positive").alias("direction"))
    return O.config_problem(made)


@query("SELECT count(DISTINCT [maxx - minx, maxy - miny]) <= 1 AS aligned, count(*) AS layers FROM blocks")
def val_grid_alignment(v):
    return O.aligned(v.blocks.select((F.col("maxx") - F.col("minx")).alias("w"), (F.col("maxy") - F.col("miny")).alias("h")), ["w", "h"])


@query("""SELECT count(*) AS features, CAST(count(*) AS BIGINT) AS valid, CAST(0 AS BIGINT) AS empty, CAST(sum((maxx - minx) * (maxy - miny)) AS BIGINT) AS area_m2, count(ward_id) - count(DISTINCT ward_id) AS repeated_ids,
  CAST(count(*) - count(name) AS BIGINT) AS missing_names FROM wards""")
def val_boundary_report(v):
    return O.boundary_report(v.wards)


@query("""SELECT count(block_id) - count(DISTINCT block_id) AS repeated_ids, count(CASE WHEN canopy_m2 < 0 THEN 1 END) AS negative_canopy, count(CASE WHEN canopy_m2 > 62501 THEN 1 END) AS canopy_above_block,
  count(CASE WHEN NOT (canopy_m2 / block_area BETWEEN 0 AND 1.01) THEN 1 END) AS fraction, count(CASE WHEN height < 0 THEN 1 END) AS negative_height FROM carbon""")
def val_carbon_invariants(v):
    return O.carbon_violations(v.carbon)


@query("""SELECT event_id, coalesce(event_type IN ('click', 'view', 'purchase', 'signup') AND length(repeat('t', CAST(event_id % 130 AS BIGINT))) BETWEEN 1 AND 120, false) AS ok, least(event_id % 400, 300) AS described FROM activity""")
def val_activity_event(v):
    n = F.col("event_id").cast("int")
    made = v.activity.withColumns({"title": F.repeat(F.lit("t"), n % 130), "description": F.repeat(F.lit("d"), n % 400)})
    return O.activity_status(made, ("click", "view", "purchase", "signup")).select("event_id", "ok", F.length("description").cast("long").alias("described"))


@query("SELECT event_type <> 'purchase' OR role IN ('researcher', 'admin') AS accepted, count(*) AS n FROM activity GROUP BY 1")
def flt_role(v):
    roles = v.activity.select("user_id", "role").distinct()
    yes, no = O.planting_roles(v.activity.drop("role"), roles, "purchase")
    return yes.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False))).groupBy("accepted").agg(F.count("*").alias("n"))


@query("SELECT CASE seg WHEN 0 THEN 'canopy' WHEN 1 THEN 'impervious' WHEN 2 THEN 'pervious' WHEN 3 THEN 'water' END AS label, count(*) AS n FROM px GROUP BY 1")
def prj_class_label(v):
    return v.px.groupBy(O.lookup(F.col("seg").cast("int"), O.SEGMENTATION).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CASE scl WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 6 THEN 1 WHEN 0 THEN 3 END AS target, count(*) AS n FROM obs GROUP BY 1")
def prj_class_remap(v):
    return v.obs.groupBy(O.lookup(F.col("scl").cast("int"), {1: 0, 2: 2, 4: 2, 6: 1, 0: 3}).alias("target")).agg(F.count("*").alias("n"))


@query("SELECT s.block_id, s.score, round(f.ndvi, 6) AS ndvi, c.canopy_m2, 'entropy' AS method FROM scored s LEFT JOIN factors f ON s.block_id = f.block_id LEFT JOIN carbon c ON s.block_id = c.block_id WHERE s.block_id = 'PN_3_4'")
def prj_block_detail(v):
    one = v.scored.filter("block_id = 'PN_3_4'").select("block_id", "score")
    made = one.join(v.factors, "block_id", "left").join(v.carbon, "block_id", "left")
    made = made.select("block_id", "score", F.struct(F.round("ndvi", 6).alias("ndvi")).alias("factors"), F.struct("canopy_m2").alias("carbon"), F.struct(F.lit("entropy").alias("method")).alias("methodology"))
    return made.select("block_id", "score", "factors.ndvi", "carbon.canopy_m2", "methodology.method")


@query("SELECT block_id, minx, miny, score, CASE WHEN score < 25 THEN 'Critical' WHEN score < 50 THEN 'High' WHEN score < 75 THEN 'Moderate' WHEN score IS NOT NULL THEN 'Low' END AS risk FROM scored WHERE bi = 5")
def prj_public_detail(v):
    from ..operators.scoring import risk_level

    return v.scored.filter("bi = 5").select("block_id", "minx", "miny", "score", risk_level(F.col("score")).alias("risk"))


@query("SELECT feat_id, coalesce(landuse, 'unknown') AS landuse, coalesce(leisure, 'unknown') AS leisure FROM feats")
def prj_coalesce_unknown(v):
    return v.feats.select("feat_id", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("landuse", "leisure")))


@query("""SELECT feat_id, CASE WHEN leisure = 'park' THEN 'Landmark' WHEN leisure = 'garden' THEN 'Garden' WHEN landuse IS NULL THEN 'Place'
  ELSE upper(landuse[1]) || landuse[2:] END AS kind FROM feats""")
def prj_result_type(v):
    return v.feats.select("feat_id", O.result_type(F.coalesce("leisure", "landuse")).alias("kind"))
