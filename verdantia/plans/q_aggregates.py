"""Queries of aggregates."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import spatial as O
from .catalog import query
from .q_joins import TOUCH, over, pixel_boxes


@query("SELECT block_id, round(CAST(count(CASE WHEN seg = 0 THEN 1 END) AS DOUBLE) / count(seg), 6) AS frac, count(CASE WHEN seg = 0 THEN 1 END) AS hits, count(seg) AS valid, round(CAST(count(seg) AS DOUBLE) / count(*), 6) AS completeness FROM px GROUP BY block_id")
def agg_zonal_fraction(v):
    return A.zonal_fraction(v.px, "block_id", F.col("seg") == 0, F.col("seg").isNotNull()).select("block_id", F.round("frac", 6).alias("frac"), "hits", "valid", F.round("completeness", 6).alias("completeness"))


@query("""SELECT block_id, count(CASE WHEN seg = 1 THEN 1 END) AS n_seg, count(CASE WHEN bldg = 1 THEN 1 END) AS n_bldg, count(CASE WHEN road = 1 THEN 1 END) AS n_road, count(CASE WHEN seg = 1 OR bldg = 1 OR road = 1 THEN 1 END) AS n_union,
  count(coalesce(seg, bldg, road)) AS n_valid, round(CAST(count(CASE WHEN seg = 1 OR bldg = 1 OR road = 1 THEN 1 END) AS DOUBLE) / count(coalesce(seg, bldg, road)), 6) AS frac, true AS holds FROM px GROUP BY block_id""")
def agg_zonal_union(v):
    return A.zonal_union(v.px, "block_id").withColumn("frac", F.round("frac", 6))


@query("SELECT block_id, round(avg(nd), 6) AS mean, count(nd) AS valid, round(CAST(count(nd) AS DOUBLE) / count(*), 6) AS completeness FROM px GROUP BY block_id")
def agg_zonal_mean(v):
    return A.zonal_mean(v.px, "block_id", "nd").select("block_id", F.round("mean", 6).alias("mean"), "valid", F.round("completeness", 6).alias("completeness"))


@query(f", {TOUCH} SELECT tblock AS block_id, round(avg(te), 2) AS mean, count(te) AS valid FROM touch GROUP BY tblock")
def agg_zonal_mean_touched(v):
    return A.zonal_mean(O.touched_blocks(pixel_boxes(v).drop("block_id")), "block_id", "te").select("block_id", F.round("mean", 2).alias("mean"), "valid")


@query(f", {TOUCH} SELECT tblock AS block_id, CAST(sum(people) AS BIGINT) AS people FROM touch GROUP BY tblock")
def agg_zonal_sum_touched(v):
    return O.touched_blocks(pixel_boxes(v).drop("block_id")).groupBy("block_id").agg(F.sum("people").alias("people"))


@query("SELECT block_id, CAST(sum(inside) AS BIGINT) AS n FROM px GROUP BY block_id")
def agg_boundary_count(v):
    return v.px.groupBy("block_id").agg(F.count_if(F.col("inside") == 1).alias("n"))


@query("SELECT r, c, median(te) AS median FROM obs WHERE nodata = 0 GROUP BY r, c")
def agg_temporal_median(v):
    return A.temporal_median(v.obs.filter("nodata = 0"), "te")


@query("SELECT r, c, seg AS mode FROM (SELECT r, c, seg, row_number() OVER (PARTITION BY r, c ORDER BY count(*) DESC, seg) AS k FROM obs WHERE nodata = 0 GROUP BY r, c, seg) t WHERE k = 1")
def agg_temporal_mode(v):
    return A.temporal_mode(v.obs.filter("nodata = 0"), "seg")


@query("SELECT gr, gc, CASE WHEN count(*) = 3 THEN round(avg(m), 6) END AS mean, count(*) AS months FROM (SELECT r % 30 AS gr, c % 30 AS gc, mon, avg(te) AS m FROM obs WHERE mon IN (1, 2, 3) AND nodata = 0 GROUP BY 1, 2, mon) t GROUP BY gr, gc")
def agg_seasonal_strict(v):
    coarse = v.obs.filter("nodata = 0").withColumns({"gr": F.col("r") % 30, "gc": F.col("c") % 30})
    return A.seasonal_strict(coarse, ["gr", "gc"], "te").select("gr", "gc", F.round("mean", 6).alias("mean"), "months")


@query("SELECT seg, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM px WHERE seg IS NOT NULL GROUP BY seg")
def agg_class_balance(v):
    return A.class_balance(v.px, "seg").withColumn("pct", F.round("pct", 6))


@query("SELECT block_id, count(DISTINCT seg) AS classes, max(CASE WHEN seg = 3 THEN 1 ELSE 0 END) = 1 AS has_water FROM px GROUP BY block_id")
def agg_class_presence(v):
    return v.px.groupBy("block_id").agg(F.count_distinct("seg").alias("classes"), F.array_contains(F.collect_set("seg"), F.lit(3).cast("long")).alias("has_water"))


@query(""", pt AS (SELECT seg, c, unnest(range(greatest(CAST(ceil((r - 63) / 32) AS BIGINT), 0), CAST(floor(r / 32) AS BIGINT) + 1)) * 32 AS top FROM px), pl AS (SELECT seg, top, unnest(range(greatest(CAST(ceil((c - 63) / 32) AS BIGINT), 0), CAST(floor(c / 32) AS BIGINT) + 1)) * 32 AS "left" FROM pt)
SELECT top, "left", round(avg(CASE WHEN seg IS NULL THEN 1 ELSE 0 END), 6) AS nodata, count(*) AS n FROM pl GROUP BY top, "left" HAVING avg(CASE WHEN seg IS NULL THEN 1 ELSE 0 END) <= 0.3""")
def agg_patch_nodata(v):
    return A.patch_nodata(v.px, "seg", 64, 32).withColumn("nodata", F.round("nodata", 6))


@query("SELECT seg, bldg, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct_all, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY seg), 6) AS pct_row FROM (SELECT seg, bldg, count(*) AS n FROM px WHERE seg IS NOT NULL AND bldg IS NOT NULL GROUP BY seg, bldg) t")
def agg_crosswalk(v):
    return A.crosswalk(v.px, "seg", "bldg").select("seg", "bldg", "n", F.round("pct_all", 6).alias("pct_all"), F.round("pct_row", 6).alias("pct_row"))


@query("SELECT median(CASE WHEN seg = 1 THEN te END) AS median FROM px")
def agg_conditional_median(v):
    return v.px.agg(F.median(F.when(F.col("seg") == 1, F.col("te"))).alias("median"))


@query(f""", p AS (SELECT a.area_id, s.score, {over('a', 's')} AS area FROM areas a JOIN scored s ON {over('a', 's')} > 0)
SELECT area_id, count(*) AS blocks, count(score) AS scored, count(CASE WHEN score < 25 THEN 1 END) AS critical, count(CASE WHEN score >= 25 AND score < 50 THEN 1 END) AS high, count(CASE WHEN score >= 50 AND score < 75 THEN 1 END) AS moderate, count(CASE WHEN score >= 75 THEN 1 END) AS low,
  CAST(sum(area) AS BIGINT) AS eligible_m2, CAST(sum(CASE WHEN score IS NOT NULL THEN area END) AS BIGINT) AS scored_m2, round(sum(score * area) / sum(CASE WHEN score IS NOT NULL THEN area END), 4) AS weighted_score FROM p GROUP BY area_id""")
def agg_study_area(v):
    pairs = O.overlaps(v.areas, v.scored).select(F.col("a_area_id").alias("area_id"), F.col("b_score").alias("score"), "area")
    return A.study_area(pairs, "area_id")


@query("""SELECT blocks, scored, mean_score, canopy_m2, round(canopy_m2 / (canopy_m2 / 10000) , 4) AS check_ratio, round(canopy_m2 / 10000 / (blocks * 6.25), 6) AS canopy_ha_per_gross_ha FROM
(SELECT count(*) AS blocks, count(score) AS scored, round(avg(score), 6) AS mean_score FROM scored) a, (SELECT sum(canopy_m2) AS canopy_m2 FROM carbon) b""")
def agg_city_summary(v):
    a = v.scored.agg(F.count("*").alias("blocks"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean_score"))
    b = v.carbon.agg(F.sum("canopy_m2").alias("canopy_m2"))
    ha = F.col("canopy_m2") / 10000
    return a.crossJoin(b).select("*", F.round(F.try_divide(F.col("canopy_m2"), ha), 4).alias("check_ratio"), F.round(ha / (F.col("blocks") * 6.25), 6).alias("canopy_ha_per_gross_ha"))


@query("SELECT a.area_id, count(*) AS units, round(avg(u.value), 4) AS mean_value, count(CASE WHEN u.segment = 'BUILDING' THEN 1 END) AS building FROM areas a JOIN units u ON u.x BETWEEN a.minx AND a.maxx AND u.y BETWEEN a.miny AND a.maxy GROUP BY a.area_id")
def agg_unit_filter_summary(v):
    both = O.points_in(v.units.drop("area_id"), v.areas).select(F.col("b_area_id").alias("area_id"), "value", "segment")
    base = both.groupBy("area_id").agg(F.count("*").alias("units"), F.round(F.avg("value"), 4).alias("mean_value"))
    by = A.counts_map(both, ["area_id"], "segment", "segments")
    return base.join(by, "area_id").select("area_id", "units", "mean_value", F.coalesce(F.try_element_at("segments", F.lit("BUILDING")), F.lit(0)).alias("building"))


@query("""SELECT s.scenario, count(*) AS n, round(avg(priority), 4) AS mean, round(stddev_samp(priority), 4) AS sd, min(priority) AS lo, round(quantile_cont(priority, 0.25), 4) AS q1, round(quantile_cont(priority, 0.5), 4) AS q2, round(quantile_cont(priority, 0.75), 4) AS q3, max(priority) AS hi, count(*) * 0.5::DOUBLE AS carbon
FROM bridge s JOIN ranked r ON s.unit_id = r.unit_id GROUP BY s.scenario""")
def agg_scenario_stats(v):
    from ..operators.planting import scenario_stats

    return scenario_stats(v.bridge.join(v.ranked, "unit_id"), "priority")


@query("SELECT s.scenario, count(b.unit_id) AS units FROM scen s LEFT JOIN bridge b ON s.scenario = b.scenario GROUP BY s.scenario")
def agg_scenario_counts(v):
    return v.scen.select("scenario").join(v.bridge, "scenario", "left").groupBy("scenario").agg(F.count("unit_id").alias("units"))


@query(f", {TOUCH} SELECT tblock AS block_id, CAST(count(CASE WHEN seg = 0 THEN 1 END) * 100 AS BIGINT) AS touched_m2, count(CASE WHEN seg = 0 THEN 1 END) AS canopy, count(seg) AS valid FROM touch GROUP BY tblock")
def agg_canopy_by_block(v):
    at = O.touched_blocks(pixel_boxes(v).drop("block_id"))
    return at.groupBy("block_id").agg((F.count_if(F.col("seg") == 0) * 100).alias("touched_m2"), F.count_if(F.col("seg") == 0).alias("canopy"), F.count("seg").alias("valid"))


@query(f"SELECT b.block_id, CAST(sum({over('f', 'b')}) AS BIGINT) AS area, count(*) AS n FROM feats f JOIN blocks b ON {over('f', 'b')} > 0 GROUP BY b.block_id")
def agg_intersection_sum(v):
    return O.overlaps(v.feats, v.blocks).groupBy(F.col("b_block_id").alias("block_id")).agg(F.sum("area").cast("long").alias("area"), F.count("*").alias("n"))


@query("""SELECT count(*) AS cells, (SELECT version FROM wards ORDER BY ward_id LIMIT 1) AS version FROM (SELECT DISTINCT cx, unnest(range(0, 59)) AS cy FROM (SELECT unnest(range(CAST(floor((minx - 300000) / 50) AS BIGINT), CAST(floor((maxx - 300000) / 50) AS BIGINT) + 1)) AS cx FROM wards) t) u""")
def agg_dissolve(v):
    return A.dissolve(O.cover(v.wards, 50), "ward_id", "version")


@query(f""", o AS (SELECT b.block_id, f.kind, {over('f', 'b')} AS area FROM feats f JOIN blocks b ON {over('f', 'b')} > 0),
p AS (SELECT block_id, sum(CASE WHEN kind = 'canopy' THEN area ELSE 0 END) AS canopy, sum(CASE WHEN kind = 'impervious' THEN area ELSE 0 END) AS imp, sum(CASE WHEN kind = 'building' THEN area ELSE 0 END) AS bld FROM o GROUP BY block_id)
SELECT block_id, round(canopy / 62500.0, 4) AS canopy_frac, round(least((imp + bld) / 62500.0, 1.0), 4) AS imperv_frac FROM p""")
def agg_pilot_factors(v):
    o = O.overlaps(v.feats, v.blocks).groupBy(F.col("b_block_id").alias("block_id")).pivot("a_kind", ["canopy", "impervious", "building"]).agg(F.sum("area"))
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    return o.select("block_id", F.round(part("canopy") / 62500.0, 4).alias("canopy_frac"), F.round(F.least((part("impervious") + part("building")) / 62500.0, F.lit(1.0)), 4).alias("imperv_frac"))


@query(f"SELECT b.block_id, count(DISTINCT CASE WHEN f.kind = 'building' THEN f.feat_id END) AS buildings, count(DISTINCT CASE WHEN f.kind = 'canopy' THEN f.feat_id END) AS canopies FROM feats f JOIN blocks b ON {over('f', 'b')} > 0 GROUP BY b.block_id")
def agg_feature_count(v):
    o = O.overlaps(v.feats, v.blocks)
    return o.groupBy(F.col("b_block_id").alias("block_id")).agg(*(F.count_distinct(F.when(F.col("a_kind") == k, F.col("a_feat_id"))).alias(n) for k, n in (("building", "buildings"), ("canopy", "canopies"))))


@query("SELECT kind, count(*) AS n, round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 4) AS length FROM water GROUP BY kind")
def agg_water_stats(v):
    return v.water.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 4).alias("length"))


@query("SELECT kind, landuse, count(*) AS n FROM feats GROUP BY kind, landuse")
def agg_feature_type_counts(v):
    return v.feats.groupBy("kind", "landuse").agg(F.count("*").alias("n"))
