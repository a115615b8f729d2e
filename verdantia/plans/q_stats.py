"""Queries of statistics, audits and publish checks."""

from pyspark.sql import functions as F

from ..operators import publish as P
from ..operators import scoring
from ..operators import stats as O
from .catalog import query
from .q_scoring import FIXED, LONG, RISK, SHARE

RANKS = "(CASE {r} WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 3 END)"


@query("""SELECT round(corr(old_score, score), 6) AS pearson, round(corr(ro, rn), 6) AS spearman, round(max(abs(score - old_score)), 6) AS max_abs, round(median(abs(score - old_score)), 6) AS median_abs, round(avg(abs(score - old_score)), 6) AS mean_abs FROM
(SELECT *, rank() OVER (ORDER BY old_score) + (count(*) OVER (PARTITION BY old_score) - 1) / 2 AS ro, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rn FROM scored WHERE score IS NOT NULL) t""")
def st_score_stability(v):
    v.hold("scored")
    got = O.stability(v.scored, "old_score", "score")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(f""", moves AS (SELECT * FROM (SELECT block_id, abs({RANKS.format(r='risk')} - {RANKS.format(r='old_risk')}) AS move FROM (SELECT block_id, {RISK} AS risk, {RISK.replace('score', 'old_score')} AS old_risk FROM scored) a) b WHERE move IS NOT NULL),
whole AS (SELECT count(CASE WHEN move > 0 THEN 1 END) AS changed, round(100.0::DOUBLE * count(CASE WHEN move > 0 THEN 1 END) / count(*), 6) AS pct, count(CASE WHEN move >= 2 THEN 1 END) AS big_moves FROM moves)
SELECT changed, pct, big_moves, block_id, move FROM whole LEFT JOIN moves ON move >= 2""")
def st_tier_change(v):
    both = v.scored.select("block_id", scoring.risk_level(F.col("score")).alias("new"), scoring.risk_level(F.col("old_score")).alias("old"))
    return O.tier_change(both, "old", "new", "block_id").withColumn("pct", F.round("pct", 6))


@query("SELECT round(corr(c.canopy_m2, s.score), 6) AS with_score, round(corr(c.canopy_m2, s.old_score), 6) AS with_old FROM carbon c JOIN scored s ON c.block_id = s.block_id WHERE s.score IS NOT NULL")
def st_canopy_corr(v):
    both = v.carbon.join(v.scored.filter("score is not null"), "block_id")
    return both.agg(F.round(F.corr("canopy_m2", "score"), 6).alias("with_score"), F.round(F.corr("canopy_m2", "old_score"), 6).alias("with_old"))


@query("SELECT factor, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean, round(stddev_samp(x) / abs(avg(x)), 6) AS cv, count(DISTINCT x) AS uniques FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS factor, CAST({c} AS DOUBLE) AS x FROM factors" for c in scoring.FACTORS) + ") t GROUP BY factor")
def st_distribution_audit(v):
    a = O.distribution_audit(v.factors, list(scoring.FACTORS))
    return a.select("factor", *(F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "cv")), "uniques")


@query("SELECT round(corr(f.temperature - f.pm25, s.score - s.old_score), 6) AS corr FROM factors f JOIN scored s ON f.block_id = s.block_id")
def st_delta_corr(v):
    both = v.factors.join(v.scored, "block_id")
    return O.delta_corr(both, F.col("temperature"), F.col("pm25"), F.col("score"), F.col("old_score")).select(F.round("corr", 6).alias("corr"))


@query("SELECT count(*) - count(population_exposure) AS missing, count(CASE WHEN population_exposure < 0 THEN 1 END) AS negative, CAST(0 AS BIGINT) AS not_finite, min(population_exposure) AS lo, max(population_exposure) AS hi, sum(population_exposure) AS total, sum(population_exposure) = (SELECT sum(people) FROM px) AS conserved FROM factors")
def st_population_qa(v):
    total = v.px.agg(F.sum("people")).first()[0]
    return O.population_qa(v.factors, "population_exposure", float(total))


@query("SELECT count(*) AS n, count(DISTINCT block_id) AS ids, count(CASE WHEN canopy_m2 > 62500 THEN 1 END) AS above, sum(canopy_m2) AS canopy, count(DISTINCT run_id) AS runs FROM carbon")
def st_carbon_qa(v):
    return v.carbon.agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("ids"), F.count_if(F.col("canopy_m2") > 62500).alias("above"), F.sum("canopy_m2").alias("canopy"), F.count_distinct("run_id").alias("runs"))


@query("SELECT min(nd) AS lo, max(nd) AS hi, round(avg(nd), 6) AS mean, median(nd) AS median, round(100.0::DOUBLE * (count(*) - count(nd)) / count(*), 6) AS nodata_pct, count(CASE WHEN NOT (nd BETWEEN 0 AND 90) THEN 1 END) = 0 AS in_range FROM px")
def st_slope_qa(v):
    return O.slope_qa(v.px, "nd")


@query("SELECT block_id, CASE WHEN abs(tree_density - impervious_surfaces) <= 0.05 THEN 'A' WHEN ndvi >= 0.5 THEN 'B' ELSE 'C' END AS decision FROM factors")
def st_dw_decision(v):
    row = v.factors.select("block_id", (F.col("tree_density") - F.col("impervious_surfaces")).alias("gap"), F.col("ndvi").alias("median_probability"))
    return O.dw_decision(row).select("block_id", "decision")


def _checks(v):
    return O.checks([
        ("ids_unique", v.scored, F.count("*") == F.count_distinct("block_id")),
        ("scores_in_range", v.scored, F.coalesce(F.every(F.col("score").between(0, 100)), F.lit(True))),
        ("some_excluded", v.scored, F.count_if(F.col("score").isNull()) > 0),
        ("canopy_fits", v.carbon, F.every(F.col("canopy_m2") <= 62501)),
        ("all_years", v.obs, F.count_distinct(F.year("ts")) > 100),
    ])


CHECKS = """checked AS (SELECT 'ids_unique' AS name, count(*) = count(DISTINCT block_id) AS ok FROM scored
UNION ALL SELECT 'scores_in_range', count(CASE WHEN score < 0 OR score > 100 THEN 1 END) = 0 FROM scored
UNION ALL SELECT 'some_excluded', count(*) > count(score) FROM scored
UNION ALL SELECT 'canopy_fits', count(CASE WHEN canopy_m2 > 62501 THEN 1 END) = 0 FROM carbon
UNION ALL SELECT 'all_years', count(DISTINCT year(ts)) > 100 FROM obs)"""


@query(f""", {LONG}, {SHARE}, {FIXED}, config AS (SELECT CASE n_nationkey WHEN 0 THEN 'ndvi' WHEN 1 THEN 'tree_density' WHEN 2 THEN 'pm25' WHEN 3 THEN 'temperature' WHEN 4 THEN 'impervious_surfaces' ELSE 'population_exposure' END AS factor,
  n_nationkey < 2 AS positive, CASE WHEN n_nationkey <> 5 THEN n_name END AS source FROM nation WHERE n_nationkey < 6),
active AS (SELECT f.factor, f.w, c.positive, c.source, f.factor IN ('ndvi', 'tree_density') AS up FROM fixed f LEFT JOIN config c ON f.factor = c.factor)
SELECT 'weights_sum_to_one' AS name, abs(sum(w) - 1) <= 1e-9 AS ok FROM active
UNION ALL SELECT 'no_water_factor', count(CASE WHEN factor = 'water_availability' THEN 1 END) = 0 FROM active
UNION ALL SELECT 'pm25_active', count(CASE WHEN factor = 'pm25' THEN 1 END) > 0 FROM active
UNION ALL SELECT 'directions_correct', bool_and(coalesce(positive = up, false)) FROM active
UNION ALL SELECT 'no_synthetic_source', count(CASE WHEN lower(source) LIKE '%synthetic%' THEN 1 END) = 0 FROM active
UNION ALL SELECT 'all_have_provenance', bool_and(source IS NOT NULL) FROM active
UNION ALL SELECT 'factor_count', count(*) = 6 FROM active
UNION ALL SELECT 'scores_finite', count(CASE WHEN isnan(score) OR isinf(score) THEN 1 END) = 0 FROM scored
UNION ALL SELECT 'block_count', count(*) = (SELECT count(*) FROM blocks) FROM scored""")
def st_consistency_gate(v):
    """The last factor has no source here, so that one check fails."""
    v.hold("factors")
    name = F.element_at(F.array(*map(F.lit, scoring.FACTORS)), (F.col("n_nationkey") + 1).cast("int"))
    config = v.nation.filter("n_nationkey < 6").select(name.alias("factor"), (F.col("n_nationkey") < 2).alias("positive"), F.when(F.col("n_nationkey") != 5, F.col("n_name")).alias("source"))
    return O.consistency(scoring.fixed_weight(v.factors), config, v.scored, v.blocks.count())


@query(f", {CHECKS} SELECT (SELECT bool_and(ok) FROM checked) AS promote, (SELECT count(*) FROM checked) AS checks, (SELECT count(*) FROM units WHERE area_id NOT IN (SELECT area_id FROM areas)) AS orphans")
def st_publish_invariants(v):
    orphans = v.units.join(v.areas.select(F.col("area_id").cast("int")), "area_id", "left_anti").agg(F.count("*").alias("orphans"))
    return O.gate(_checks(v)).crossJoin(orphans)


#: The published tables' metrics and what is expected of them; some expectations are not met.
PUBLISHED = """, b AS (SELECT s.block_id, e.score_status <> 'scorable' AS excluded, CASE WHEN s.bi = 3 AND s.bj < 4 THEN NULL ELSE s.score END AS score, CASE WHEN s.bj = 5 THEN coalesce(s.score, 1) ELSE s.score END AS risk FROM scored s JOIN elig e ON s.block_id = e.block_id),
k AS (SELECT block_id, canopy_m2, CASE WHEN height > 0 THEN 1 END AS trees FROM carbon UNION ALL SELECT 'PN_none', 1.0, 1), h AS (SELECT scenario FROM scen WHERE scenario <> 'a_100'), m AS (SELECT scenario, CASE WHEN scenario = 'c_500' AND unit_id LIKE '%7' THEN 'PU_x' ELSE unit_id END AS unit_id FROM bridge),
f AS (SELECT 'blocks' AS metric, CAST(count(*) AS VARCHAR) AS value, CAST((SELECT count(*) FROM blocks) AS VARCHAR) AS expected FROM b UNION ALL SELECT 'excluded_blocks', CAST(count(CASE WHEN excluded THEN 1 END) AS VARCHAR), '11' FROM b
  UNION ALL SELECT 'excluded_with_score', CAST(count(CASE WHEN excluded AND (score IS NOT NULL OR risk IS NOT NULL) THEN 1 END) AS VARCHAR), '0' FROM b UNION ALL SELECT 'scorable_without_score', CAST(count(CASE WHEN NOT excluded AND (score IS NULL OR risk IS NULL) THEN 1 END) AS VARCHAR), '0' FROM b
  UNION ALL SELECT 'carbon_blocks', CAST(count(*) AS VARCHAR), CAST((SELECT count(*) FROM blocks) AS VARCHAR) FROM k UNION ALL SELECT 'carbon_complete', CAST(count(CASE WHEN canopy_m2 IS NOT NULL AND trees IS NOT NULL THEN 1 END) AS VARCHAR), CAST((SELECT count(*) FROM blocks) AS VARCHAR) FROM k
  UNION ALL SELECT 'candidate_areas', CAST(count(*) AS VARCHAR), CAST((SELECT count(*) FROM feats WHERE kind = 'canopy') AS VARCHAR) FROM feats WHERE kind = 'canopy' UNION ALL SELECT 'candidate_areas_valid', CAST(count(CASE WHEN maxx - minx > 60 THEN 1 END) AS VARCHAR), CAST((SELECT count(*) FROM feats WHERE kind = 'canopy') AS VARCHAR) FROM feats WHERE kind = 'canopy'
  UNION ALL SELECT 'planting_units', CAST(count(*) AS VARCHAR), CAST((SELECT count(*) FROM orders) AS VARCHAR) FROM ranked UNION ALL SELECT 'planting_units_valid', CAST(count(CASE WHEN cost > 5 THEN 1 END) AS VARCHAR), CAST((SELECT count(*) FROM orders) AS VARCHAR) FROM ranked
  UNION ALL SELECT 'scenario_mappings', CAST(count(*) AS VARCHAR), '850' FROM m UNION ALL SELECT 'scenario_counts', string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n), '100, 250, 500' FROM (SELECT h.scenario, count(m.unit_id) AS n FROM h LEFT JOIN m ON h.scenario = m.scenario GROUP BY h.scenario) t
  UNION ALL SELECT 'orphaned_carbon', CAST(count(*) AS VARCHAR), '0' FROM k WHERE block_id NOT IN (SELECT block_id FROM b) UNION ALL SELECT 'orphaned_units', CAST(count(*) AS VARCHAR), '0' FROM m WHERE unit_id NOT IN (SELECT unit_id FROM ranked) UNION ALL SELECT 'orphaned_scenarios', CAST(count(*) AS VARCHAR), '0' FROM m WHERE scenario NOT IN (SELECT scenario FROM h))"""


@query(PUBLISHED + " SELECT metric, expected, value, CASE WHEN expected = '0' THEN metric || ': found ' || value || ', none is allowed' ELSE metric || ': expected ' || expected || ', found ' || value END AS error FROM f WHERE value <> expected")
def st_publish_errors(v):
    """Every rule of the published tables that doesn't hold; the twin's inputs are flawed on purpose."""
    at = v.scored.join(v.elig, "block_id")
    flawed = F.when((F.col("bi") == 3) & (F.col("bj") < 4), None).otherwise(F.col("score"))
    blocks = at.select("block_id", (F.col("score_status") != "scorable").alias("excluded"), flawed.alias("score"), F.when(F.col("bj") == 5, F.coalesce("score", F.lit(1.0))).otherwise(F.col("score")).alias("risk"))
    trees = F.when(F.col("height") > 0, 1)
    carbon = v.carbon.select("block_id", "canopy_m2", trees.alias("trees")).unionByName(v.spark.range(1).select(F.lit("PN_none").alias("block_id"), F.lit(1.0).alias("canopy_m2"), F.lit(1).alias("trees"))).withColumns({"agb_kg": F.col("trees"), "co2_t": F.col("trees")})
    crowns = v.feats.filter("kind = 'canopy'")
    mapped = v.bridge.withColumn("unit_id", F.when((F.col("scenario") == "c_500") & F.col("unit_id").endswith("7"), "PU_x").otherwise(F.col("unit_id")))
    found = P.metrics(blocks, carbon, crowns.select((F.col("maxx") - F.col("minx") > 60).alias("valid")), v.ranked.select("unit_id", (F.col("cost") > 5).alias("valid")), v.scen.filter("scenario != 'a_100'"), mapped)
    n, areas, orders = v.blocks.count(), crowns.count(), v.orders.count()
    expected = {"blocks": n, "carbon_blocks": n, "carbon_complete": n, "excluded_blocks": 11, "candidate_areas": areas, "candidate_areas_valid": areas, "planting_units": orders, "planting_units_valid": orders, "scenario_mappings": 850, "scenario_counts": [500, 100, 250]}
    return P.broken(found, P.rules(found, expected))


@query("SELECT count(CASE WHEN run_id <> 'run_1' THEN 1 END) > 0 AS conflict FROM scored")
def st_cross_run_conflict(v):
    return O.cross_run_conflict(v.scored, "run_1")


@query("SELECT s.run_id, m.r_name AS method, count(*) AS blocks FROM scored s JOIN region m ON m.r_regionkey = CASE WHEN s.run_id = 'run_1' THEN 1 ELSE 0 END GROUP BY s.run_id, m.r_name")
def st_provenance_lookup(v):
    runs = v.scored.groupBy("run_id").agg(F.count("*").alias("blocks")).withColumn("r_regionkey", F.substring("run_id", 5, 1).cast("int"))
    return runs.join(v.region, "r_regionkey").select("run_id", F.struct(F.col("r_name").alias("name")).alias("method"), "blocks").select("run_id", F.col("method.name").alias("method"), "blocks")


@query("SELECT (SELECT count(*) FROM blocks) AS n, (SELECT count(DISTINCT block_id) FROM blocks) AS ids, (SELECT count(*) FROM blocks WHERE block_id NOT IN (SELECT block_id FROM carbon)) AS without_carbon")
def st_artifact_check(v):
    a = v.blocks.agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("ids"))
    return a.crossJoin(v.blocks.join(v.carbon, "block_id", "left_anti").agg(F.count("*").alias("without_carbon")))


@query("SELECT kind, count(*) AS new_n, count(CASE WHEN feat_id % 4 <> 0 THEN 1 END) AS old_n, CAST(sum((maxx - minx) * (maxy - miny)) - sum(CASE WHEN feat_id % 4 <> 0 THEN (maxx - minx) * (maxy - miny) ELSE 0 END) AS BIGINT) AS area_gain FROM feats GROUP BY kind")
def st_roi_area_delta(v):
    area = F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).cast("long")
    new = v.feats.groupBy("kind").agg(F.count("*").alias("new_n"), area.alias("a"))
    old = v.feats.filter("feat_id % 4 != 0").groupBy("kind").agg(F.count("*").alias("old_n"), area.alias("b"))
    return new.join(old, "kind", "left").select("kind", "new_n", F.coalesce("old_n", F.lit(0)).alias("old_n"), (F.col("a") - F.coalesce("b", F.lit(0))).alias("area_gain"))
