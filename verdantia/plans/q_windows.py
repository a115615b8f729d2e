"""Queries of windows, sorts, limits and set operations."""

from pyspark.sql import functions as F

from ..operators import spatial as P
from ..operators import rate as R
from ..operators import windows as O
from .catalog import query
from .q_joins import CELLS, cells, over


@query(f", p AS (SELECT a.area_id, s.block_id, s.score FROM areas a JOIN scored s ON {over('a', 's')} > 0) SELECT area_id, block_id, score, CAST(row_number() OVER (PARTITION BY area_id ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score, block_id) AS INTEGER) AS rank FROM p")
def win_rank_candidates(v):
    pairs = P.overlaps(v.areas, v.scored).select(F.col("a_area_id").alias("area_id"), F.col("b_block_id").alias("block_id"), F.col("b_score").alias("score"))
    return O.rank_candidates(pairs, ["area_id"])


@query("SELECT segment, unit_id FROM (SELECT segment, unit_id, row_number() OVER (PARTITION BY segment ORDER BY c_custkey) AS k FROM units) t WHERE k = 1")
def win_first_per_group(v):
    return P.first_by(v.units, ["segment"], ["c_custkey"]).select("segment", "unit_id")


@query("SELECT status, max(CASE WHEN k = 1 THEN priority END) AS best, max(CASE WHEN k = 2 THEN priority END) AS second FROM (SELECT status, priority, row_number() OVER (PARTITION BY status ORDER BY priority DESC) AS k FROM ranked) t WHERE k <= 2 GROUP BY status")
def win_top2_gap(v):
    return O.top2_gap(v.ranked, "status", "priority")


@query("SELECT unit_id, CAST(running AS BIGINT) AS running FROM (SELECT unit_id, sum(area) OVER (ORDER BY priority DESC, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM ranked) t WHERE running <= 100000")
def win_cumulative_budget(v):
    return O.within_budget(v.ranked, "priority", "area", 100000, ("unit_id",)).select("unit_id", "running")


@query("SELECT seg, bldg, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct_all, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY seg), 6) AS pct_row FROM (SELECT seg, bldg, count(*) AS n FROM obs GROUP BY seg, bldg) t")
def win_percent_of_total(v):
    from ..operators.aggregates import percent_of_total

    n = v.obs.groupBy("seg", "bldg").agg(F.count("*").alias("n"))
    return percent_of_total(n, "seg").select("seg", "bldg", "n", F.round("pct_all", 6).alias("pct_all"), F.round("pct_row", 6).alias("pct_row"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY cost) + (count(*) OVER (PARTITION BY cost) - 1) / 2 AS avg_rank FROM ranked")
def win_average_rank(v):
    return O.average_rank(v.ranked, "cost", "avg_rank").select("o_orderkey", "avg_rank")


@query("""SELECT user_id, event_type, entity, arg_min(event_id, ts) AS event_id, count(*) AS merged FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type, entity ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN entity IS NULL OR prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type, entity ORDER BY ts, event_id) AS prev FROM activity) a) b) c GROUP BY user_id, event_type, entity, s""")
def win_gap_sessions(v):
    """A gap of six hours: the table's events are too far apart for the sixty seconds that the stream uses."""
    return O.gap_sessions(v.activity, ["user_id", "event_type", "entity"], "ts", 21600, ["event_id"]).select("user_id", "event_type", "entity", "event_id", "merged")


#: Openings of each user's windows of a day, one after another, and the requests numbered within them.
COUNTED = """hits AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM activity),
chain AS (SELECT user_id, min(t) AS open FROM hits GROUP BY user_id UNION ALL SELECT c.user_id, min(h.t) AS open FROM chain c JOIN hits h ON h.user_id = c.user_id AND h.t > c.open + 86400000000 GROUP BY c.user_id, c.open),
counted AS (SELECT h.user_id, h.event_id, h.t, c.open, row_number() OVER (PARTITION BY h.user_id, c.open ORDER BY h.t, h.event_id) AS n FROM hits h ASOF JOIN chain c ON h.user_id = c.user_id AND h.t >= c.open)"""
DECIDED = f", {COUNTED} SELECT user_id, event_id, n <= 2 AS allowed, CAST(greatest(2 - n, 0) AS INTEGER) AS remaining, CASE WHEN n > 2 THEN greatest(1, CAST(round((open + 86400000000 - t) / 1000000.0) AS INTEGER)) ELSE 0 END AS retry_after FROM counted"


@query(DECIDED)
def win_fixed_window_counter(v):
    return R.fixed_window_counter(v.activity, "user_id", "ts", 2, 86400)


@query("SELECT block_id, score FROM scored ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score, block_id LIMIT 50")
def srt_candidates_need(v):
    return v.scored.orderBy(F.col("score").isNull(), F.col("score").asc_nulls_last(), "block_id").limit(50).select("block_id", "score")


@query("""SELECT * FROM (SELECT 'baseline' AS mode, block_id FROM scored ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score DESC, block_id LIMIT 20) a UNION ALL SELECT * FROM (SELECT 'canopy_deficit' AS mode, s.block_id FROM scored s LEFT JOIN (SELECT * FROM carbon WHERE height > 3) c ON s.block_id = c.block_id ORDER BY coalesce(c.canopy_m2, 999999), s.block_id LIMIT 20) b""")
def srt_candidates_modes(v):
    a = v.scored.orderBy(F.col("score").isNull(), F.desc("score"), "block_id").limit(20).select(F.lit("baseline").alias("mode"), "block_id")
    c = v.scored.join(v.carbon.filter("height > 3").select("block_id", "canopy_m2"), "block_id", "left")
    return a.unionAll(c.orderBy(F.coalesce("canopy_m2", F.lit(999999)), "block_id").limit(20).select(F.lit("canopy_deficit").alias("mode"), "block_id"))


@query("SELECT unit_id, priority FROM ranked ORDER BY priority DESC, unit_id")
def srt_priority_units(v):
    return v.ranked.orderBy(F.desc("priority"), "unit_id").select("unit_id", "priority")


@query("SELECT unit_id, priority FROM ranked ORDER BY priority DESC, unit_id LIMIT 100")
def lim_topk_units(v):
    return v.ranked.orderBy(F.desc("priority"), "unit_id").limit(100).select("unit_id", "priority")


@query("SELECT scenario, unit_id FROM bridge")
def lim_nested_scenarios(v):
    return O.nested_prefixes(v.ranked, [F.desc("priority"), F.col("unit_id")], {"a_100": 100, "b_250": 250, "c_500": 500, "d_none": 0}).select("scenario", "unit_id")


@query("SELECT block_id, (SELECT count(*) FROM scored) AS total, (SELECT count(*) FROM scored) > 30 AS has_more FROM (SELECT block_id, row_number() OVER (ORDER BY block_id) AS k FROM scored) t WHERE k BETWEEN 21 AND 30")
def lim_page(v):
    return O.page(v.scored, [F.col("block_id")], 3, 10).select("block_id", "total", "has_more")


@query("SELECT segment, unit_id FROM (SELECT segment, unit_id, row_number() OVER (PARTITION BY segment ORDER BY unit_id) AS k FROM units) t WHERE k <= 20")
def lim_tile_cap(v):
    return O.cap_per_group(v.units, ["segment"], [F.col("unit_id")], 20).select("segment", "unit_id")


@query("SELECT block_id, round(abs(score - old_score), 2) AS gap FROM scored WHERE score IS NOT NULL ORDER BY abs(score - old_score) DESC, block_id LIMIT 10")
def top_outliers(v):
    gap = F.abs(F.col("score") - F.col("old_score"))
    return v.scored.filter("score is not null").orderBy(gap.desc(), "block_id").limit(10).select("block_id", F.round(gap, 2).alias("gap"))


@query("SELECT count(*) AS common FROM (SELECT block_id FROM scored ORDER BY old_score DESC, block_id LIMIT 40) a JOIN (SELECT block_id FROM scored WHERE score IS NOT NULL ORDER BY score DESC, block_id LIMIT 40) b ON a.block_id = b.block_id")
def top_overlap(v):
    return O.top_overlap(v.scored, "old_score", "score", 40, "block_id")


@query("SELECT unit_id, x BETWEEN 300500 AND 302000 AS covered FROM units ORDER BY covered DESC, c_custkey LIMIT 60")
def srt_coverage_first(v):
    made = v.units.withColumn("covered", F.col("x").between(300500, 302000))
    return made.orderBy(F.desc("covered"), "c_custkey").limit(60).select("unit_id", "covered")


@query("SELECT feat_id, kind, landuse FROM feats WHERE kind = 'building' UNION ALL SELECT feat_id, kind, NULL FROM feats WHERE kind = 'canopy'")
def set_union_layers(v):
    return O.union_layers([v.feats.filter("kind = 'building'").select("feat_id", "kind", "landuse"), v.feats.filter("kind = 'canopy'").select("feat_id", "kind")])


@query("SELECT kind AS label, water_id FROM water WHERE kind IN ('river', 'lake')")
def set_union_tag_groups(v):
    return O.union_tagged([(k, v.water.filter(F.col("kind") == k).select("water_id")) for k in ("river", "lake")]).select("label", "water_id")


@query("SELECT min(feat_id) AS feat_id, minx, miny FROM feats GROUP BY minx, miny")
def set_dedupe_geometry(v):
    return O.dedupe_first(v.feats, ["minx", "miny"], "feat_id").select("feat_id", "minx", "miny")


@query(f", {CELLS.format(t='fc')} SELECT DISTINCT cx, cy FROM fc WHERE kind = 'canopy' AND NOT EXISTS (SELECT 1 FROM fc o WHERE o.kind <> 'canopy' AND o.cx = fc.cx AND o.cy = fc.cy)")
def set_cells_minus(v):
    c = cells(v, ["kind"])
    return O.cells_minus(c.filter("kind = 'canopy'"), [c.filter("kind = 'building'"), c.filter("kind = 'impervious'")])


@query("SELECT CASE WHEN seg IS NULL AND bldg IS NULL AND road IS NULL THEN NULL WHEN coalesce(seg, 0) = 1 OR coalesce(bldg, 0) = 1 OR coalesce(road, 0) = 1 THEN 1 ELSE 0 END AS class, count(*) AS n FROM px GROUP BY 1")
def set_impervious_or(v):
    return v.px.groupBy(O.impervious_or("seg", "bldg", "road").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN seg IS NULL THEN NULL WHEN seg = 1 OR coalesce(bldg, 0) = 1 OR coalesce(road, 0) = 1 THEN 1 ELSE 0 END AS class, count(*) AS n FROM px GROUP BY 1")
def set_impervious_masked(v):
    return v.px.groupBy(O.impervious_masked("seg", "bldg", "road").alias("class")).agg(F.count("*").alias("n"))


COVER = "{t}c AS (SELECT DISTINCT {k}cx, unnest(range(CAST(floor((miny - 2000000) / 50.0) AS BIGINT), CAST(floor((maxy - 2000000) / 50.0) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor((minx - 300000) / 50.0) AS BIGINT), CAST(floor((maxx - 300000) / 50.0) AS BIGINT) + 1)) AS cx FROM {t}) t)"


@query(f""", {COVER.format(t='wards', k='ward_id, ')}, {COVER.format(t='areas', k='')}, per AS (SELECT cx, cy, count(*) AS n FROM wardsc GROUP BY cx, cy)
SELECT count(CASE WHEN n IS NULL THEN 1 END) AS gap, count(CASE WHEN b IS NULL THEN 1 END) AS extension, count(CASE WHEN n > 1 THEN 1 END) AS overlap
FROM per FULL JOIN (SELECT *, 1 AS b FROM areasc) a ON per.cx = a.cx AND per.cy = a.cy""")
def set_mask_gap_overlap(v):
    return O.mask_gap_overlap(P.cover(v.wards, 50), P.cover(v.areas, 50))
