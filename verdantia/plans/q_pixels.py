"""Queries of pixel and vector transforms."""

from pyspark.sql import functions as F

from ..operators import pixels as O
from ..operators import regions as G
from ..operators import spatial as P
from ..sources.io import written
from .catalog import query



@query("""SELECT r, c, arg_max(kind, feat_id) AS value FROM (SELECT *, unnest(range(CAST(ceil((miny - 2000000) / 10 - 0.5) AS BIGINT), CAST(floor((maxy - 2000000) / 10 - 0.5) AS BIGINT) + 1)) AS r FROM
(SELECT feat_id, kind, miny, maxy, unnest(range(CAST(ceil((minx - 300000) / 10 - 0.5) AS BIGINT), CAST(floor((maxx - 300000) / 10 - 0.5) AS BIGINT) + 1)) AS c FROM feats) a) b GROUP BY r, c""")
def px_rasterize_polygons(v):
    return O.rasterize_boxes(v.feats, "kind", "feat_id", 300000, 2000000, 10)


@query(""", known AS MATERIALIZED (SELECT r, c, seg FROM px WHERE seg IS NOT NULL), ways AS (SELECT unnest([{'dr': 1, 'dc': 0}, {'dr': -1, 'dc': 0}, {'dr': 0, 'dc': 1}, {'dr': 0, 'dc': -1}], recursive := true)),
reach AS (SELECT r AS r0, c AS c0, r, c, seg FROM known UNION SELECT r0, c0, k.r, k.c, k.seg FROM (SELECT *, r + dr AS nr, c + dc AS nc FROM reach, ways) s JOIN known k ON k.r = s.nr AND k.c = s.nc AND k.seg = s.seg),
named AS (SELECT r0 AS r, c0 AS c, seg, min({'r': r, 'c': c}) AS region FROM reach GROUP BY r0, c0, seg),
sides AS (SELECT region, count(*) AS n FROM (SELECT *, r + dr AS nr, c + dc AS nc FROM named, ways) s LEFT JOIN known k ON k.r = s.nr AND k.c = s.nc AND k.seg = s.seg WHERE k.r IS NULL GROUP BY region)
SELECT n.region.r AS region_r, n.region.c AS region_c, seg, count(*) AS pixels, 100.0::DOUBLE * count(*) AS area, 10.0::DOUBLE * max(s.n) AS outline FROM named n JOIN sides s ON s.region = n.region GROUP BY n.region, seg""")
def px_vectorise(v):
    """Regions of one class with their pixels, area and length of outline in metres."""
    v.hold("px")
    made = written(G.label(v.px, "seg"))
    e = G.outlines(made, "seg")
    across = 10.0 * (F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))
    shape = e.groupBy("region").agg((100.0 * F.sum(F.col("x1") * (F.col("y2") - F.col("y1")))).alias("area"), F.sum(across).alias("outline"))
    pixels = made.groupBy("region", "seg").agg(F.count("*").alias("pixels"))
    return pixels.join(shape, "region").select(F.col("region.r").alias("region_r"), F.col("region.c").alias("region_c"), "seg", "pixels", "area", "outline")


@query("""SELECT p.r, p.c, round(sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS value FROM (SELECT r, c, gr, gc, (1 - abs(y - gr)) * (1 - abs(x - gc)) AS w FROM (SELECT r, c, y, x, gr, unnest([CAST(floor(x) AS BIGINT), CAST(floor(x) AS BIGINT) + 1]) AS gc FROM
(SELECT r, c, (r + 0.5) / 25 - 0.5 AS y, (c + 0.5) / 25 - 0.5 AS x, unnest([CAST(floor((r + 0.5) / 25 - 0.5) AS BIGINT), CAST(floor((r + 0.5) / 25 - 0.5) AS BIGINT) + 1]) AS gr FROM px) a) b) p LEFT JOIN (SELECT bi, bj, score AS v FROM scored) s ON p.gr = s.bi AND p.gc = s.bj GROUP BY p.r, p.c""")
def px_bilinear_resample(v):
    coarse = v.scored.select(F.col("bi").alias("gr"), F.col("bj").alias("gc"), F.col("score").alias("v"))
    return O.bilinear(coarse, v.px.select("r", "c"), 25).withColumn("value", F.round("value", 6))


@query("SELECT p.r, p.c, p.seg, s.slope FROM px p LEFT JOIN (SELECT r, c, max(people) AS slope FROM px WHERE r % 2 = 0 GROUP BY r, c) s ON p.r = s.r AND p.c = s.c")
def px_band_stack(v):
    slope = v.px.filter("r % 2 = 0").groupBy("r", "c").agg(F.max("people").alias("slope"))
    return v.px.select("r", "c", "seg").join(slope, ["r", "c"], "left")


@query("SELECT CASE WHEN seg = 0 AND coalesce(nd < 30, true) THEN NULL ELSE seg END AS label, count(*) AS n FROM px GROUP BY 1")
def px_label_clean(v):
    return v.px.groupBy(O.label_clean(F.col("seg"), F.col("nd"), 30).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT r, c, arg_max(te, l_orderkey * 1000000000 + l_partkey * 1000 + te) AS te FROM obs WHERE nodata = 0 GROUP BY r, c")
def px_mosaic(v):
    return O.mosaic(v.obs.withColumn("te", F.when(F.col("nodata") == 0, F.col("te"))), "te", ["l_orderkey", "l_partkey", "te"])


@query("""SELECT r, c, class FROM (SELECT r, c, class, row_number() OVER (PARTITION BY r, c ORDER BY score DESC, class) AS k FROM (SELECT r, c, seg AS class, sum(people * dn) AS score FROM obs GROUP BY r, c, seg) a) b WHERE k = 1""")
def px_tile_vote_merge(v):
    return O.vote_merge(v.obs.select("r", "c", F.col("seg").alias("class"), F.col("people").alias("weight"), F.col("dn").alias("probability")))


@query(', size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px) SELECT t.top, l."left" FROM (SELECT unnest(range(-24, h + 24 - 64 + 32, 32)) AS top FROM size) t, (SELECT unnest(range(-24, w + 24 - 64 + 32, 32)) AS "left" FROM size) l')
def px_tile_plan(v):
    return O.tile_plan(v.px, 64, 32, 24)


@query("""SELECT top, "left", count(*) AS n FROM (SELECT top, unnest(range(greatest(CAST(ceil((c - 255) / 64) AS BIGINT), 0), CAST(floor(c / 64) AS BIGINT) + 1)) * 64 AS "left" FROM (SELECT c, unnest(range(greatest(CAST(ceil((r - 255) / 64) AS BIGINT), 0), CAST(floor(r / 64) AS BIGINT) + 1)) * 64 AS top FROM px) a) b GROUP BY top, "left" """)
def px_patch_grid(v):
    from ..operators.aggregates import patches

    return patches(v.px, 256, 64).groupBy("top", "left").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN x - 300000 + 256 <= 1500 THEN 'train' WHEN x - 300000 >= 1756 AND x - 300000 + 256 <= 2300 THEN 'val' WHEN x - 300000 >= 2556 THEN 'test' END AS split, count(*) AS n FROM units GROUP BY 1")
def px_spatial_split(v):
    return v.units.groupBy(O.spatial_split(F.col("x") - 300000, 1500, 2300).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT bin, count(*) AS n FROM (SELECT least(CAST(floor(CAST((te - lo) * 10 AS DOUBLE) / (hi - lo)) AS BIGINT), 9) AS bin FROM px, (SELECT min(te) AS lo, max(te) AS hi FROM px) e WHERE te IS NOT NULL) t GROUP BY bin")
def px_histogram(v):
    return O.histogram(v.px, "te")


@query("SELECT seg, n, round(sqrt(sum(n) OVER () / (count(*) OVER () * n)), 6) AS w FROM (SELECT seg, CAST(count(*) AS DOUBLE) AS n FROM px WHERE seg IS NOT NULL GROUP BY seg) t")
def px_class_weights(v):
    n = v.px.filter("seg is not null").groupBy("seg").agg(F.count("*").cast("double").alias("n"))
    return O.class_weights(n).withColumn("w", F.round("w", 6))


@query("SELECT l_orderkey AS collection, l_linenumber AS part, max(l_partkey) AS geom FROM lineitem GROUP BY l_orderkey, l_linenumber UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def vec_explode_collection(v):
    parts = v.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("geom"))
    whole = v.orders.select(F.col("o_orderkey").alias("collection")).join(parts.groupBy(F.col("l_orderkey").alias("collection")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("part"), "geom")).alias("parts")), "collection", "left")
    return whole.select("collection", F.explode_outer("parts").alias("p")).select("collection", "p.part", "p.geom")


@query("SELECT feat_id, part, feat_id || '_' || part AS part_id FROM (SELECT feat_id, unnest(range(0, 1 + feat_id % 3)) AS part FROM feats) t")
def vec_polygon_parts(v):
    many = v.feats.select("feat_id", F.sequence(F.lit(0), (F.col("feat_id") % 3).cast("int")).alias("geoms"))
    return many.select("feat_id", F.posexplode("geoms").alias("part", "g")).select("feat_id", F.col("part").cast("long").alias("part"), F.concat_ws("_", "feat_id", "part").alias("part_id"))


@query("SELECT feat_id, CASE WHEN feat_id % 2 = 0 THEN 'way' ELSE 'unknown' END AS element_type, feat_id * 10 AS osm_id FROM feats")
def vec_element_info(v):
    nested = v.feats.select("feat_id", F.struct((F.col("feat_id") * 10).alias("osm_id"), F.when(F.col("feat_id") % 2 == 0, "way").alias("element")).alias("info"))
    return nested.select("feat_id", F.coalesce("info.element", F.lit("unknown")).alias("element_type"), "info.osm_id")


@query("SELECT feat_id, greatest(minx, 300500) AS minx, least(maxx, 302000) AS maxx FROM feats WHERE minx < 302000 AND maxx > 300500 AND miny < 2002000 AND maxy > 2000500")
def vec_clip_roi(v):
    hit = v.feats.filter("minx < 302000 and maxx > 300500 and miny < 2002000 and maxy > 2000500")
    return hit.select("feat_id", F.greatest("minx", F.lit(300500)).alias("minx"), F.least("maxx", F.lit(302000)).alias("maxx"))


@query("SELECT DISTINCT 'PN_' || cy || '_' || cx AS block_id FROM (SELECT cx, unnest(range(CAST(floor((miny - 2000000) / 250) AS BIGINT), CAST(floor((maxy - 2000000) / 250) AS BIGINT) + 1)) AS cy FROM (SELECT miny, maxy, unnest(range(CAST(floor((minx - 300000) / 250) AS BIGINT), CAST(floor((maxx - 300000) / 250) AS BIGINT) + 1)) AS cx FROM areas) a) b")
def vec_block_grid(v):
    return P.cover(v.areas).select(P.block_name(F.col("cy"), F.col("cx")).alias("block_id")).distinct()


@query("SELECT ward_id, 'EPSG:32643' AS crs, 'survey' AS source, CASE WHEN version = 1 THEN 'current' ELSE 'older' END AS status FROM wards")
def vec_provenance(v):
    return v.wards.select("ward_id", F.lit("EPSG:32643").alias("crs"), F.lit("survey").alias("source"), F.when(F.col("version") == 1, "current").otherwise("older").alias("status"))
