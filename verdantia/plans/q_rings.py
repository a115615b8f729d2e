"""Queries on polygons with a notch and a hole: what the queries on boxes ask, of rings."""

from pyspark.sql import functions as F

from ..functions import clip
from ..functions.scalar import box_ring
from ..operators import aggregates as A
from ..operators import overlay as V
from ..operators import planting as P
from ..operators import rings as R
from ..operators import spatial as S
from ..operators import windows as W
from .catalog import query

#: Corners, as SQL over the sides of a box: notched from its upper edge down to 0.6 of its height, with a three-sided hole.
WIDE, HIGH = "(maxx - minx)", "(maxy - miny)"
OUTER = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("(minx + maxx) / 2.0E0", f"miny + {HIGH} * 0.6E0"), ("minx", "maxy")]
HOLE = [(f"minx + {WIDE} / 4.0E0", f"miny + {HIGH} / 8.0E0"), (f"minx + {WIDE} / 2.0E0", f"miny + {HIGH} / 8.0E0"), (f"minx + {WIDE} / 4.0E0", f"miny + {HIGH} * 0.375E0")]
#: Share of the box that is left: less the notch and the hole.
LEFT = 1 - 0.4 / 2 - 1 / 32


def shaped(df):
    """df with rings and holes from its box."""
    ring = lambda corners: F.array(F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in corners)))
    return df.withColumns({"rings": ring(OUTER), "holes": ring(HOLE)})


def edge_rows(table: str, keys: str) -> str:
    """The edges of every row's polygon, as SQL; the hole runs the other way round."""
    both = list(zip(OUTER, OUTER[1:] + OUTER[:1])) + [(b, a) for a, b in zip(HOLE, HOLE[1:] + HOLE[:1])]
    return " UNION ALL ".join(f"SELECT {keys}, minx, miny, maxx, maxy, CAST({ax} AS DOUBLE) AS x1, CAST({ay} AS DOUBLE) AS y1, CAST({bx} AS DOUBLE) AS x2, CAST({by} AS DOUBLE) AS y2 FROM {table}" for (ax, ay), (bx, by) in both)


def shared(name: str, table: str, key: str, boxes: str, box_keys: str) -> str:
    """A view (key, box_keys, area) of the area that each polygon of `table` shares with each of `boxes`, as SQL."""
    return f"""{name}_e AS ({edge_rows(table, key)}),
{name}_h AS (SELECT e.*, {", ".join(f"b.{k}" for k in box_keys.split(", "))}, b.minx AS bx0, b.maxx - b.minx AS w, least(greatest(y1, b.miny), b.maxy) AS ya, least(greatest(y2, b.miny), b.maxy) AS yb FROM {name}_e e JOIN {boxes} b ON e.minx < b.maxx AND e.maxx > b.minx AND e.miny < b.maxy AND e.maxy > b.miny WHERE y1 <> y2),
{name}_u AS (SELECT *, x1 - bx0 + (x2 - x1) * ((ya - y1) / (y2 - y1)) AS u, x1 - bx0 + (x2 - x1) * ((yb - y1) / (y2 - y1)) AS v FROM {name}_h),
{name}_g AS (SELECT *, pow(least(greatest(u, 0), w), 2) / 2 + w * greatest(u - w, 0) AS gu, pow(least(greatest(v, 0), w), 2) / 2 + w * greatest(v - w, 0) AS gv FROM {name}_u),
{name} AS (SELECT {key}, {box_keys}, sum((yb - ya) * CASE WHEN abs(v - u) < 1e-9 THEN least(greatest((u + v) / 2, 0), w) ELSE (gv - gu) / (v - u) END) AS area FROM {name}_g GROUP BY {key}, {box_keys} HAVING area > 0.000001)"""


def inside(x: str, y: str) -> str:
    """Whether a point lies in the polygon of a row's box, as SQL."""
    cross = lambda a, b: f"CASE WHEN (({a[1]}) > {y}) <> (({b[1]}) > {y}) AND {x} < (({b[0]}) - ({a[0]})) * (({y} - ({a[1]})) / CAST(nullif(({b[1]}) - ({a[1]}), 0) AS DOUBLE)) + ({a[0]}) THEN 1 ELSE 0 END"
    return "(" + " + ".join(cross(a, b) for ring in (OUTER, HOLE) for a, b in zip(ring, ring[1:] + ring[:1])) + ") % 2 = 1"


@query(f"""SELECT r, c, arg_max(kind, feat_id) AS value FROM (SELECT *, unnest(range(CAST(floor((miny - 2000000) / 10) AS BIGINT), CAST(floor((maxy - 2000000) / 10) AS BIGINT) + 1)) AS r FROM
(SELECT feat_id, kind, minx, miny, maxx, maxy, unnest(range(CAST(floor((minx - 300000) / 10) AS BIGINT), CAST(floor((maxx - 300000) / 10) AS BIGINT) + 1)) AS c FROM feats) a) b WHERE {inside('(300005 + c * 10)', '(2000005 + r * 10)')} GROUP BY r, c""")
def px_rasterize_rings(v):
    return R.rasterize(shaped(v.feats), "feat_id", "kind", 300000, 2000000, 10)


CELLS_OF = """{n}_b AS (SELECT *, 300000 + cx * 250 AS x0, 2000000 + cy * 250 AS y0 FROM (SELECT *, unnest(range(CAST(floor((miny - 2000000) / 250) AS BIGINT), CAST(floor((maxy - 2000000) / 250) AS BIGINT) + 1)) AS cy FROM
(SELECT *, unnest(range(CAST(floor((minx - 300000) / 250) AS BIGINT), CAST(floor((maxx - 300000) / 250) AS BIGINT) + 1)) AS cx FROM areas) a) b),
{n}_t AS (SELECT e.area_id, cx, cy, CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN x0 AND x0 + 250 THEN 0 ELSE 2 END ELSE least((x0 - x1) / (x2 - x1), (x0 + 250 - x1) / (x2 - x1)) END AS xl, CASE WHEN x1 = x2 THEN 1 ELSE greatest((x0 - x1) / (x2 - x1), (x0 + 250 - x1) / (x2 - x1)) END AS xh,
  CASE WHEN y1 = y2 THEN CASE WHEN y1 BETWEEN y0 AND y0 + 250 THEN 0 ELSE 2 END ELSE least((y0 - y1) / (y2 - y1), (y0 + 250 - y1) / (y2 - y1)) END AS yl, CASE WHEN y1 = y2 THEN 1 ELSE greatest((y0 - y1) / (y2 - y1), (y0 + 250 - y1) / (y2 - y1)) END AS yh FROM {n}_b b JOIN ({e}) e ON b.area_id = e.area_id),
{n}_r AS (SELECT DISTINCT area_id, cx, cy FROM {n}_t WHERE greatest(xl, yl, 0) <= least(xh, yh, 1)),
{n} AS (SELECT b.area_id, b.cx, b.cy, r.cx IS NOT NULL AS rim FROM {n}_b b LEFT JOIN {n}_r r ON b.area_id = r.area_id AND b.cx = r.cx AND b.cy = r.cy WHERE r.cx IS NOT NULL OR {i})""".format(n="cells", e=edge_rows("areas", "area_id"), i=inside("(b.x0 + 125)", "(b.y0 + 125)").replace("minx", "b.minx").replace("maxx", "b.maxx").replace("miny", "b.miny").replace("maxy", "b.maxy"))


@query(f", {CELLS_OF} SELECT area_id, 'PN_' || cy || '_' || cx AS block_id, rim FROM cells")
def jn_ring_cells(v):
    """Cells that a polygon touches; rim: the exact test is still to be made there."""
    cells = R.cover(shaped(v.areas), "area_id")
    return cells.select("area_id", S.block_name(F.col("cy"), F.col("cx")).alias("block_id"), F.col("edges").isNotNull().alias("rim"))


@query(f", {CELLS_OF} SELECT DISTINCT 'PN_' || cy || '_' || cx AS block_id FROM cells")
def vec_ring_grid(v):
    return R.cover(shaped(v.areas), "area_id").select(S.block_name(F.col("cy"), F.col("cx")).alias("block_id")).distinct()


@query(f"SELECT u.unit_id, min(a.area_id) AS area_id FROM areas a JOIN units u ON u.x BETWEEN a.minx AND a.maxx AND u.y BETWEEN a.miny AND a.maxy WHERE {inside('u.x', 'u.y')} GROUP BY u.unit_id")
def jn_ring_first(v):
    both = R.points_in(v.units.drop("area_id"), shaped(v.areas), "area_id")
    return both.groupBy("unit_id").agg(F.min("area_id").alias("area_id"))


@query(f""", {shared("p", "areas", "area_id", "scored", "block_id, score")}
SELECT area_id, count(*) AS blocks, count(score) AS scored, count(CASE WHEN score < 25 THEN 1 END) AS critical, count(CASE WHEN score >= 25 AND score < 50 THEN 1 END) AS high, count(CASE WHEN score >= 50 AND score < 75 THEN 1 END) AS moderate, count(CASE WHEN score >= 75 THEN 1 END) AS low,
  round(sum(area), 4) AS eligible_m2, round(sum(CASE WHEN score IS NOT NULL THEN area END), 4) AS scored_m2, round(sum(score * area) / sum(CASE WHEN score IS NOT NULL THEN area END), 4) AS weighted_score FROM p GROUP BY area_id""")
def agg_ring_study_area(v):
    over = R.overlaps(v.scored, "block_id", shaped(v.areas), "area_id").join(v.scored.select("block_id", "score"), "block_id")
    return A.study_area(over, "area_id", exact=True)


@query(f", {shared('p', 'feats', 'feat_id', 'blocks', 'block_id')} SELECT block_id, round(sum(area), 4) AS area, count(*) AS n FROM p GROUP BY block_id")
def agg_ring_intersection(v):
    over = R.overlaps(v.blocks, "block_id", shaped(v.feats), "feat_id")
    return over.groupBy("block_id").agg(F.round(F.sum("area"), 4).alias("area"), F.count("*").alias("n"))


@query(f""", crowns AS (SELECT * FROM feats WHERE kind = 'canopy'), {shared("p", "areas", "area_id", "crowns", "feat_id")}, s AS (SELECT area_id, sum(area) AS canopy FROM p GROUP BY area_id)
SELECT area_id, round(canopy, 4) AS canopy, round(canopy / greatest(pi() * 9, 1.0) * 0.1066::DOUBLE * pow(30.0, 2.4572::DOUBLE) * 0.47::DOUBLE * (44.0::DOUBLE / 12.0) / 1000, 3) AS co2_t FROM s""")
def cb_ring_study_area(v):
    crowns = v.feats.filter("kind = 'canopy'")
    over = R.overlaps(crowns, "feat_id", shaped(v.areas), "area_id").groupBy("area_id").agg(F.sum("area").alias("canopy"))
    return over.select("area_id", F.round("canopy", 4).alias("canopy"), F.round(P.carbon_chain(F.col("canopy"), F.lit(10.0))["co2_t"], 3).alias("co2_t"))


CITY = "SELECT 1 AS city, min(minx) AS minx, min(miny) AS miny, max(maxx) - 400 AS maxx, max(maxy) AS maxy FROM wards"


@query(f""", city AS ({CITY}), met AS (SELECT a.area_id, b.block_id, greatest(a.minx, b.minx) AS minx, greatest(a.miny, b.miny) AS miny, least(a.maxx, b.maxx) AS maxx, least(a.maxy, b.maxy) AS maxy, (a.area_id * 10 + 7) AS pop, (a.maxx - a.minx) * (a.maxy - a.miny) AS own FROM areas a JOIN blocks b ON a.minx < b.maxx AND a.maxx > b.minx AND a.miny < b.maxy AND a.maxy > b.miny),
{shared("p", "city", "city", "met", "area_id, block_id, pop, own")} SELECT block_id, round(sum(pop * area / own), 6) AS value, count(DISTINCT area_id) AS cells, round(sum(area), 4) AS area FROM p GROUP BY block_id""")
def jn_ring_alloc(v):
    got = S.area_weighted(v.areas.withColumn("pop", F.col("area_id") * 10 + 7), v.blocks, "pop", "area_id", shaped(v.sql(CITY)).select("city", "rings", "holes"))
    return got.select("block_id", F.round("value", 6).alias("value"), "cells", F.round("area", 4).alias("area"))


@query(f""", {shared("ov", "wards", "ward_id", "blocks", "block_id")}, rk AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY round(area, 6) DESC, ward_id) AS k FROM ov),
top AS (SELECT b.block_id, max(CASE WHEN k = 1 THEN area END) AS best, max(CASE WHEN k = 2 THEN area END) AS second, max(CASE WHEN k = 1 THEN ward_id END) AS ward FROM blocks b LEFT JOIN rk ON b.block_id = rk.block_id GROUP BY b.block_id),
st AS (SELECT *, CASE WHEN coalesce(best, 0) <= 0.0001 THEN 'no_overlap' WHEN best - coalesce(second, 0) <= 625 THEN 'ambiguous_overlap' ELSE 'assigned' END AS status FROM top)
SELECT block_id, CASE WHEN status = 'assigned' THEN ward END AS ward_id, status FROM st""")
def jn_ring_ward(v):
    return S.ward_assign(v.blocks, shaped(v.wards))


@query(f""", lat AS (SELECT feat_id, minx + 5.0 + i * 10 AS x, miny + 5.0 + j * 10 AS y, minx, miny, maxx, maxy FROM (SELECT *, unnest(range(0, CAST(ceil((maxy - miny) / 10) AS BIGINT))) AS j FROM (SELECT *, unnest(range(0, CAST(ceil((maxx - minx) / 10) AS BIGINT))) AS i FROM feats) a) b),
hits AS (SELECT feat_id, x, y FROM lat WHERE {inside('x', 'y')})
SELECT feat_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM hits UNION ALL SELECT feat_id, (minx + maxx) / 2.0, (miny + maxy) / 2.0 FROM feats WHERE feat_id NOT IN (SELECT feat_id FROM hits) AND {WIDE} * {HIGH} * {LEFT} >= 25""")
def pl_ring_units(v):
    return R.lattice(shaped(v.feats), "feat_id", 10)


@query(f""", hits AS (SELECT f.feat_id, p.seg FROM feats f JOIN px p ON 300005 + p.c * 10 BETWEEN f.minx AND f.maxx AND 2000005 + p.r * 10 BETWEEN f.miny AND f.maxy WHERE {inside('(300005 + p.c * 10)', '(2000005 + p.r * 10)')}),
n AS (SELECT feat_id, count(CASE WHEN seg = 0 THEN 1 END) AS a, count(CASE WHEN seg = 1 THEN 1 END) AS b, count(seg) AS n FROM hits GROUP BY feat_id)
SELECT f.feat_id, round(coalesce(CAST(a AS DOUBLE) / nullif(n, 0), 0.0), 6) AS canopy, round(coalesce(CAST(b AS DOUBLE) / nullif(n, 0), 0.0), 6) AS imperv FROM feats f LEFT JOIN n ON f.feat_id = n.feat_id""")
def pl_ring_fractions(v):
    box = ["minx", "miny", "maxx", "maxy"]
    shapes = v.feats.groupBy(*box).agg(F.min("feat_id").alias("shape"))  # features of one shape count alike
    pixels = v.px.select("r", "c", *(e.cast("int").alias(c) for c, e in (("a", F.coalesce(F.col("seg") == 0, F.lit(False))), ("b", F.coalesce(F.col("seg") == 1, F.lit(False))), ("n", F.col("seg").isNotNull()))))
    n = R.pixel_counts(pixels, ["a", "b", "n"], shaped(shapes).select("shape", "rings", "holes"), "shape", 300000, 2000000, 10)
    share = lambda c: F.round(F.coalesce(F.try_divide(c, "n"), F.lit(0.0)), 6)
    found = shapes.join(n.hint("merge"), "shape").drop("shape")
    return v.feats.select("feat_id", *box).join(found.hint("merge"), box, "left").select("feat_id", share("a").alias("canopy"), share("b").alias("imperv"))


@query("SELECT unit_id, CAST(x + c_custkey % 8 / 8.0 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM units WHERE c_custkey % 5 <> 0 UNION ALL SELECT unit_id, NULL, NULL FROM units WHERE c_custkey % 5 = 0")
def fn_parse_ewkb(v):
    """Binary points, a fifth of them of another zone, read back."""
    x = F.col("x") + F.col("c_custkey") % 8 / F.lit(8.0)
    data = clip.point_ewkb(x, F.col("y").cast("double"), F.when(F.col("c_custkey") % 5 == 0, 4326).otherwise(32643))
    return v.units.select("unit_id", clip.parse_ewkb(data).alias("p")).select("unit_id", "p.x", "p.y")


def boxed(df):
    """df with its boxes as polygons."""
    ring = box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    return df.withColumns({"rings": F.array(ring), "holes": F.expr("cast(array() as array<array<struct<x:double,y:double>>>)")})


#: Boxes of wards and areas cut into elementary boxes, with the wards that cover each one and whether an area does.
ELEMENTS = """xs AS (SELECT DISTINCT unnest([minx, maxx]) AS v FROM (SELECT minx, maxx FROM wards UNION ALL SELECT minx, maxx FROM areas) t), ys AS (SELECT DISTINCT unnest([miny, maxy]) AS v FROM (SELECT miny, maxy FROM wards UNION ALL SELECT miny, maxy FROM areas) t),
xr AS (SELECT v AS x0, lead(v) OVER (ORDER BY v) AS x1 FROM xs), yr AS (SELECT v AS y0, lead(v) OVER (ORDER BY v) AS y1 FROM ys), el AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER () AS el FROM xr, yr WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
elw AS (SELECT el, w.ward_id, w.version FROM el JOIN wards w ON w.minx <= x0 AND w.maxx >= x1 AND w.miny <= y0 AND w.maxy >= y1), ela AS (SELECT DISTINCT el FROM el JOIN areas a ON a.minx <= x0 AND a.maxx >= x1 AND a.miny <= y0 AND a.maxy >= y1),
elp AS (SELECT a.ward_id AS a, b.ward_id AS b, sum(area) AS area FROM elw a JOIN elw b ON a.el = b.el AND a.ward_id < b.ward_id JOIN el ON el.el = a.el GROUP BY ALL HAVING sum(area) > 1.0)"""


@query(f""", {ELEMENTS}, s AS (SELECT CAST(coalesce(sum(CASE WHEN i.el IS NOT NULL AND w.el IS NULL THEN area END), 0) AS DOUBLE) AS gap_m2, CAST(coalesce(sum(CASE WHEN i.el IS NULL AND w.el IS NOT NULL THEN area END), 0) AS DOUBLE) AS extension_m2, CAST(sum(CASE WHEN i.el IS NOT NULL THEN area END) AS DOUBLE) AS boundary_m2
  FROM el LEFT JOIN ela i ON i.el = el.el LEFT JOIN (SELECT DISTINCT el FROM elw) w ON w.el = el.el), o AS (SELECT CAST(coalesce(sum(area), 0) AS DOUBLE) AS overlap_m2, count(*) AS pairs FROM elp)
SELECT gap_m2, extension_m2, CASE WHEN gap_m2 >= 100 THEN gap_m2 ELSE 0 END AS significant_gap_m2, CASE WHEN extension_m2 >= 100 THEN extension_m2 ELSE 0 END AS significant_extension_m2, overlap_m2, pairs, round(100 * gap_m2 / boundary_m2, 6) AS gap_percent FROM s, o""")
def set_mask_report(v):
    """Areas of gaps, extensions and overlaps of the wards against the areas, taken as the boundary."""
    row = V.mask_report(V.mask(boxed(v.wards), boxed(v.areas), "ward_id"))
    return row.select("pairs", F.round("gap_percent", 6).alias("gap_percent"), *(F.round(c, 4).alias(c) for c in row.columns if c.endswith("m2")))


@query(f", {ELEMENTS} SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(area AS DOUBLE) AS area FROM elp")
def set_overlap_pairs(v):
    return V.overlap_pairs(V.mask(boxed(v.wards), boxed(v.areas), "ward_id")).select("a", "b", F.round("area", 4).alias("area"))


@query(f", {ELEMENTS}, d AS (SELECT DISTINCT el, version FROM elw) SELECT CAST(d.version AS VARCHAR) AS version, (SELECT count(*) FROM wards w WHERE w.version = d.version) AS polygons, CAST(sum(area) AS DOUBLE) AS area FROM d JOIN el ON el.el = d.el GROUP BY d.version")
def agg_dissolve_areas(v):
    """The area that the wards of each version cover together."""
    return V.dissolve(boxed(v.wards), "ward_id", "version").withColumn("area", F.round("area", 4))


ROI = "SELECT 300500 AS minx, 2000500 AS miny, 302000 AS maxx, 2002000 AS maxy, 1 AS roi"


@query(f""", roi AS ({ROI}), {shared("p", "feats", "feat_id", "roi", "roi")} SELECT feat_id, round(area, 4) AS area FROM p""")
def vec_ring_clip(v):
    """Notched and holed features cut by the region of interest, with the area that is left of them."""
    cut = R.clip(shaped(v.feats).select("feat_id", "rings", "holes"), 300500, 2000500, 302000, 2002000)
    return R.areas(cut, "feat_id").filter("area > 0.000001").select("feat_id", F.round("area", 4).alias("area"))


@query(f"""SELECT area_id || '_0' AS part_id, round({WIDE} * {HIGH} * {LEFT} + 0.000001, 2) AS area FROM areas UNION ALL SELECT area_id || '_1', 1250.0::DOUBLE FROM areas""")
def vec_ring_parts(v):
    """Areas with a second part apart from them, one row for each part."""
    p = lambda dx, dy: F.struct((F.col("maxx") + dx).cast("double").alias("x"), (F.col("maxy") + dy).cast("double").alias("y"))
    two = shaped(v.areas).withColumn("rings", F.concat("rings", F.array(F.array(p(10, 10), p(60, 10), p(60, 60)))))
    parts = R.parts(two, "area_id")
    return R.areas(parts, "part_id").select("part_id", F.round(F.col("area") + 1e-6, 2).alias("area"))


@query("SELECT min(feat_id) AS feat_id, count(*) AS copies FROM feats GROUP BY minx, miny, maxx, maxy")
def set_dedupe_shapes(v):
    """The first feature of each shape, compared as a whole by its WKT."""
    wkt = F.format_string("POLYGON ((%.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f))", *(F.col(c).cast("double") for c in ("minx", "miny", "maxx", "miny", "maxx", "maxy", "minx", "maxy", "minx", "miny")))
    both = v.feats.withColumn("wkt", wkt)
    return W.dedupe_first(both, ["wkt"], "feat_id").select("feat_id", "wkt").join(both.groupBy("wkt").agg(F.count("*").alias("copies")), "wkt").select("feat_id", "copies")
