"""Views that bind the library's data model to the driver's tables.

The texts are plain SQL that Spark and DuckDB read alike, in integers until the last step, so both sides of a comparison
start from equal rows. Pixels are 10 m, blocks 25 x 25 pixels, coordinates metres from (300000, 2000000).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import io

VIEWS: dict[str, str] = {
    # one row per observation of a pixel
    "obs": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 300 AS r, (l_partkey * 13 + l_suppkey) % 300 AS c,
  (l_partkey + l_linenumber) % 4 AS seg, CAST(round(l_discount * 100) AS BIGINT) * 8 - 10 AS nd, 250 + 4 * CAST(l_quantity AS BIGINT) AS te,
  CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS bldg, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS road, month(l_shipdate) AS mon, l_shipdate AS ts,
  l_partkey % 100 AS cloud, CASE WHEN l_partkey % 37 = 0 THEN 1 ELSE 0 END AS nodata, CAST(l_quantity AS BIGINT) AS people, l_suppkey % 12 AS scl, l_partkey % 32 AS qa,
  1000 + l_partkey % 3000 AS red, 1500 + l_suppkey * 7 % 4000 AS nir, 30000 + (l_orderkey * 31) % 20000 AS dn
FROM lineitem""",
    # one row per pixel; NULL where no observation is valid
    "px": """
SELECT r, c, max(CASE WHEN nodata = 0 THEN seg END) AS seg, max(CASE WHEN nodata = 0 THEN nd END) AS nd, max(CASE WHEN nodata = 0 THEN te END) AS te,
  max(CASE WHEN nodata = 0 THEN bldg END) AS bldg, max(CASE WHEN nodata = 0 OR l_linenumber < 3 THEN road END) AS road, CAST(sum(people) AS BIGINT) AS people,
  CAST(floor(r / 25) AS BIGINT) AS bi, CAST(floor(c / 25) AS BIGINT) AS bj,
  'PN_' || CAST(CAST(floor(r / 25) AS BIGINT) AS STRING) || '_' || CAST(CAST(floor(c / 25) AS BIGINT) AS STRING) AS block_id,
  max(CASE WHEN (r + c) % 19 = 0 THEN 0 ELSE 1 END) AS inside
FROM obs GROUP BY r, c""",
    "blocks": """
SELECT block_id, bi, bj, 300000 + 250 * bj AS minx, 2000000 + 250 * bi AS miny, 300250 + 250 * bj AS maxx, 2000250 + 250 * bi AS maxy, count(*) AS pixels
FROM px GROUP BY block_id, bi, bj""",
    "factors": """
SELECT block_id, avg(nd) / 100 AS ndvi, CAST(count(CASE WHEN seg = 0 THEN 1 END) AS DOUBLE) / count(seg) AS tree_density, CAST(20 + (max(bi) * 7 + max(bj) * 3) % 15 AS DOUBLE) AS pm25,
  avg(te) / 10 AS temperature, CAST(count(CASE WHEN seg = 1 OR bldg = 1 OR road = 1 THEN 1 END) AS DOUBLE) / count(*) AS impervious_surfaces,
  CAST(sum(people) AS DOUBLE) AS population_exposure
FROM px GROUP BY block_id""",
    "elig": """
SELECT block_id, CASE WHEN (bi * 12 + bj) % 17 = 0 THEN 'insufficient_source_coverage' ELSE 'scorable' END AS score_status FROM blocks""",
    # blocks with a score in hundredths (NULL: excluded), and a second run of them
    "scored": """
SELECT b.block_id, b.bi, b.bj, b.minx, b.miny, b.maxx, b.maxy, CASE WHEN e.score_status = 'scorable' THEN (b.bi * 977 + b.bj * 613) % 10001 / 100.0E0 END AS score,
  (b.bi * 389 + b.bj * 811) % 10001 / 100.0E0 AS old_score, 'run_' || CAST(b.bi % 2 AS STRING) AS run_id
FROM blocks b JOIN elig e ON b.block_id = e.block_id""",
    "areas": """
SELECT n_nationkey AS area_id, n_name AS name, 300000 + (n_nationkey * 97) % 2000 AS minx, 2000000 + (n_nationkey * 61) % 2000 AS miny,
  300300 + (n_nationkey * 97) % 2000 + (n_nationkey * 37) % 900 AS maxx, 2000200 + (n_nationkey * 61) % 2000 + (n_nationkey * 53) % 700 AS maxy
FROM nation""",
    "wards": """
SELECT r_regionkey AS ward_id, r_name AS name, 300000 + 600 * r_regionkey - CASE WHEN r_regionkey = 4 THEN 330 ELSE 0 END AS minx, 2000000 AS miny,
  300600 + 600 * r_regionkey AS maxx, 2002900 AS maxy, r_regionkey % 2 AS version
FROM region""",
    "units": """
SELECT 'PU_' || CAST(c_custkey AS STRING) AS unit_id, c_custkey, c_nationkey AS area_id, 300000 + (c_custkey * 7919) % 3000 AS x, 2000000 + (c_custkey * 10473) % 3000 AS y,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(round((c_acctbal + 1000) * 100) AS BIGINT) END AS value, c_mktsegment AS segment
FROM customer""",
    "water": """
SELECT s_suppkey AS water_id, 300000 + (s_suppkey * 523) % 3000 AS x1, 2000000 + (s_suppkey * 709) % 3000 AS y1,
  300000 + (s_suppkey * 523) % 3000 + 40 AS x2, 2000000 + (s_suppkey * 709) % 3000 + 30 AS y2, CASE WHEN s_suppkey % 3 = 0 THEN 'river' WHEN s_suppkey % 3 = 1 THEN 'lake' ELSE 'canal' END AS kind
FROM supplier""",
    # planting units with a priority in cents
    "ranked": """
SELECT 'PU_' || CAST(o_orderkey AS STRING) AS unit_id, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS priority, 25 + o_orderkey % 40 AS area, 1 + o_custkey % 500 AS cost,
  o_orderpriority AS risk, o_orderstatus AS status
FROM orders""",
    "scen": """
SELECT 'a_100' AS scenario, 100 AS k UNION ALL SELECT 'b_250' AS scenario, 250 AS k UNION ALL SELECT 'c_500' AS scenario, 500 AS k UNION ALL SELECT 'd_none' AS scenario, 0 AS k""",
    "bridge": """
SELECT s.scenario, q.unit_id FROM (SELECT unit_id, row_number() OVER (ORDER BY priority DESC, unit_id) AS rank FROM (SELECT unit_id, priority FROM ranked ORDER BY priority DESC, unit_id LIMIT 500) t) q JOIN scen s ON q.rank <= s.k""",
    "activity": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'e' || CAST(event_id % 5 AS STRING) END AS entity, value, props, CASE WHEN user_id % 3 = 0 THEN 'admin' WHEN user_id % 3 = 1 THEN 'researcher' ELSE 'visitor' END AS role
FROM events""",
    "feats": """
SELECT p_partkey AS feat_id, 300000 + (p_partkey * 37) % 2900 AS minx, 2000000 + (p_partkey * 53) % 2900 AS miny, 300000 + (p_partkey * 37) % 2900 + 5 + p_size + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 40 END AS maxx,
  2000000 + (p_partkey * 53) % 2900 + 10 + p_size % 30 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 60 END AS maxy, CASE WHEN p_partkey % 3 = 0 THEN 'building' WHEN p_partkey % 3 = 1 THEN 'canopy' ELSE 'impervious' END AS kind,
  CASE p_partkey % 7 WHEN 0 THEN 'military' WHEN 1 THEN 'grass' WHEN 2 THEN 'quarry' WHEN 3 THEN 'forest' WHEN 4 THEN NULL WHEN 5 THEN 'recreation_ground' ELSE 'landfill' END AS landuse,
  CASE p_partkey % 5 WHEN 0 THEN 'park' WHEN 1 THEN 'garden' ELSE NULL END AS leisure, CASE WHEN p_partkey % 11 = 0 THEN 'school' END AS amenity, p_name AS name, p_brand AS brand
FROM part""",
    "carbon": """
SELECT block_id, CAST(62500 AS DOUBLE) AS block_area, CAST(CAST(floor(people_sum) AS BIGINT) % 60000 AS DOUBLE) AS canopy_m2, CASE WHEN (bi + bj) % 7 = 0 THEN 0.0E0 ELSE CAST((bi * 5 + bj * 3) % 22 AS DOUBLE) END AS height, run_id
FROM (SELECT p.block_id, max(p.bi) AS bi, max(p.bj) AS bj, sum(p.people) AS people_sum, 'run_' || CAST(max(p.bi) % 2 AS STRING) AS run_id FROM px p GROUP BY p.block_id) t""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Views:
    """The driver's tables and the views over them as DataFrames; v.px, v.lineitem, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(VIEWS[name])
        return self._made[name]

    def hold(self, *names: str) -> None:
        """Write views that a query reads more than once to the shared folder, in this order; they are read back from there."""
        for name in names:
            path = io.scratch(self.spark, name)
            made = getattr(self, name)
            made.write.parquet(path)
            self._made[name] = self.spark.read.schema(made.schema).parquet(path)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views that text names."""
        words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text, re.I))
        used = {w: getattr(self, w) for w in words if w in VIEWS or w in TABLES}
        for w in used:
            text = re.sub(rf"(FROM|JOIN)\s+{w}\b", rf"\1 {{{w}}}", text, flags=re.I)
        return self.spark.sql(text, **used)


def with_views(body: str) -> str:
    """body as DuckDB SQL with every view in front; its own views may be recursive."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in VIEWS.items()) + "\n" + body
