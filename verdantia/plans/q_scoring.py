"""Queries of the scoring chain."""

from pyspark.sql import functions as F

from ..operators import scoring as S
from .catalog import query

ENDS = ", ".join(f"min({c}) OVER () AS lo_{c}, max({c}) OVER () AS hi_{c}" for c in S.FACTORS)
NORM = ", ".join(f"CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({f'{c} - lo_{c}' if up else f'hi_{c} - {c}'}) / (hi_{c} - lo_{c}) END AS n_{c}" for c, up in S.POSITIVE.items())
NORMED = f"normed AS (SELECT block_id, {NORM} FROM (SELECT *, {ENDS} FROM factors) t)"
LONG = "longf AS (" + " UNION ALL ".join(f"SELECT '{c}' AS factor, CAST({c} AS DOUBLE) AS x FROM factors" for c in S.FACTORS) + ")"


def entropy_sql(where: str = "true", n: int = 6, out: str = "raww") -> str:
    return f"""{out}_s AS (SELECT factor, min(x) AS lo, max(x) AS hi, count(*) AS n, sum(x) AS s, sum(CASE WHEN x > 0 THEN x * ln(x) END) AS t FROM longf WHERE {where} GROUP BY factor),
{out}_d AS (SELECT factor, lo = hi AS constant, CASE WHEN lo = hi THEN 0.0 ELSE greatest(1 - (ln(s) - t / s) / ln(n), 0.0) END AS d FROM {out}_s),
{out} AS (SELECT factor, constant, d / sum(d) OVER () AS w FROM {out}_d)"""


SHARE = "shares AS (SELECT factor, CAST(max(k) AS DOUBLE) / sum(k) AS share FROM (SELECT factor, x, count(*) AS k FROM longf GROUP BY factor, x) t GROUP BY factor)"


def weights_sql(raw: str, out: str) -> str:
    return f"""{out}_h AS (SELECT r.factor, r.w, s.share > 0.95 AND NOT r.constant AND r.w > 0.03 AS held FROM {raw} r JOIN shares s ON r.factor = s.factor),
{out}_t AS (SELECT *, sum(CASE WHEN NOT held THEN w END) OVER () AS free, sum(CASE WHEN held THEN w - 0.03 ELSE 0.0 END) OVER () AS spare FROM {out}_h),
{out} AS (SELECT factor, CASE WHEN spare <= 0 THEN w WHEN held THEN 0.03 ELSE w * (1 + spare / free) END AS w FROM {out}_t)"""


FIXED = f"""{entropy_sql("factor <> 'pm25'", 5, "rawf")},
{weights_sql("rawf", "five")},
fixed AS (SELECT factor, w * 0.98 AS w FROM five UNION ALL SELECT 'pm25', 0.02)"""
CHAIN = f""", {NORMED}, {LONG}, {SHARE}, {FIXED},
wr AS (SELECT {", ".join(f"max(CASE WHEN factor = '{c}' THEN w END) AS w_{c}" for c in S.FACTORS)} FROM fixed),
chain AS (SELECT block_id, least(greatest(100 * ({" + ".join(f"w_{c} * n_{c}" for c in S.FACTORS)}), 0.0), 100.0) AS base, 0.1 * n_ndvi * n_temperature * 100 AS syn, 1 - 0.3 * (1 - n_population_exposure) AS mult FROM normed, wr),
result AS (SELECT *, round_even(least(greatest((base + syn) * mult, 0.0), 100.0) * 100, 0) / 100 AS score FROM chain)
"""
RISK = "CASE WHEN score < 25 THEN 'Critical' WHEN score < 50 THEN 'High' WHEN score < 75 THEN 'Moderate' WHEN score IS NOT NULL THEN 'Low' END"


@query(f", {NORMED} SELECT block_id, round(n_ndvi, 6) AS n_ndvi, round(n_tree_density, 6) AS n_tree_density FROM normed")
def sc_minmax(v):
    return S.minmax(v.factors, {"ndvi": True, "tree_density": True}).select("block_id", *(F.round(c, 6).alias(c) for c in ("n_ndvi", "n_tree_density")))


@query(f", {NORMED} SELECT block_id, round(n_temperature, 6) AS n_temperature FROM normed")
def sc_minmax_inv(v):
    return S.minmax(v.factors, {"temperature": False}).select("block_id", F.round("n_temperature", 6).alias("n_temperature"))


@query(f", {LONG}, {entropy_sql()} SELECT factor, round(w, 6) AS w FROM raww")
def sc_entropy_raw(v):
    return S.entropy_raw(v.factors).select("factor", F.round("w", 6).alias("w"))


@query(f", {LONG}, {SHARE} SELECT factor, round(share, 6) AS share FROM shares")
def sc_modal_share(v):
    return S.modal_share(v.factors).select("factor", F.round("share", 6).alias("share"))


@query(f", {LONG}, {SHARE}, {entropy_sql()}, {weights_sql('raww', 'final')} SELECT factor, round(w, 6) AS w FROM final")
def sc_entropy_weights(v):
    v.hold("factors")
    return S.entropy_weights(v.factors).select("factor", F.round("w", 6).alias("w"))


@query(f", {LONG}, {SHARE}, {FIXED} SELECT factor, round(w, 6) AS w FROM fixed")
def sc_fixed_weight(v):
    v.hold("factors")
    return S.fixed_weight(v.factors).select("factor", F.round("w", 6).alias("w"))


@query("SELECT factor, CAST(w AS DOUBLE) AS w FROM (VALUES ('ndvi', 0.3), ('pm25', 0.1)) t(factor, w)")
def sc_config_weights(v):
    config = v.region.select(F.element_at(F.array(*map(F.lit, ["ndvi", "pm25", "absent", "absent2", "absent3"])), (F.col("r_regionkey") + 1).cast("int")).alias("factor"), F.element_at(F.array(*map(F.lit, [0.3, 0.1, 0.2, 0.2, 0.2])), (F.col("r_regionkey") + 1).cast("int")).alias("weight"))
    return S.config_weights(v.factors, config)


def scored_chain(v):
    v.hold("px", "factors")
    return S.score_blocks(v.factors, S.fixed_weight(v.factors))


def _part(name):
    @query(f"{CHAIN} SELECT block_id, round({name[1]}, 6) AS {name[1]} FROM result", name=name[0])
    def build(v):
        return scored_chain(v).select("block_id", F.round(name[1], 6).alias(name[1]))

    return build


for _name in (("sc_base", "base"), ("sc_synergy", "syn"), ("sc_pop_multiplier", "mult"), ("sc_score", "score")):
    _part(_name)


@query(f"SELECT block_id, {RISK} AS risk FROM scored")
def sc_risk(v):
    return v.scored.select("block_id", S.risk_level(F.col("score")).alias("risk"))


@query(f"SELECT block_id, score, {RISK} AS risk FROM scored ORDER BY block_id")
def sc_assemble(v):
    done = v.scored.filter("score is not null").select("block_id", "score", S.risk_level(F.col("score")).alias("risk"))
    return S.assemble(done, v.scored.filter("score is null").select("block_id")).select("block_id", "score", "risk")


@query(f""", {LONG}, {SHARE}, {entropy_sql()}, {weights_sql('raww', 'final')}
SELECT l.factor, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS sd, count(DISTINCT x) AS n_unique,
  round(max(share), 6) AS modal_share, max(share) > 0.95 AS degenerate, round(max(f.w), 6) AS weight
FROM longf l JOIN shares s ON l.factor = s.factor JOIN final f ON l.factor = f.factor GROUP BY l.factor""")
def sc_diagnostics(v):
    v.hold("factors")
    d = S.diagnostics(v.factors)
    return d.select("factor", *(F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "median", "sd")), "n_unique", F.round("modal_share", 6).alias("modal_share"), "degenerate", F.round("weight", 6).alias("weight"))


@query("SELECT b.block_id, round(f.ndvi, 6) AS ndvi, f.pm25, e.score_status FROM blocks b LEFT JOIN (SELECT * FROM factors WHERE block_id NOT LIKE '%_7') f ON b.block_id = f.block_id LEFT JOIN elig e ON b.block_id = e.block_id")
def sc_factor_table(v):
    few = v.factors.filter(~F.col("block_id").endswith("_7"))
    return S.factor_table(v.blocks.select("block_id"), [few.select("block_id", F.round("ndvi", 6).alias("ndvi")), few.select("block_id", "pm25"), v.elig])


@query(f"""{CHAIN} SELECT risk, count(*) AS blocks, round(avg(score), 6) AS mean_score FROM (SELECT {RISK} AS risk, score FROM result r JOIN elig e ON r.block_id = e.block_id WHERE score_status = 'scorable') t GROUP BY risk""", name="flagship_block_scores")
def flagship_block_scores(v):
    """Pixels to factors to weights to scores to a summary by risk."""
    done = scored_chain(v).join(v.elig.filter("score_status = 'scorable'"), "block_id", "left_semi")
    return done.groupBy("risk").agg(F.count("*").alias("blocks"), F.round(F.avg("score"), 6).alias("mean_score"))
