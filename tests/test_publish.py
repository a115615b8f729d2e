"""Each discrepancy of published tables comes out by name, and nothing else does."""

import pytest
from pyspark.sql import functions as F

from verdantia.operators import publish as P

EXPECTED = {"blocks": 20, "carbon_blocks": 20, "carbon_complete": 20, "excluded_blocks": 2, "candidate_areas": 7, "candidate_areas_valid": 7, "planting_units": 50, "planting_units_valid": 50, "scenario_mappings": 35, "scenario_counts": [20, 5, 10]}


def tables(spark):
    i = F.col("id")
    blocks = spark.range(20).select(i.cast("string").alias("block_id"), (i < 2).alias("excluded"), F.when(i >= 2, i * 1.0).alias("score"), F.when(i >= 2, "Low").alias("risk"))
    carbon = spark.range(20).select(i.cast("string").alias("block_id"), *(F.lit(1.0).alias(c) for c in ("canopy_m2", "trees", "agb_kg", "co2_t")))
    areas, units = spark.range(7).select(F.lit(True).alias("valid")), spark.range(50).select(i.alias("unit_id"), F.lit(True).alias("valid"))
    sizes = {"a": 5, "b": 10, "c": 20}
    scenarios = spark.createDataFrame([(s,) for s in sizes], "scenario string")
    mapped = spark.createDataFrame([(s, u) for s, n in sizes.items() for u in range(n)], "scenario string, unit_id long")
    return {"blocks": blocks, "carbon": carbon, "areas": areas, "units": units, "scenarios": scenarios, "mapped": mapped}


FLAWS = {
    "none": (lambda t: t, set()),
    "a block is missing": (lambda t: t | {"blocks": t["blocks"].filter("block_id != '9'")}, {"blocks", "orphaned_carbon"}),
    "an excluded block has a risk": (lambda t: t | {"blocks": t["blocks"].withColumn("risk", F.when(F.col("block_id") == "1", "Low").otherwise(F.col("risk")))}, {"excluded_with_score"}),
    "a block has no risk": (lambda t: t | {"blocks": t["blocks"].withColumn("risk", F.when(F.col("block_id") != "7", F.col("risk")))}, {"scorable_without_score"}),
    "one more is excluded": (lambda t: t | {"blocks": t["blocks"].withColumns({"excluded": F.col("block_id") < "3", "score": F.when(F.col("block_id") >= "3", F.lit(1.0)), "risk": F.when(F.col("block_id") >= "3", "Low")})}, {"excluded_blocks"}),
    "a stock is missing": (lambda t: t | {"carbon": t["carbon"].withColumn("agb_kg", F.when(F.col("block_id") != "7", 1.0))}, {"carbon_complete"}),
    "bad shapes": (lambda t: t | {"areas": t["areas"].withColumn("valid", F.lit(None).cast("boolean")), "units": t["units"].withColumn("valid", F.col("unit_id") > 0)}, {"candidate_areas_valid", "planting_units_valid"}),
    "a unit is gone": (lambda t: t | {"units": t["units"].filter("unit_id != 3")}, {"planting_units", "planting_units_valid", "orphaned_units"}),
    "a scenario is gone": (lambda t: t | {"scenarios": t["scenarios"].filter("scenario != 'b'")}, {"scenario_counts", "orphaned_scenarios"}),
    "a mapping is gone": (lambda t: t | {"mapped": t["mapped"].filter("not (scenario = 'a' and unit_id = 0)")}, {"scenario_mappings", "scenario_counts"}),
    "all is empty": (lambda t: {k: v.limit(0) for k, v in t.items()}, set(EXPECTED)),
}


@pytest.mark.parametrize("flaw", FLAWS)
def test_each_flaw_by_name(spark, flaw):
    change, want = FLAWS[flaw]
    found = P.metrics(**change(tables(spark)))
    errors = P.broken(found, P.rules(found, EXPECTED)).collect()
    assert {r.metric for r in errors} == want
    assert all(r.error.startswith(r.metric + ": ") and r.value in r.error for r in errors)


def test_a_missing_metric_breaks_its_rule(spark):
    found = spark.createDataFrame([("blocks", "20")], "metric string, value string")
    assert {r.metric for r in P.broken(found, P.rules(found, EXPECTED)).collect()} == set(EXPECTED) - {"blocks"}
