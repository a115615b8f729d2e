"""What must hold of the published tables: metrics in one table, rules in another, and the list of rules that are broken."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that name no expected number: nothing of the kind may be found.
NONE_OF = ("excluded_with_score", "scorable_without_score", "orphaned_carbon", "orphaned_units", "orphaned_scenarios")


def counts(df: DataFrame, **named: Column) -> DataFrame:
    """(metric, value) of conditions counted in one pass; all rows where the condition is None."""
    row = df.agg(*(F.count("*").alias(n) if c is None else F.count_if(c).alias(n) for n, c in named.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value")) for n in named))
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def metrics(blocks: DataFrame, carbon: DataFrame, areas: DataFrame, units: DataFrame, scenarios: DataFrame, mapped: DataFrame) -> DataFrame:
    """(metric, value) of the published tables.

    blocks (block_id, excluded, score, risk), carbon (block_id, canopy_m2, trees, agb_kg, co2_t), areas and units (valid),
    units also (unit_id), scenarios (scenario), mapped (scenario, unit_id). Each table is read once, besides the joins.
    """
    excluded, scored = F.col("excluded"), F.col("score").isNotNull() | F.col("risk").isNotNull()
    complete = F.col("score").isNotNull() & F.col("risk").isNotNull()
    whole = F.col("canopy_m2").isNotNull() & F.col("trees").isNotNull() & F.col("agb_kg").isNotNull() & F.col("co2_t").isNotNull()
    sizes = scenarios.select("scenario").join(mapped, "scenario", "left").groupBy("scenario").agg(F.count("unit_id").alias("n"))
    parts = [
        counts(blocks, blocks=None, excluded_blocks=excluded, excluded_with_score=excluded & scored, scorable_without_score=~excluded & ~complete),
        counts(carbon, carbon_blocks=None, carbon_complete=whole),
        counts(areas, candidate_areas=None, candidate_areas_valid=F.col("valid")),
        counts(units, planting_units=None, planting_units_valid=F.col("valid")),
        counts(mapped, scenario_mappings=None),
        sizes.agg(F.array_join(F.array_sort(F.collect_list("n")), ", ").alias("value")).select(F.lit("scenario_counts").alias("metric"), "value"),  # a number for each scenario
        counts(carbon.join(blocks.select("block_id"), "block_id", "left_anti"), orphaned_carbon=None),
        counts(mapped.join(units.select("unit_id"), "unit_id", "left_anti"), orphaned_units=None),
        counts(mapped.join(scenarios.select("scenario"), "scenario", "left_anti"), orphaned_scenarios=None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rules(df: DataFrame, expected: dict[str, int | Iterable[int]]) -> DataFrame:
    """(metric, expected): the expected numbers, sorted lists of them, and zeros of NONE_OF."""
    text = {n: ", ".join(map(str, sorted(v))) if isinstance(v, (list, tuple, set)) else str(v) for n, v in {**dict.fromkeys(NONE_OF, 0), **expected}.items()}
    return df.sparkSession.createDataFrame(list(text.items()), "metric string, expected string")


def broken(found: DataFrame, ruled: DataFrame) -> DataFrame:
    """(metric, expected, value, error) of each rule that doesn't hold; a metric that is missing breaks its rule, unless nothing is expected."""
    met = ruled.join(found, "metric", "left").withColumn("value", F.coalesce("value", F.when(F.col("expected") == "0", "0")))
    shown = F.coalesce("value", F.lit("nothing"))
    text = F.when(F.col("expected") == "0", F.concat("metric", F.lit(": found "), shown, F.lit(", none is allowed"))).otherwise(F.concat("metric", F.lit(": expected "), "expected", F.lit(", found "), shown))
    return met.filter(~F.col("expected").eqNullSafe(F.col("value"))).select("metric", "expected", "value", text.alias("error"))
