"""Comparisons of runs, audits and publish checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import FACTORS, POSITIVE
from .windows import average_rank

TIERS = {"Critical": 0, "High": 1, "Moderate": 2, "Low": 3}


def stability(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Pearson, Spearman (on average ranks), and the spread of absolute differences."""
    both = pairs.filter(F.col(old).isNotNull() & F.col(new).isNotNull())
    both = average_rank(average_rank(both, old, "ro"), new, "rn")
    gap = F.abs(F.col(new) - F.col(old))
    return both.agg(F.corr(old, new).alias("pearson"), F.corr("ro", "rn").alias("spearman"), F.max(gap).alias("max_abs"), F.median(gap).alias("median_abs"), F.avg(gap).alias("mean_abs"))


def tier_change(pairs: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """How many of all changed their tier, on each row of those that moved by two tiers or more (one row without a key if none did)."""
    rank = lambda c: F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col(c))
    both = pairs.select(key, F.abs(rank(new) - rank(old)).alias("move")).filter("move is not null")
    whole = both.agg(F.count_if(F.col("move") > 0).alias("changed"), (100.0 * F.count_if(F.col("move") > 0) / F.count("*")).alias("pct"), F.count_if(F.col("move") >= 2).alias("big_moves"))
    return whole.join(both.filter("move >= 2").select(key, "move"), F.lit(True), "left")


def distribution_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    x = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "factor", "x")
    g = x.groupBy("factor").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count_distinct("x").alias("uniques"))
    return g.withColumn("cv", F.try_divide(F.col("sd"), F.abs("mean")))


def delta_corr(pairs: DataFrame, a: Column, b: Column, c: Column, d: Column) -> DataFrame:
    return pairs.agg(F.corr(a - b, c - d).alias("corr"))


def population_qa(pop: DataFrame, value: str, reference: float) -> DataFrame:
    x = F.col(value)
    return pop.agg(
        F.count_if(x.isNull()).alias("missing"), F.count_if(x < 0).alias("negative"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("total"), (F.abs(F.sum(x) - reference) <= 1e-6 * abs(reference)).alias("conserved"),
    )


def slope_qa(px: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return px.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.median(x).alias("median"), F.round(100.0 * F.count_if(x.isNull()) / F.count("*"), 6).alias("nodata_pct"), (F.count_if(~x.between(0, 90)) == 0).alias("in_range"))


def dw_decision(row: DataFrame) -> DataFrame:
    """A: fractions agree; B: they differ but the built probability is high; C: else."""
    return row.withColumn("decision", F.when(F.abs(F.col("gap")) <= 0.05, "A").when(F.col("median_probability") >= 0.5, "B").otherwise("C"))


def checks(rows: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(name, ok): each aggregate condition over its table."""
    out = None
    for name, df, condition in rows:
        one = df.agg(condition.alias("ok")).select(F.lit(name).alias("name"), F.coalesce("ok", F.lit(False)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def consistency(weights: DataFrame, config: DataFrame, scored: DataFrame, expected: int) -> DataFrame:
    """(name, ok) of the nine checks of a scored run, from one aggregate over factors and one over blocks.

    weights (factor, w); config (factor, positive, source), a row for each factor; scored (score), NULL for excluded
    blocks; expected: the number of blocks.
    """
    f = weights.join(config, "factor", "left")
    up = F.try_element_at(F.create_map(*(F.lit(x) for kv in POSITIVE.items() for x in kv)), F.col("factor"))
    whole = lambda c: F.coalesce(F.every(F.coalesce(c, F.lit(False))), F.lit(False))
    told = f.agg(
        F.coalesce(F.abs(F.sum("w") - 1) <= 1e-9, F.lit(False)).alias("weights_sum_to_one"), (F.count_if(F.col("factor") == "water_availability") == 0).alias("no_water_factor"),
        (F.count_if(F.col("factor") == "pm25") > 0).alias("pm25_active"), whole(F.col("positive") == up).alias("directions_correct"),
        (F.count_if(F.lower("source").contains("synthetic")) == 0).alias("no_synthetic_source"), whole(F.col("source").isNotNull()).alias("all_have_provenance"),
        (F.count("*") == len(FACTORS)).alias("factor_count"),
    )
    x = F.col("score")
    blocks = scored.agg((F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))) == 0).alias("scores_finite"), (F.count("*") == expected).alias("block_count"))
    return told.crossJoin(blocks).unpivot([], [*told.columns, *blocks.columns], "name", "ok")  # one row each


def gate(found: DataFrame) -> DataFrame:
    return found.agg(F.every("ok").alias("promote"), F.count("*").alias("checks"))


def cross_run_conflict(table: DataFrame, run: str) -> DataFrame:
    return table.agg(F.coalesce(F.bool_or(F.col("run_id") != run), F.lit(False)).alias("conflict"))
