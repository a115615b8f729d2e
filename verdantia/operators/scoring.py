"""The scoring chain: normalisation, entropy weights, score, risk, diagnostics.

Statistics over all blocks are one aggregate; its single row joins back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTORS = ("ndvi", "tree_density", "pm25", "temperature", "impervious_surfaces", "population_exposure")
POSITIVE = {"ndvi": True, "tree_density": True, "pm25": False, "temperature": False, "impervious_surfaces": False, "population_exposure": False}
DEGENERATE_SHARE, DEGENERATE_CAP, PM25_WEIGHT = 0.95, 0.03, 0.02


def minmax(df: DataFrame, columns: dict[str, bool] | None = None) -> DataFrame:
    """df with n_<column> in [0, 1]: rising if True, falling if False; a constant column gives 0."""
    columns = columns or POSITIVE
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    made = df.crossJoin(F.broadcast(ends))  # one row
    for c, up in columns.items():
        lo, hi, x = F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(c)
        made = made.withColumn(f"n_{c}", F.when(hi == lo, F.lit(0.0)).otherwise(F.try_divide(x - lo if up else hi - x, hi - lo)))
    return made.drop(*ends.columns)


def long_form(df: DataFrame, columns) -> DataFrame:
    """(factor, x): NaN as NULL."""
    return df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns)).unpivot([], list(columns), "factor", "x")


def entropy_raw(df: DataFrame, columns=FACTORS) -> DataFrame:
    """(factor, constant, w): Shannon diversity weights in two passes over the long form."""
    x = long_form(df, columns)
    ends = x.groupBy("factor").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    y = x.join(F.broadcast(ends), "factor")  # a row for each factor
    y = y.withColumn("y", F.when(F.col("lo") < 0, F.col("x") - F.col("lo") + 1e-12).otherwise(F.col("x")))
    sums = y.groupBy("factor", "lo", "hi", "n").agg(F.sum("y").alias("s"), F.sum(F.when(F.col("y") > 0, F.col("y") * F.ln("y"))).alias("t"))
    constant = F.col("lo").isNull() | (F.col("lo") == F.col("hi"))
    h = (F.ln("s") - F.try_divide(F.col("t"), F.col("s"))) / F.ln(F.greatest(F.col("n"), F.lit(2)).cast("double"))
    sums = sums.withColumns({"constant": constant, "d": F.when(constant, 0.0).otherwise(F.greatest(1 - h, F.lit(0.0)))})
    all_ = W.partitionBy()
    even = (F.col("n") <= 1) | (F.min(F.col("constant").cast("int")).over(all_) == 1)
    total = F.sum("d").over(all_)
    return sums.select("factor", "constant", F.when(even, 1.0 / len(columns)).otherwise(F.col("d") / F.when(total == 0, 1.0).otherwise(total)).alias("w"))


def modal_share(df: DataFrame, columns=FACTORS) -> DataFrame:
    """(factor, share): of the most common value among non-NULL ones."""
    n = long_form(df, columns).filter("x is not null").groupBy("factor", "x").count()
    return n.groupBy("factor").agg((F.max("count") / F.sum("count")).alias("share"))


def entropy_weights(df: DataFrame, columns=FACTORS, cap: float = DEGENERATE_CAP) -> DataFrame:
    """(factor, w): raw weights; a degenerate factor has at most `cap`, what it loses goes to the others in proportion."""
    raw = entropy_raw(df, columns).join(modal_share(df, columns), "factor", "left")
    held = (F.coalesce("share", F.lit(1.0)) > DEGENERATE_SHARE) & ~F.col("constant") & (F.col("w") > cap)
    all_ = W.partitionBy()
    raw = raw.withColumn("held", held)
    free = F.sum(F.when(~F.col("held"), F.col("w"))).over(all_)
    spare = F.sum(F.when(F.col("held"), F.col("w") - cap).otherwise(0.0)).over(all_)
    w = F.when((spare <= 0) | F.coalesce(free <= 0, F.lit(True)), F.col("w")).when(F.col("held"), cap).otherwise(F.col("w") * (1 + F.try_divide(spare, free)))
    return raw.select("factor", w.alias("w"))


def fixed_weight(df: DataFrame, columns=FACTORS, fixed: str = "pm25", weight: float = PM25_WEIGHT) -> DataFrame:
    """Entropy weights of the other factors share 1 - weight; `fixed` has `weight`."""
    rest = entropy_weights(df, [c for c in columns if c != fixed]).select("factor", (F.col("w") * (1 - weight)).alias("w"))
    return rest.unionByName(df.sparkSession.range(1).select(F.lit(fixed).alias("factor"), F.lit(weight).alias("w")))


def config_weights(df: DataFrame, config: DataFrame) -> DataFrame:
    """(factor, w) of a static configuration, for the factors that df has."""
    return config.filter(F.col("factor").isin(df.columns)).select("factor", F.col("weight").alias("w"))


def weight_row(weights: DataFrame, columns=FACTORS) -> DataFrame:
    """One row with w_<factor> columns."""
    return weights.agg(*(F.max(F.when(F.col("factor") == c, F.col("w"))).alias(f"w_{c}") for c in columns))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def base_score(columns=FACTORS) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(f"w_{c}") * F.col(f"n_{c}")
    return clip(100 * total, 0.0, 100.0)


def synergy(vegetation: str = "ndvi") -> Column:
    return 0.1 * F.col(f"n_{vegetation}") * F.col("n_temperature") * 100


def population_multiplier() -> Column:
    return 1 - 0.3 * (1 - F.col("n_population_exposure"))


def round2(x: Column) -> Column:
    """Half-even on the scaled value."""
    return F.rint(x * 100) / 100


def risk_level(score: Column) -> Column:
    return F.when(score < 25, "Critical").when(score < 50, "High").when(score < 75, "Moderate").when(score.isNotNull(), "Low")


def score_blocks(df: DataFrame, weights: DataFrame, vegetation: str = "ndvi", multiplier: Column | None = None) -> DataFrame:
    """df with base, synergy, multiplier, score and risk."""
    made = minmax(df).crossJoin(F.broadcast(weight_row(weights)))  # one row
    made = made.withColumns({"base": base_score(), "syn": synergy(vegetation), "mult": multiplier if multiplier is not None else population_multiplier()})
    made = made.withColumn("score", round2(clip((F.col("base") + F.col("syn")) * F.col("mult"), 0.0, 100.0)))
    return made.withColumn("risk", risk_level(F.col("score")))


def split_eligible(factors: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scorable, excluded) after a one-to-one join; a repeated key or a missing status stops the run."""
    for df in (factors, status):
        if not df.groupBy("block_id").count().filter("count > 1").isEmpty():
            raise ValueError("block_id repeats")
    both = factors.join(status, "block_id", "left")
    if not both.filter("score_status is null").isEmpty():
        raise ValueError("a block has no status")
    return both.filter("score_status = 'scorable'"), both.filter("score_status != 'scorable'")


def assemble(scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """All blocks in the order of their id; excluded ones have neither score nor risk."""
    none = excluded.withColumns({"score": F.lit(None).cast("double"), "risk": F.lit(None).cast("string")})
    return scored.unionByName(none, allowMissingColumns=True).orderBy("block_id")


def diagnostics(df: DataFrame, columns=FACTORS) -> DataFrame:
    """Per factor: spread, distinct values, most common value (smallest of equals) and its share, raw and final weight."""
    x = long_form(df, columns)
    stats = x.groupBy("factor").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("sd"), F.count_distinct("x").alias("n_unique"), F.count("x").alias("n"),
    )
    n = x.filter("x is not null").groupBy("factor", "x").count()
    mode = n.groupBy("factor").agg(F.min_by("x", F.struct(-F.col("count"), F.col("x"))).alias("modal"), F.max("count").alias("most"))
    made = stats.join(mode, "factor", "left").join(entropy_raw(df, columns).select("factor", "constant", F.col("w").alias("raw_weight")), "factor").join(entropy_weights(df, columns).withColumnRenamed("w", "weight"), "factor")
    return made.withColumns({"cv": F.try_divide(F.col("sd"), F.abs("mean")), "modal_share": F.try_divide(F.col("most"), F.col("n"))}).withColumn("degenerate", F.col("modal_share") > DEGENERATE_SHARE).drop("most")


def factor_table(blocks: DataFrame, families: list[DataFrame]) -> DataFrame:
    """Left joins of the factor families on block_id."""
    for f in families:
        blocks = blocks.join(f, "block_id", "left")
    return blocks
