"""Nearest segments and running totals against plain loops."""

import math
import random

from pyspark.sql import functions as F

from verdantia.operators import nearest as N
from verdantia.operators import windows as W

X, Y = 300000.0, 2000000.0


def apart(x, y, line):
    x1, y1, x2, y2 = line
    dx, dy = x2 - x1, y2 - y1
    t = min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def frames(spark, points, lines):
    return spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")


def test_against_all_segments(spark):
    r = random.Random(1)
    lines = [(a, b, a + r.uniform(-900, 900), b + r.uniform(-900, 900)) for a, b in ((X + r.uniform(-20_000, 20_000), Y + r.uniform(-20_000, 20_000)) for _ in range(150))]
    lines += [(X + 5, Y + 5, X + 5, Y + 5), (X + 250, Y, X + 500, Y)]
    points = [(i, X + r.gauss(0, 15_000), Y + r.gauss(0, 15_000)) for i in range(300)] + [(900, X - 1e6, Y + 3e5), (901, X, Y), (902, X + 250, Y + 250)]
    got = {x.id: x.distance for x in N.nearest_distance(*frames(spark, points, lines), "id").collect()}
    assert set(got) == {p[0] for p in points}
    assert all(abs(got[i] - min(apart(x, y, q) for q in lines)) < 1e-6 for i, x, y in points)


def test_a_far_point_meets_few_segments(spark):
    """40,000 segments, one point 1000 km away: the cells that are left hold a small part of them."""
    lines = spark.range(40_000).select((F.lit(X) + F.col("id") % 200 * 100).alias("x1"), (F.lit(Y) + F.floor(F.col("id") / 200) * 100).alias("y1")).withColumns({"x2": F.col("x1") + 30, "y2": F.col("y1") + 20})
    cells = N.written(N.under_edges(lines, 250, X, Y).select(F.floor((F.col("xa") - X) / 250).alias("cx"), "cy").distinct())
    far = spark.createDataFrame([(-4_000_000 // 4, 700)], "px long, py long")
    assert N.candidates(far, cells, 250).count() < 0.05 * cells.count()


def test_prefix_sum_has_no_bounds_and_splits_ties(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("double").alias("lead"), (F.col("id") % 5).cast("decimal(9,2)").alias("v"))
    want, total = {}, 0
    for r in sorted(df.collect(), key=lambda r: (-r.lead, r.id)):
        total += r.v
        want[r.id] = total
    made = W.prefix_sum(df, "lead", "v", ("id",), descending=True, rows=100)
    assert {r.id: r.running for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "array" not in plan.lower() and "Cartesian" not in plan
