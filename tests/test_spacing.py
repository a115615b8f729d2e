"""Minimum distances against the greedy loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from verdantia.operators import spacing as S


def greedy(points, d):
    kept, near = [], {}
    for k, x, y in sorted(points):
        c = (math.floor(x / d), math.floor(y / d))
        around = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in near.get((c[0] + a, c[1] + b), ()))
        if all(math.hypot(x - a, y - b) > d - 1e-4 for a, b in around):
            kept.append(k)
            near.setdefault(c, []).append((x, y))
    return kept


@pytest.mark.parametrize("crowd,doublings", [(200_000, 10), (25, 2)])
def test_equals_the_greedy_loop(spark, monkeypatch, crowd, doublings):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "DOUBLINGS", doublings)
    r = random.Random(4)
    pts = [(i, r.uniform(-300, 300), r.uniform(-300, 300)) for i in range(1500)] + [(5000 + i, 7.0, 7.0) for i in range(40)] + [(6000 + i, r.gauss(50, 3), r.gauss(50, 3)) for i in range(300)]
    r.shuffle(pts)
    df = spark.createDataFrame([*pts, (9999, None, 1.0)], "id long, x double, y double")
    assert sorted(x.id for x in S.enforce_spacing(df, "id", 10.0).collect()) == [*greedy(pts, 10.0), 9999]


def test_a_chain_of_many_points_takes_few_rounds(spark, monkeypatch):
    """200,000 points in a row, each too close to the next, in key order: every second one stays."""
    n, rounds = 200_000, []
    decide = S.decide
    monkeypatch.setattr(S, "decide", lambda d: (rounds.append(1), decide(d))[1])
    pts = spark.range(n).select("id", (F.col("id") * 9.0).alias("x"), (F.col("id") % 3 * 0.5).alias("y"))
    kept = S.enforce_spacing(pts, "id", 10.0)
    assert kept.count() == n // 2 and kept.filter("id % 2 = 1").isEmpty()
    assert len(rounds) <= 8
