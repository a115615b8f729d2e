"""Regions against a flood fill."""

import random

import pytest
from pyspark.sql import functions as F

from verdantia.operators import regions as G
from verdantia.operators import rings as R


def flood(cells):
    """{pixel: smallest pixel of its region}"""
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p not in out and cells.get(p) == cells[start]:
                    out[p] = start
                    todo.append(p)
    return out


def spiral(n):
    """A path of class 1 that winds inwards, class 0 between its arms."""
    cells = {(r, c): 0 for r in range(n) for c in range(n)}
    r, c, dr, dc = 0, 0, 0, 1
    cells[0, 0] = 1
    while True:
        turned = 0
        while turned < 2:
            a, b = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
            if a in cells and cells[a] == 0 and cells.get(b) != 1:
                break
            dr, dc = dc, -dr
            turned += 1
        else:
            return cells
        r, c = r + dr, c + dc
        cells[r, c] = 1


def frame(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r long, c long, seg int")


def noise(n, seed, classes=3):
    r = random.Random(seed)
    return {(a - 5, b - 9): r.choice([*range(classes), None]) for a in range(n) for b in range(n)}


@pytest.mark.parametrize("cells,tile", [(spiral(41), 8), (noise(40, 1), 7), (noise(30, 2, 2), 64)])
def test_regions_areas_and_outlines(spark, cells, tile):
    known = {k: v for k, v in cells.items() if v is not None}
    want = flood(known)
    made = G.label(frame(spark, cells), "seg", tile).cache()
    assert {(x.r, x.c): (x.region.r, x.region.c) for x in made.collect()} == want
    size, sides = {}, {}
    for p, root in want.items():
        size[root] = size.get(root, 0) + 1
        sides[root] = sides.get(root, 0) + sum(known.get(q) != known[p] for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)))
    sums = G.outlines(made, "seg", tile).groupBy("region").agg(F.sum(F.col("x1") * (F.col("y2") - F.col("y1"))).alias("area"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("length"))
    assert {tuple(x.region): (x.area, x.length) for x in sums.collect()} == {k: (size[k], sides[k]) for k in size}
    shapes = G.polygons(made, "seg", tile).cache()
    assert {tuple(x.region): x.area for x in R.areas(shapes, "region").collect()} == size
    named = shapes.withColumn("name", F.struct(F.col("region.r").alias("a"), F.col("region.c").alias("b")))
    back = R.rasterize(named, "region", "name", 0, 0, 1)
    assert {(x.r, x.c): tuple(x.value) for x in back.collect()} == want



def test_wide_images_keep_their_regions_apart(spark):
    cells = {(0, 999_999): 1, (0, 1_000_000): 1, (1, 0): 1, (0, 1_999_999): 2, (1, 1_999_999): 2}
    assert {(x.r, x.c): (x.region.r, x.region.c) for x in G.label(frame(spark, cells), "seg").collect()} == flood(cells)


def test_rounds_do_not_grow_with_length(spark, monkeypatch):
    rounds = []
    write = G.written
    monkeypatch.setattr(G, "written", lambda df, *a: (rounds.append(1), write(df, *a))[1])
    n = {}
    for far in (1000, 16_000):
        rounds.clear()
        G.label(spark.range(far).select(F.lit(0).alias("r"), F.col("id").alias("c"), F.lit(1).alias("seg")), "seg", 4).count()
        n[far] = len(rounds)
    assert n[16_000] <= n[1000] + 10
