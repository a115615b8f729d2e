"""Operators whose plans or rounds must not grow with pairs: results against plain loops, and plans without broadcasts of exploded rows."""

import math
import random

from pyspark.sql import functions as F

from verdantia.operators import nearest as N
from verdantia.operators import rings as R
from verdantia.operators import spacing as G
from verdantia.operators import spatial as S
from verdantia.operators import windows as O
from verdantia.plans import catalog
from verdantia.plans.q_carbon_planting import P
from verdantia.sources.io import scratch
from verdantia.streaming import activity as A

from .test_rate import SECOND, fold
from .test_rate import frame as requests
from .test_rings import frame, shapes


def joins(df) -> str:
    """The joins of a plan, by their names."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(w for w in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "SortMergeJoin", "ShuffledHashJoin") if w in plan)


def inside(rings, x, y):
    """Even-odd rule; upper and right edges are outside."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax
    return n % 2 == 1


def test_pixel_counts(spark):
    """Pixels left of and below the origin, missing ones and one counted twice, in strips of 7."""
    r = random.Random(3)
    pixels = [(i, j, r.randrange(3), 1) for i in range(-30, 60) for j in range(-30, 60) if r.random() < 0.8]
    pixels.append(pixels[100])
    rows = shapes(5)
    made = R.pixel_counts(spark.createDataFrame(pixels, "r long, c long, a int, n int"), ["a", "n"], frame(spark, rows), "k", 1.0, 2.0, 3.0, 7)
    got = {x.k: (x.a, x.n) for x in made.collect() if x.n}
    want = {}
    for k, _, outer, holes in rows:
        held = [(a, n) for i, j, a, n in pixels if inside([q for q in outer + (holes or []) if len(q) > 2], 1 + 3 * (j + 0.5), 2 + 3 * (i + 0.5))]
        if held:
            want[k] = tuple(map(sum, zip(*held)))
    assert got == want and len(want) > 9
    assert "Broadcast" not in joins(made)


def test_ring_fractions_send_no_polygons_to_the_driver(spark, sf):
    assert "Broadcast" not in joins(catalog.QUERIES["pl_ring_fractions"](spark, sf))


def test_lattice_needs_no_join(spark, sf):
    """No broadcast of boxes or edges; a polygon in two parts with nothing at half its height has no middle."""
    two = [(1, "two", [[(0.0, 0.0), (9.0, 0.0), (4.0, 4.0)], [(0.0, 99.0), (9.0, 99.0), (4.0, 96.0)]], []), (2, "thin", [[(0.0, 0.0), (100.0, 0.0), (100.0, 3.0), (0.0, 3.0)]], None)]
    made = R.lattice(frame(spark, two), "k", 10.0)
    assert [(r.k, r.x, r.y) for r in made.collect()] == [(2, 50.0, 1.5)]
    assert joins(made) == "" and joins(catalog.QUERIES["pl_ring_units"](spark, sf)) == ""


def test_overlay_counts_cells_before_they_meet(spark, sf):
    """A thousand features over one cell are one row of it, and nothing is broadcast."""
    boxes = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a").alias("kind"), *(F.lit(v).alias(c) for c, v in (("minx", 300001), ("miny", 2000001), ("maxx", 300012), ("maxy", 2000002))))
    got = {(r.kind, r.cx, r.cy): r.n for r in S.cell_counts(boxes, ["kind"], 10).collect()}
    assert got == {(k, x, 0): 500 for k in ("a", None) for x in (0, 1)}
    assert joins(catalog.QUERIES["jn_overlay_split"](spark, sf)) == "SortMergeJoin"


def test_cells_minus_is_one_pass(spark, sf):
    """No join; a cell without a number equals none of the others'."""
    cells = lambda *rows: spark.createDataFrame(rows, "cx long, cy long")
    made = O.cells_minus(cells((1, 1), (1, 1), (2, 1), (None, 1), (3, 3)), [cells((2, 1), (None, 1)), cells((3, 3), (4, 4))])
    assert {(r.cx, r.cy) for r in made.collect()} == {(1, 1), (None, 1)} and made.count() == 2
    assert joins(made) == "" and joins(catalog.QUERIES["set_cells_minus"](spark, sf)) == ""


def test_equal_segments_and_points_meet_once(spark, monkeypatch):
    """5000 copies of a segment and of two points: only the points are as many rows when they are read and told their distance."""
    lines = spark.range(5000).select(*(F.lit(float(v)).alias(c) for c, v in (("x1", 300010), ("y1", 2000010), ("x2", 300040), ("y2", 2000050))))
    points = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 300010.0).otherwise(300013.0).alias("x"), F.when(F.col("id") % 2 == 0, 2000000.0).otherwise(2000014.0).alias("y"))
    sizes, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df: (made := write(df), sizes.append(made.count()))[0])
    got = N.nearest_distance(points, lines, "id").groupBy("id").agg(F.max("distance").alias("d"), F.count("*").alias("n")).collect()
    assert all(abs(r.d - (10.0 if r.id % 2 == 0 else 0.0)) < 1e-9 and r.n == 1 for r in got) and len(got) == 5000
    assert sum(sizes) < 5000 + 100


def test_cells_shrink_with_dense_segments(spark):
    """20,000 different segments of 5 m over 1 km2: a point measures some of them, not those of 21 cells of 250 m."""
    r = random.Random(2)
    at = [(300000 + r.uniform(0, 1000), 2000000 + r.uniform(0, 1000)) for _ in range(20_000)]
    lines = spark.createDataFrame([(x, y, x + 4.0, y + 3.0) for x, y in at], "x1 double, y1 double, x2 double, y2 double")
    assert N.fine(lines, 250) < 16
    assert N.fine(lines.withColumn("x2", F.col("x1") + 400), 250) == 250 and N.fine(lines.filter("false"), 250) == 250 and N.fine(lines.limit(1), 250) > 0
    points = [(i, 300000 + r.uniform(-50, 1050), 2000000 + r.uniform(-50, 1050)) for i in range(50)]
    got = {p.id: p.distance for p in N.nearest_distance(spark.createDataFrame(points, "id long, x double, y double"), lines, "id").collect()}
    for i, x, y in points:
        want = min(math.hypot(x - a - 4 * t, y - b - 3 * t) for a, b in at for t in [min(max(((x - a) * 4 + (y - b) * 3) / 25, 0), 1)])
        assert abs(got[i] - want) < 1e-6


def test_candidates_find_water_before_they_meet_scores(spark, sf, monkeypatch):
    """The points that are held against water come from features alone; no pixel is read for them."""
    seen, found = [], P.nearest_distance
    monkeypatch.setattr(P, "nearest_distance", lambda points, *a: (seen.append(points._jdf.queryExecution().executedPlan().toString()), found(points, *a))[1])
    assert catalog.QUERIES["pl_candidates"](spark, sf).count() > 0
    assert "part.parquet" in seen[0] and "lineitem.parquet" not in seen[0]


def test_buffer_meets_places_not_rows(spark):
    """Copies of points and segments are told apart by their places; a point without coordinates is near nothing."""
    r = random.Random(8)
    lines = [(300000 + r.randrange(2000), 2000000 + r.randrange(2000)) for _ in range(40)]
    points = [(i, 299900.0 + r.randrange(2200), 1999900.0 + r.randrange(2200)) for i in range(400)]
    far = lambda x, y, a, b: (lambda t: math.hypot(x - a - 40 * t, y - b - 30 * t))(min(max(((x - a) * 40 + (y - b) * 30) / 2500, 0), 1))
    segments = spark.createDataFrame([(a, b, a + 40, b + 30) for a, b in lines] * 5, "x1 long, y1 long, x2 long, y2 long")
    copies = spark.createDataFrame([(f"{i}_{k}", x, y) for i, x, y in points for k in range(3)] + [("none", None, 1.0)], "id string, x double, y double")
    made = S.within_buffer(copies, segments, 60.5, "id")
    assert made.columns == ["id", "x", "y"]
    near = {i for i, x, y in points if any(far(x, y, a, b) <= 60.5 for a, b in lines)}
    assert 20 < len(near) < 380 and sorted(p.id for p in made.collect()) == sorted(f"{i}_{k}" for i in near for k in range(3))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert joins(made) == "SortMergeJoin" and "Aggregate [x1" in plan and "Aggregate [x" in plan.replace("[x1", "")


def test_spacing_drops_copies_before_the_first_round(spark, monkeypatch):
    """60,000 points at 20 places: the rounds see the places. Points without finite coordinates stay, copies or not."""
    nan, inf = float("nan"), float("inf")
    points = spark.range(60_000).select("id", (F.col("id") % 20 * 7.0).alias("x"), F.lit(1.0).alias("y"))
    odd = spark.createDataFrame([(70_000 + i, x, 1.0) for i, x in enumerate((nan, nan, inf, inf, None, None))], "id long, x double, y double")
    sizes, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df: (made := write(df), sizes.append(made.count()))[0])
    kept = G.enforce_spacing(points.unionByName(odd), "id", 10.0)
    assert sorted(r.id for r in kept.collect()) == [*range(0, 20, 2), *range(70_000, 70_006)]
    assert kept.columns == ["id", "x", "y"] and max(sizes) <= 20
    # closer than nothing: all copies stay
    assert G.enforce_spacing(points.limit(40), "id", 5e-5).count() == 40


def test_rate_limit_stream_costs_by_slots_and_batches(spark):
    """3000 keys over four runs of one checkpoint, in 2 slots: decisions equal one fold; a run's state has the partitions asked for, and its files are one batch."""
    from os import listdir

    A_SLOTS, A.SLOTS = A.SLOTS, 2
    try:
        r = random.Random(6)
        rows = sorted(((f"k{r.randrange(3000)}", i, (1_700_000_000 + r.randrange(20_000)) * SECOND) for i in range(12_000)), key=lambda x: x[2])
        src, out = scratch(spark, "requests"), scratch(spark, "decisions")
        for part in (rows[:3000], rows[3000:3100], rows[3100:8000], rows[8000:]):
            requests(spark, part).coalesce(1).write.mode("append").parquet(src)
            stream = A.rate_limit(A.read_stream(spark, src, requests(spark, rows[:1]).schema), "k", 2, 900)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
        assert {x.event_id: (x.allowed, x.remaining, x.retry_after) for x in spark.read.parquet(out).collect()} == fold(rows, 2, 900)[0]
    finally:
        A.SLOTS = A_SLOTS
    told = A.run_now(A.rate_limit(A.replay(requests(spark, rows), scratch(spark, "replayed")), "k", 2, 900), "limits", partitions=3)
    assert told.count() == len(rows) and spark.conf.get("spark.sql.shuffle.partitions") == "8"
    state = told.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "-state"
    assert sorted(x for x in listdir(f"{state}/state/0") if x.isdigit()) == ["0", "1", "2"]
    assert len([x for x in listdir(f"{state}/offsets") if x.isdigit()]) <= 2  # the rows, and the watermark after them


def test_first_overlap(spark, monkeypatch):
    """Against all pairs, in many rounds; touching boxes share nothing, and a rival without a number doesn't count."""
    monkeypatch.setattr(S, "FIRST", 4)
    monkeypatch.setattr(S, "TIMES", 2)
    r = random.Random(9)
    box = lambda far, wide: (lambda x, y: (x, y, x + r.randrange(wide), y + r.randrange(1, wide)))(300000 + r.randrange(-300, far), 2000000 + r.randrange(-300, far))
    a = [(i, *box(1500, 60)) for i in range(300)]
    b = [(-1000 + 7 * i, f"n{i}", *box(1500, 300)) for i in range(60)]
    b += [(9000, "late", 300000, 2000000, 301400, 2001400), (8000, "twice", *b[3][2:]), (None, "no", 299000, 1999000, 302000, 2002000)]
    sides = "minx long, miny long, maxx long, maxy long"
    made = S.first_overlap(spark.createDataFrame([*a, *((1000 + i, *q) for i, *q in a)], f"k long, {sides}"), "k", spark.createDataFrame(b, f"other long, name string, {sides}"), "other", ["name"])
    want = {}
    for i, x0, y0, x1, y1 in a:
        met = [(o, n) for o, n, u0, v0, u1, v1 in b if o is not None and min(x1, u1) > max(x0, u0) and min(y1, v1) > max(y0, v0)]
        if met:
            want[i] = want[1000 + i] = min(met)
    got = made.collect()
    assert {x.k: (x.other, x.name) for x in got} == want and len(got) == len(want) and {"late"} < {n for _, n in want.values()}


def test_first_overlap_of_a_crowd_ends_early(spark, monkeypatch):
    """8000 different boxes over one another: all have met the first ones after a round, and the rest of the pairs is not made."""
    sizes, write = [], S.written
    monkeypatch.setattr(S, "written", lambda df: (made := write(df), sizes.append(made.count()))[0])
    crowd = spark.range(8000).select("id", *(F.lit(v).alias(c) for c, v in (("minx", 300000), ("miny", 2000000))), (300001 + F.col("id")).alias("maxx"), F.lit(2000001).alias("maxy"))
    got = S.first_overlap(crowd, "id", crowd.withColumnRenamed("id", "other"), "other", [], 100_000)
    assert got.filter("other = 0").count() == 8000
    assert sizes == [8000, 8000, 8000, 0]  # rivals, boxes, what the first round found, what it left
