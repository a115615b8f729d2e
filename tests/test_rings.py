"""Polygons with slants, notches, parts and holes against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from verdantia.operators import rings as R

SCHEMA = "k long, name string, rings array<array<struct<x double, y double>>>, holes array<array<struct<x double, y double>>>"


def star(r, x, y, far):
    n = r.randrange(3, 9)
    turn = sorted(r.random() * 2 * math.pi for _ in range(n))
    return [(x + far * r.uniform(0.3, 1) * math.cos(a), y + far * r.uniform(0.3, 1) * math.sin(a)) for a in turn]


def shapes(seed, n=12):
    r = random.Random(seed)
    out = [
        (1, "slant", [[(3.0, 1.0), (95.0, 88.0), (92.0, 91.0), (0.5, 4.0)]], []),
        (2, "notch", [[(10.0, 10.0), (60.0, 10.0), (60.0, 60.0), (35.0, 35.0), (10.0, 60.0)]], []),
        (3, "ring", [[(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0), (0.0, 0.0)]], [[(10.0, 10.0), (20.0, 40.0), (40.0, 20.0)]]),
        (4, "two", [[(70.0, 70.0), (90.0, 70.0), (80.0, 95.0)], [(5.0, 70.0), (5.0, 90.0), (25.0, 90.0)]], []),
        (5, "none", [], []),
        (6, "line", [[(1.0, 1.0), (2.0, 2.0)]], None),
    ]
    for k in range(n):
        x, y = r.uniform(-50, 120), r.uniform(-50, 120)
        outer = [(x - 30, y - 31), (x + 33, y - 28.5), (x + 29, y + 30), (x - 27.5, y + 26)]
        out.append((10 + k, f"n{k}", [outer] if k % 2 else [star(r, x, y, 40)], [star(r, x, y, 12)] if k % 2 else []))
    return out


def frame(spark, rows):
    at = lambda rings: None if rings is None else [[{"x": x, "y": y} for x, y in ring] for ring in rings]
    return spark.createDataFrame([(k, n, at(a), at(b)) for k, n, a, b in rows], SCHEMA)


def clipped_area(ring, minx, miny, maxx, maxy):
    """Area of a ring within a box by four half-plane clips."""
    pts = [(x - minx, y - miny) for x, y in ring]
    for axis, limit, below in ((0, 0.0, False), (0, maxx - minx, True), (1, 0.0, False), (1, maxy - miny, True)):
        out = []
        for a, b in zip(pts, pts[1:] + pts[:1]):
            ia, ib = ((p[axis] <= limit) if below else (p[axis] >= limit) for p in (a, b))
            if ia:
                out.append(a)
            if ia != ib:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        pts = out
        if not pts:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2


def usable(row):
    return [q for q in row[2] + (row[3] or []) if len(q) > 2]


def inside(row, x, y):
    odd = False
    for ring in usable(row):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax:
                odd = not odd
    return odd


def clipped(row, box):
    return sum(clipped_area(q, *box) for q in row[2] if len(q) > 2) - sum(clipped_area(q, *box) for q in row[3] or [])


def meets(a, b, x0, y0, x1, y1):
    """Whether the segment meets the closed box (its range of the parameter isn't empty)."""
    lo, hi = 0.0, 1.0
    for p, q, low, high in ((a[0], b[0], x0, x1), (a[1], b[1], y0, y1)):
        d = q - p
        if d == 0:
            if not low <= p <= high:
                return False
            continue
        s, t = sorted(((low - p) / d, (high - p) / d))
        lo, hi = max(lo, s), min(hi, t)
    return lo <= hi


def test_pixels(spark):
    rows = shapes(1)
    got = {(r.r, r.c): r.value for r in R.rasterize(frame(spark, rows), "k", "name", -60, -60, 2.5).collect()}
    want = {}
    for row in sorted(rows):
        for r in range(-20, 90):
            for c in range(-20, 90):
                if inside(row, -60 + (c + 0.5) * 2.5, -60 + (r + 0.5) * 2.5):
                    want[r, c] = row[1]
    assert got == want


def test_shared_edges_share_no_pixel(spark):
    left = (1, "a", [[(0.0, 0.0), (5.0, 0.0), (8.0, 10.0), (0.0, 10.0)]], [])
    right = (2, "b", [[(5.0, 0.0), (12.0, 0.0), (12.0, 10.0), (8.0, 10.0)]], [])
    each = [{(r.r, r.c) for r in R.rasterize(frame(spark, [x]), "k", "name", 0, 0, 1).collect()} for x in (left, right)]
    assert not each[0] & each[1] and each[0] | each[1] == {(r, c) for r in range(10) for c in range(12)}


def test_cells(spark):
    rows = shapes(2)
    size, lo = 7.0, -60.0
    got = {(r.k, r.cx, r.cy): r.edges is not None for r in R.cover(frame(spark, rows), "k", size, lo, lo).collect()}
    want = {}
    for row in rows:
        pts = [p for ring in usable(row) for p in ring]
        if not pts:
            continue
        span = [range(math.floor((min(p[i] for p in pts) - lo) / size), math.floor((max(p[i] for p in pts) - lo) / size) + 1) for i in (0, 1)]
        for cx in span[0]:
            for cy in span[1]:
                x, y = lo + cx * size, lo + cy * size
                rim = any(meets(a, b, x, y, x + size, y + size) for ring in usable(row) for a, b in zip(ring, ring[1:] + ring[:1]))
                if rim or inside(row, x + size / 2, y + size / 2):
                    want[row[0], cx, cy] = rim
    assert got == want


def test_slanted_strip_covers_in_proportion_to_its_length(spark):
    n = {}
    for far in (10_000.0, 40_000.0):
        strip = frame(spark, [(1, "s", [[(0.0, 0.0), (far, far), (far - 1, far + 1), (-1.0, 1.0)]], [])])
        n[far] = R.cover(strip, "k", 250, 0, 0).count()
    assert n[40_000.0] < 4.3 * n[10_000.0] < 4.3 * 3.2 * 41


def test_points(spark):
    rows = shapes(3)
    r = random.Random(9)
    pts = [(i, r.uniform(-60, 150), r.uniform(-60, 150)) for i in range(1500)] + [(9000 + i, float(10 * (i % 10)), float(10 * (i // 10))) for i in range(100)]
    got = {(x.i, x.k) for x in R.points_in(spark.createDataFrame(pts, "i long, x double, y double"), frame(spark, rows), "k", 7.0, 0, 0).collect()}
    assert got == {(i, row[0]) for i, x, y in pts for row in rows if inside(row, x, y)}


def test_shared_areas(spark):
    rows = shapes(4)
    r = random.Random(8)
    boxes = [(i, x := r.uniform(-60, 120), y := r.uniform(-60, 120), x + r.uniform(0.5, 60), y + r.uniform(0.5, 60)) for i in range(60)]
    got = {(x.b, x.k): x.area for x in R.overlaps(spark.createDataFrame(boxes, "b long, minx double, miny double, maxx double, maxy double"), "b", frame(spark, rows), "k", 7.0, 0, 0).collect()}
    want = {(b[0], row[0]): a for b in boxes for row in rows if (a := clipped(row, b[1:])) > 1e-6}
    assert {k for k, v in got.items() if v > 1e-6} == set(want) and all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-7) for k, v in want.items())
    whole = {x.k: x.area for x in R.areas(frame(spark, rows), "k").collect()}
    assert all(whole[row[0]] == pytest.approx(clipped(row, (-500, -500, 500, 500))) for row in rows if usable(row))


def test_no_python_and_no_nested_loop(spark):
    df = R.overlaps(spark.range(3).select(F.col("id").alias("b"), *(F.lit(float(i)).alias(c) for i, c in enumerate(("minx", "miny", "maxx", "maxy")))), "b", frame(spark, shapes(5)), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_lattice(spark):
    rows = shapes(6) + [(90, "thin", [[(0.0, 0.0), (100.0, 0.0), (100.0, 3.0), (0.0, 3.0)]], []), (91, "tiny", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]], [])]
    got = {}
    for r in R.lattice(frame(spark, rows), "k", 10.0).collect():
        got.setdefault(r.k, set()).add((round(r.x, 9), round(r.y, 9)))
    for row in rows:
        pts = [p for ring in usable(row) for p in ring]
        if not pts:
            assert row[0] not in got
            continue
        x0, y0 = min(p[0] for p in pts), min(p[1] for p in pts)
        want = {(round(x, 9), round(y, 9)) for i in range(20) for j in range(20) if inside(row, x := x0 + (i + 0.5) * 10, y := y0 + (j + 0.5) * 10)}
        assert want == got.get(row[0], set()) or not want and (row[1] == "tiny" or row[0] in got and inside(row, *next(iter(got[row[0]]))))
    assert got[90] == {(50.0, 1.5)} and 91 not in got


def test_allocation_within_a_polygon(spark):
    from verdantia.operators import spatial

    x, y = 300000.0, 2000000.0
    cells = spark.createDataFrame([(1, x, y, x + 100, y + 100, 100.0), (2, x + 100, y, x + 200, y + 100, 300.0)], "cell int, minx double, miny double, maxx double, maxy double, pop double")
    blocks = spark.createDataFrame([("a", x, y, x + 50, y + 250), ("b", x + 50, y, x + 300, y + 250)], "block_id string, minx double, miny double, maxx double, maxy double")
    slant = [(x, y), (x + 200, y), (x, y + 100)]  # half of both cells together
    hole = [(x + 10, y + 10), (x + 30, y + 10), (x + 30, y + 30), (x + 10, y + 30)]
    got = {r.block_id: (r.value, r.cells) for r in spatial.area_weighted(cells, blocks, "pop", "cell", frame(spark, [(1, "city", [slant], [hole])]).drop("name")).collect()}
    want = {"a": (clipped_area(slant, x, y, x + 50, y + 100) - 400) / 100, "b": clipped_area(slant, x + 50, y, x + 100, y + 100) / 100 + 3 * clipped_area(slant, x + 100, y, x + 200, y + 100) / 100}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and got["b"][1] == 2


@pytest.mark.parametrize("order", "<>")
def test_ewkb(spark, order):
    import struct

    from verdantia.functions.clip import parse_ewkb

    r = random.Random(2)
    numbers = [(380000.0, 2040000.0), (-1.5, 0.0), (1e-310, 1.7e308), (2.0**-1022, 3.0)] + [(r.uniform(-1e6, 1e6), r.uniform(-1e9, 1e9)) for _ in range(50)]
    point = lambda x, y: struct.pack(order + "IIdd", 0x20000001, 32643, x, y)
    first = b"\x01" if order == "<" else b"\x00"
    rows = [(i, first + point(*p)) for i, p in enumerate(numbers)] + [(100, first + struct.pack(order + "Idd", 1, 5.0, 6.0))]
    bad = [first + struct.pack(order + "IIdd", 0x20000001, 4326, 1.0, 2.0), b"x", b"", None, first + struct.pack(order + "Idd", 2, 1.0, 2.0), first + point(1.0, 2.0)[:-1], b"\x07" + point(1.0, 2.0)]
    rows += [(200 + i, b) for i, b in enumerate(bad)] + [(300, first + point(float("inf"), float("nan")))]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, b binary").select("i", parse_ewkb(F.col("b")).alias("p")).collect()}
    assert [tuple(got[i]) for i in range(len(numbers))] == numbers and tuple(got[100]) == (5.0, 6.0) and tuple(got[300]) == (None, None)
    assert all(got[200 + i] is None for i in range(len(bad)))


def test_clip_keeps_parts_and_holes(spark):
    rows = shapes(7)
    box = (10.0, 12.0, 70.0, 66.0)
    got = {r.k: r for r in R.clip(frame(spark, rows), *box).collect()}
    for row in rows:
        want = clipped(row, box)
        outer = sum(clipped_area(q, *box) for q in row[2] if len(q) > 2)
        assert (row[0] in got) == (outer > 0)
        if row[0] in got:
            r = got[row[0]]
            pts = [(p.x, p.y) for q in r.rings + r.holes for p in q]
            assert all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in pts)
            new = (row[0], "", [[(p.x, p.y) for p in q] for q in r.rings], [[(p.x, p.y) for p in q] for q in r.holes])
            assert clipped(new, (-999, -999, 999, 999)) == pytest.approx(want, abs=1e-9)
            r_ = random.Random(row[0])
            for _ in range(60):
                x, y = r_.uniform(box[0], box[2]), r_.uniform(box[1], box[3])
                assert inside(new, x, y) == inside(row, x, y)
    assert R.clip(frame(spark, rows), 900, 900, 950, 950).count() == 0


def test_parts(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    far = [(200.0, 0.0), (240.0, 0.0), (240.0, 40.0)]
    rows = [(1, "m", [sq(0.0, 100.0), sq(20.0, 60.0), far], [sq(10.0, 70.0), sq(30.0, 40.0), [(230.0, 5.0), (236.0, 5.0), (236.0, 10.0)]]), (2, "e", [], []), (3, "z", [[(1.0, 1.0), (2.0, 2.0)], sq(0.0, 1.0)], None)]
    got = {r.part_id: ([(p.x, p.y) for p in r.rings[0]], [[(p.x, p.y) for p in h] for h in r.holes]) for r in R.parts(frame(spark, rows), "k").collect()}
    assert got == {"1_0": (sq(0.0, 100.0), [sq(10.0, 70.0)]), "1_1": (sq(20.0, 60.0), [sq(30.0, 40.0)]), "1_2": (far, [rows[0][3][2]]), "3_0": (sq(0.0, 1.0), [])}
