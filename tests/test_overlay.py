"""Overlays against areas worked out by hand and by inclusion and exclusion."""

import math
import random

import pytest

from verdantia.operators import overlay as V

RING = "array<array<struct<x double, y double>>>"


def frame(spark, shapes):
    at = lambda rings: [[{"x": float(x), "y": float(y)} for x, y in q] for q in rings]
    return spark.createDataFrame([(k, at(a), at(b)) for k, (a, b) in shapes.items()], f"k string, rings {RING}, holes {RING}")


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def cut(poly, clip):
    """The part of a convex polygon within another, both counter-clockwise."""
    out = poly
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        pts, out = out, []
        for p, q in zip(pts, pts[1:] + pts[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                f = s / (s - t)
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
    return out


def area(poly):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1])) / 2


def convex(r, x, y, far):
    return [(x + far * math.cos(a), y + far * math.sin(a)) for a in sorted(r.random() * 2 * math.pi for _ in range(r.randrange(3, 8)))]


def test_convex_polygons_by_inclusion_and_exclusion(spark):
    r = random.Random(3)
    shapes = {f"p{i}": ([convex(r, r.uniform(0, 60), r.uniform(0, 60), r.uniform(15, 50))], []) for i in range(4)}
    got = {}
    for row in V.pieces(frame(spark, shapes), "k", 17.0, 0, 0).collect():
        got[tuple(row.ids)] = got.get(tuple(row.ids), 0) + row.area
    names = sorted(shapes)
    for bits in range(1, 16):
        some = [n for i, n in enumerate(names) if bits >> i & 1]
        both = shapes[some[0]][0][0]
        for n in some[1:]:
            both = cut(both, shapes[n][0][0]) if both else both
        held = sum(v for k, v in got.items() if set(some) <= set(k))
        assert held == pytest.approx(area(both) if both else 0, abs=1e-6)


def test_report(spark):
    city = {"c": ([square(0, 0, 1000, 1000)], [square(400, 400, 600, 600)])}
    wards = {
        "a": ([[(0, 0), (500, 0), (500, 1000), (0, 1000)]], [square(400, 400, 500, 600)]),
        "b": ([[(490, 0), (1000, 0), (1000, 980), (490, 980)]], []),  # covers a strip of a, the hole's other half, and leaves a gap of 20 m
        "s": ([[(1000, 0), (1000.5, 0), (1000.5, 1), (1000, 1)]], []),  # a sliver outside
        "t": ([[(999, 0), (1000, 0), (1000, 0.5)]], []),  # a sliver on b
    }
    found = V.mask(frame(spark, wards), frame(spark, city), "k").cache()
    pairs = {(x.a, x.b): x.area for x in V.overlap_pairs(found).collect()}
    shared = 10 * 980 - 10 * 200  # the strip, less a's hole
    assert pairs == {("a", "b"): pytest.approx(shared)}
    row = V.mask_report(found).first()
    extension = 0.5 + 110 * 200 - 10 * 200 + 10 * 200  # the sliver, and b over the hole
    assert (row.gap_m2, row.extension_m2, row.overlap_m2, row.pairs) == (pytest.approx(500 * 20), pytest.approx(extension), pytest.approx(shared), 1)
    assert row.significant_gap_m2 == row.gap_m2 and row.gap_percent == pytest.approx(100 * 500 * 20 / 960_000)
    small = V.mask_report(V.mask(frame(spark, {"a": ([square(0, 0, 999.95, 1000)], [])}), frame(spark, {"c": ([square(0, 0, 1000, 1000)], [])}), "k")).first()
    assert small.gap_m2 == pytest.approx(50) and small.significant_gap_m2 == 0 and small.overlap_m2 == 0


def test_dissolve_two_cities(spark):
    shapes = frame(spark, {"a1": ([square(0, 0, 300, 300)], []), "a2": ([square(200, 0, 500, 300)], []), "b1": ([[(0, 0), (400, 0), (0, 400)]], [])})
    got = {r.city: (r.polygons, r.area) for r in V.dissolve(shapes.selectExpr("*", "substring(k, 1, 1) as city"), "k", "city").collect()}
    assert got == {"a": (2, pytest.approx(150_000)), "b": (1, pytest.approx(80_000))}
