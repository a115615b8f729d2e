"""Polygons against points and boxes by their edges, and binary points, as native columns.

An edge is a struct (x1, y1, x2, y2, w); w is 1 or -1, so that the sum of x dy over a polygon's edges is its area.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(edge_array: Column | str, x: Column, y: Column) -> Column:
    """Whether the point is inside, by the edges of its grid row."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * ((y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))) + e["x1"])
    return F.size(F.filter(edge_array, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1


def area_within(edge_array: Column | str, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Area of the polygon within a box, by the edges of the box's grid rows.

    The sum over edges of the integral of x dy, with x held to the box's sides and y to its height; the mean of the held x
    along an edge is a difference of its integral.
    """
    wide = maxx - minx

    def integral(u):  # of x held to [0, wide], from 0 to u
        inner = F.least(F.greatest(u, F.lit(0.0)), wide)
        return inner * inner / 2 + wide * F.greatest(u - wide, F.lit(0.0))

    def term(e):
        rise = e["y2"] - e["y1"]
        held = lambda y: F.least(F.greatest(y, miny), maxy)
        ya, yb = held(e["y1"]), held(e["y2"])
        x = lambda y: e["x1"] - minx + (e["x2"] - e["x1"]) * ((y - e["y1"]) / rise)
        u, v = x(ya), x(yb)
        level = F.least(F.greatest((u + v) / 2, F.lit(0.0)), wide)
        mean = F.when(F.abs(v - u) < 1e-9, level).otherwise((integral(v) - integral(u)) / F.nullif(v - u, F.lit(0.0)))
        return F.when((rise == 0) | (ya == yb), 0.0).otherwise(e["w"] * (yb - ya) * mean)

    return F.aggregate(edge_array, F.lit(0.0), lambda s, e: s + term(e))


def clip_area(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Area of one ring within a box."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    both = F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), F.lit(1.0).alias("w")))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(area_within(both, minx, miny, maxx, maxy)))


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def clip_ring(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The part of a ring within a box, as a ring: four cuts by half-planes, one after another.

    A ring that the box cuts into several pieces stays one ring, whose pieces hang together along the box's sides.
    """

    def half(points: Column, axis: str, limit: Column, sign: int) -> Column:
        other = "y" if axis == "x" else "x"

        def step(a, b):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            share = da / F.nullif(da - db, F.lit(0.0))
            meet = {axis: limit, other: a[other] + share * (b[other] - a[other])}
            crossing = F.struct(meet["x"].cast("double").alias("x"), meet["y"].cast("double").alias("y"))
            return F.filter(F.array(F.when(da >= 0, a), F.when((da >= 0) != (db >= 0), crossing)), lambda p: p.isNotNull())

        return let(points, lambda q: F.flatten(F.zip_with(q, F.concat(F.slice(q, 2, F.size(q)), F.slice(q, 1, 1)), step)))

    point = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    for axis, limit, sign in (("x", minx, 1), ("x", maxx, -1), ("y", miny, 1), ("y", maxy, -1)):
        point = half(point, axis, limit, sign)
    return point


def number_of(digits: Column) -> Column:
    """The double of 16 hexadecimal digits, the sign first; NULL for infinities and what is no number."""
    part = F.conv(F.substring(digits, 4, 13), 16, 10).cast("long") / F.lit(2.0**52)

    def of(head: Column) -> Column:
        power = head % 2048
        size = (part + F.when(power > 0, 1.0).otherwise(0.0)) * F.pow(F.lit(2.0), F.greatest(power, F.lit(1)) - 1023)
        return F.when(power < 2047, F.when(head >= 2048, -size).otherwise(size))

    return let(F.conv(F.substring(digits, 1, 3), 16, 10).cast("long"), of)


def parse_ewkb(data: Column) -> Column:
    """struct(x, y) of a binary point of zone 43 north, with or without its SRID, in either byte order; NULL for others."""

    def of(digits: Column) -> Column:
        def at(byte: Column, size: int) -> Column:
            own = F.substring(digits, byte * 2 + 1, F.lit(2 * size))
            turned = F.concat(*(F.substring(own, 2 * i + 1, 2) for i in reversed(range(size))))
            return F.when(F.substring(digits, 1, 2) == "01", turned).otherwise(own)

        def body(kind: Column) -> Column:
            named = kind.bitwiseAND(0x20000000) != 0
            start = F.when(named, 9).otherwise(5)
            ok = (kind.bitwiseAND(0xFF) == 1) & (F.length(digits) >= 2 * start + 32) & F.substring(digits, 1, 2).isin("00", "01") & (~named | (F.conv(at(F.lit(5), 4), 16, 10) == "32643"))
            return F.when(ok, F.struct(number_of(at(start, 8)).alias("x"), number_of(at(start + 8, 8)).alias("y")))

        return let(F.conv(at(F.lit(1), 4), 16, 10).cast("long"), body)

    return let(F.hex(data), of)


def point_ewkb(x: Column, y: Column, srid: Column) -> Column:
    """A point with its SRID in big-endian bytes; coordinates are 0, or finite and no smaller than 1e-300."""

    def digits(v: Column) -> Column:
        def of(rough: Column) -> Column:
            off = F.abs(v) / F.pow(F.lit(2.0), rough)
            return let(rough + F.when(off >= 2, 1).when(off < 1, -1).otherwise(0), bits)

        def bits(power: Column) -> Column:
            part = ((F.abs(v) / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**52)).cast("long")
            head = (power + 1023 + F.when(v < 0, 2048).otherwise(0)).cast("long")
            return F.concat(F.lpad(F.hex(head), 3, "0"), F.lpad(F.hex(part), 13, "0"))

        return F.when(v == 0, F.lit("0" * 16)).otherwise(let(F.floor(F.log2(F.abs(v))), of))

    return F.unhex(F.concat(F.lit("0020000001"), F.lpad(F.hex(srid.cast("long")), 8, "0"), digits(x), digits(y)))
