"""Goldens and properties of single operators."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from verdantia.functions import clip as C
from verdantia.functions import scalar as S
from verdantia.operators import planting as P
from verdantia.operators import rate, scoring, spatial
from verdantia.operators import windows as W
from verdantia.sources import io


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def factors(spark, rows):
    return spark.createDataFrame([(f"b{i}", *map(float, r)) for i, r in enumerate(rows)], ["block_id", *scoring.FACTORS])


THREE = [(0.1, 10, 15, 30, 0.1, 100), (0.5, 50, 35, 35, 0.5, 500), (0.9, 90, 55, 40, 0.9, 1000)]


def test_fixed_weight_case(spark):
    df = factors(spark, THREE)
    w = {r.factor: r.w for r in scoring.fixed_weight(df).collect()}
    want = {"ndvi": 0.2378421102, "tree_density": 0.2378421102, "impervious_surfaces": 0.2378421102, "temperature": 0.0066164635, "population_exposure": 0.2598572060, "pm25": 0.02}
    assert w == pytest.approx(want, abs=1e-9) and sum(w.values()) == pytest.approx(1, abs=1e-9)
    got = {r.block_id: r.score for r in scoring.score_blocks(df, scoring.fixed_weight(df)).collect()}
    assert got == {"b0": 52.43, "b1": 46.75, "b2": 33.30}


def test_entropy_edges(spark):
    one = factors(spark, [(i, 5, 1, 1, 1, 1) for i in (1, 2, 9)])
    w = {r.factor: (r.constant, r.w) for r in scoring.entropy_raw(one, ("ndvi", "tree_density")).collect()}
    assert w == {"ndvi": (False, 1.0), "tree_density": (True, 0.0)}
    same = factors(spark, [(1, 1, 1, 1, 1, 1)] * 3)
    assert {r.w for r in scoring.entropy_raw(same, ("ndvi", "pm25")).collect()} == {0.5}
    low = factors(spark, [(-3, 1, 2, 1, 1, 1), (0, 2, 2, 1, 1, 1), (4, 3, 1, 1, 1, 1)])
    assert sum(r.w for r in scoring.entropy_weights(low).collect()) == pytest.approx(1)


def test_constant_and_missing(spark):
    df = factors(spark, [(1, 1, 1, 1, 1, 1), (1, 2, 1, 1, 1, 1)])
    assert {r.n_ndvi for r in scoring.minmax(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        scoring.split_eligible(df, df.limit(1).select("block_id", F.lit("scorable").alias("score_status")))


@pytest.mark.parametrize("score,risk", [(24.99, "Critical"), (25, "High"), (50, "Moderate"), (75, "Low"), (100, "Low"), (None, None)])
def test_risk(spark, score, risk):
    assert value(spark, scoring.risk_level(F.lit(score).cast("double"))) == risk


def test_nine_checks(spark):
    from verdantia.operators import stats

    weights = spark.createDataFrame([(c, 1 / 6) for c in scoring.FACTORS], "factor string, w double")
    config = spark.createDataFrame([(c, up, "satellite") for c, up in scoring.POSITIVE.items()], "factor string, positive boolean, source string")
    scored = spark.createDataFrame([(1.0,), (None,)], "score double")
    failed = lambda *a: {r.name for r in stats.consistency(*a).filter("not ok").collect()}
    assert stats.consistency(weights, config, scored, 2).count() == 9 and failed(weights, config, scored, 2) == set()
    other = weights.filter("factor != 'pm25'").unionByName(spark.createDataFrame([("water_availability", 0.5)], "factor string, w double"))
    assert failed(other, config, scored, 2) == {"weights_sum_to_one", "no_water_factor", "pm25_active", "directions_correct", "all_have_provenance"}
    made_up = config.withColumns({"source": F.lit("Synthetic"), "positive": ~F.col("positive")})
    assert failed(weights.limit(5), made_up, scored.unionByName(spark.createDataFrame([(float("nan"),)], "score double")), 2) == {"weights_sum_to_one", "directions_correct", "no_synthetic_source", "factor_count", "scores_finite", "block_count"}
    assert not stats.gate(stats.consistency(weights, made_up, scored, 2)).first().promote


def test_rounding_is_half_even(spark):
    assert value(spark, scoring.round2(F.lit(0.125))) == 0.12 and value(spark, scoring.round2(F.lit(2.675))) == pytest.approx(2.68)


@pytest.mark.parametrize("canopy,height,trees,agb,co2", [(1000, 10, 35.367765, 16067.457863, 27.689586), (100, 1, 100, 158.540255, 0.273218), (500, 0, 0, 0, 0)])
def test_carbon_chain(spark, canopy, height, trees, agb, co2):
    c = P.carbon_chain(F.lit(float(canopy)), F.lit(float(height)))
    assert [value(spark, c[k]) for k in ("trees", "agb_kg", "co2_t")] == pytest.approx([trees, agb, co2], abs=1e-5)


@pytest.mark.parametrize("f,h", [(0.0, 0), (0.00005, 0), (0.1, 4.2), (0.5, 9), (1.0, 15), (1.5, 15)])
def test_height_fallback(spark, f, h):
    assert value(spark, S.height_fallback(F.lit(f))) == pytest.approx(h)


@pytest.mark.parametrize("lon,lat,e,n", [(75.0, 18.5204, 500000.0, 2047762.134), (73.8567, 18.5204, 379320.818, 2048144.623), (73.749344, 18.428852, 367917.557, 2038088.882)])
def test_projection(spark, lon, lat, e, n):
    x, y = S.utm43n(F.lit(lon), F.lit(lat))
    assert (value(spark, x), value(spark, y)) == pytest.approx((e, n), abs=1e-3)
    lo, la = S.wgs84(F.lit(e), F.lit(n))
    assert (value(spark, lo), value(spark, la)) == pytest.approx((lon, lat), abs=1e-7)


def test_uuid5(spark):
    ns = "49e464c3-0db8-5061-a5ff-945f95238334"
    assert value(spark, S.uuid5(ns, F.lit("PU_1128671"))) == "888ea20f-8ea1-5470-91c1-ed13cfa85b1c" == str(uuid.uuid5(uuid.UUID(ns), "PU_1128671"))


def test_geometry(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 0.0, "y": 10.0}]
    tri = F.array(*(F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in ring))
    clipped = lambda *box: value(spark, C.clip_area(tri, *(F.lit(float(b)) for b in box)))
    assert clipped(0, 0, 5, 5) == pytest.approx(25) and clipped(6, 6, 9, 9) == 0 and clipped(-5, -5, 20, 20) == 50
    assert value(spark, S.ring_area(tri)) == 50
    assert value(spark, S.ring_contains(tri, F.lit(2.0), F.lit(3.0))) and not value(spark, S.ring_contains(tri, F.lit(8.0), F.lit(8.0)))


def test_spacing(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.99, 0.0), (3, 19.98, 0.0), (4, 40.0, 0.0), (5, 50.0, 0.0)], "id int, x double, y double")
    assert sorted(r.id for r in P.enforce_spacing(pts, "id", 10.0).collect()) == [1, 3, 4, 5]


def test_spacing_is_greedy(spark, sf):
    from verdantia.sources.binding import Views

    units = Views(spark, sf).units.select("c_custkey", "x", "y").cache()
    rows = sorted((r.c_custkey, r.x, r.y) for r in units.collect())
    kept = []
    for k, x, y in rows:
        if all(math.hypot(x - a, y - b) > 200 - 1e-4 for _, a, b in kept):
            kept.append((k, x, y))
    assert sorted(r.c_custkey for r in P.enforce_spacing(units, "c_custkey", 200.0).collect()) == [k for k, _, _ in kept]


def test_spacing_of_a_long_chain(spark):
    pts = spark.range(500).select("id", (F.col("id") * 9.0).alias("x"), F.lit(0.0).alias("y"))
    assert sorted(r.id for r in P.enforce_spacing(pts, "id", 10.0).collect()) == list(range(0, 500, 2))


def test_allocation_conserves(spark):
    cells = spark.createDataFrame([(1, 0, 0, 100, 100, 100.0), (2, 100, 0, 200, 100, 300.0)], "cell int, minx int, miny int, maxx int, maxy int, pop double")
    cells = cells.selectExpr("cell", "minx + 300000 as minx", "miny + 2000000 as miny", "maxx + 300000 as maxx", "maxy + 2000000 as maxy", "pop")
    blocks = spark.createDataFrame([("a", 300000, 2000000, 300050, 2000250), ("b", 300050, 2000000, 300300, 2000250)], "block_id string, minx int, miny int, maxx int, maxy int")
    got = {r.block_id: (r.value, r.cells) for r in spatial.area_weighted(cells, blocks, "pop", "cell").collect()}
    assert got == {"a": (50.0, 1), "b": (350.0, 2)}


def test_rate_limit_windows(spark):
    rows = [("u", i, s) for i, s in enumerate((0, 10, 20, 60, 61))]
    df = spark.createDataFrame(rows, "k string, event_id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.allowed, r.retry_after) for r in rate.fixed_window_counter(df, "k", "ts", 2, 60).orderBy("event_id").collect()]
    assert got == [(True, 0), (True, 0), (False, 40), (False, 1), (True, 0)]


def test_rate_limit_stream_decides_every_request(spark):
    from types import SimpleNamespace

    from verdantia.plans.q_streams import event_stream
    from verdantia.streaming import activity

    rows = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 600 * 3600).alias("ts")).repartition(12)
    decided = activity.run_now(activity.rate_limit(event_stream(SimpleNamespace(spark=spark, activity=rows)), "user_id", 2, 86400), "limits")
    want = rate.fixed_window_counter(rows, "user_id", "ts", 2, 86400)
    assert sorted(map(tuple, decided.collect())) == sorted(map(tuple, want.select(decided.columns).collect()))


@pytest.mark.parametrize("seconds,n", [((0, 59.999999), 1), ((0, 60), 2), ((0, 50, 100), 1)])
def test_sessions_are_strict(spark, seconds, n):
    df = spark.createDataFrame([("u", i, float(s)) for i, s in enumerate(seconds)], "k string, event_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("decimal(20,0)").cast("long")))
    assert W.gap_sessions(df, ["k"], "ts", 60, ["event_id"]).count() == n


def test_prefix_sum_matches_a_plain_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 50).alias("lead"), (F.col("id") % 7).alias("v"))
    want, total = {}, 0
    for lead, i, v in sorted(((r.lead, r.id, r.v) for r in df.collect()), key=lambda x: (-x[0], x[1])):
        total += v
        want[i] = total
    assert {r.id: r.running for r in W.prefix_sum(df, "lead", "v", ("id",), descending=True, rows=30).collect()} == want


def test_upsert_keeps_what_the_batch_lacks(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    b = spark.createDataFrame([("b", None), ("c", 3)], "k string, n int")
    assert sorted(map(str, io.upsert(t, b, "k").collect())) == ["Row(k='a', n=1, s='x')", "Row(k='b', n=2, s='y')", "Row(k='c', n=3, s=None)"]


def rings(spark, polygons):
    """(ward_id, rings, holes) of {id: (outer rings, holes)} with corners as pairs."""
    rows = [(k, [[(float(x), float(y)) for x, y in r] for r in outer], [[(float(x), float(y)) for x, y in r] for r in holes]) for k, (outer, holes) in polygons.items()]
    ring = "array<array<struct<x:double,y:double>>>"
    return spark.createDataFrame(rows, f"ward_id string, rings {ring}, holes {ring}")


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_wards_with_rings(spark):
    """Slanted, concave, holed and two-part wards against areas worked out by hand; blocks are 250 m squares."""
    x, y = spatial.X0, spatial.Y0
    wards = rings(spark, {
        "slant": ([[(x, y), (x + 250, y), (x, y + 250)]], []),  # half of block 0
        "rest": ([[(x + 250, y), (x + 250, y + 250), (x, y + 250)]], []),  # the other half
        "bay": ([[(x + 250, y), (x + 500, y), (x + 500, y + 250), (x + 375, y + 125), (x + 250, y + 250)]], []),  # three quarters of block 1
        "ring": ([square(x + 500, y, x + 750, y + 250)], [square(x + 525, y + 25, x + 725, y + 225)]),  # block 2 but for a hole of 200 x 200
        "core": ([square(x + 525, y + 25, x + 725, y + 225)], []),
        "pair": ([square(x + 750, y, x + 800, y + 250), square(x + 900, y, x + 1000, y + 250)], []),  # two parts of block 3
    })
    blocks = spark.createDataFrame([(f"b{i}", x + 250 * i, y, x + 250 * i + 250, y + 250) for i in range(5)], "block_id string, minx long, miny long, maxx long, maxy long")
    area = {(r.a_block_id, r.b_ward_id): r.area for r in spatial.ring_overlaps(blocks, "block_id", wards, "ward_id").collect()}
    want = {("b0", "slant"): 31250, ("b0", "rest"): 31250, ("b1", "bay"): 46875, ("b2", "ring"): 22500, ("b2", "core"): 40000, ("b3", "pair"): 37500}
    assert set(area) == set(want) and all(abs(area[k] - a) < 1e-6 for k, a in want.items())
    got = {r.block_id: (r.ward_id, r.status) for r in spatial.ward_assign(blocks, wards).collect()}
    assert got == {"b0": (None, "ambiguous_overlap"), "b1": ("bay", "assigned"), "b2": ("core", "assigned"), "b3": ("pair", "assigned"), "b4": (None, "no_overlap")}


def test_points_in_rings(spark):
    x, y = spatial.X0, spatial.Y0
    wards = rings(spark, {"bay": ([[(x, y), (x + 600, y), (x + 600, y + 600), (x + 300, y + 300), (x, y + 600)]], []), "ring": ([square(x, y, x + 600, y + 600)], [square(x + 200, y + 200, x + 400, y + 400)])})
    points = spark.createDataFrame([(1, x + 300, y + 100), (2, x + 300, y + 350), (3, x + 50, y + 500), (4, x + 300, y + 500), (5, x + 700, y + 100), (6, None, y)], "id long, x long, y long")
    got = {(r.id, r.b_ward_id) for r in spatial.points_in_rings(points, wards, "ward_id").collect()}
    assert got == {(1, "bay"), (1, "ring"), (3, "bay"), (3, "ring"), (4, "ring")}


def test_nearest_distance_ends_without_coordinates(spark):
    points = spark.createDataFrame([(1, 300000.0, 2000000.0), (2, None, 2000000.0), (3, 330000.0, 2000000.0)], "id long, x double, y double")
    lines = spark.createDataFrame([(300010.0, 2000000.0, 300020.0, 2000000.0), (None, 2000000.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {r.id: r.distance for r in spatial.nearest_distance(points, lines, "id").collect()} == {1: 10.0, 2: None, 3: 29980.0}
