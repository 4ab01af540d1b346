import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from skyfix.functions import frames, geo, ids
from skyfix.functions.vectors import dot, normalized

RING = "array<struct<lat: double, lon: double>>"


def ring(points):
    return [(float(y), float(x)) for x, y in points]


def inside(p, poly):
    x, y = p
    hit = False
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def simple(p):
    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def cross(a, b, c, d):
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    return not cross(p[0], p[1], p[2], p[3]) and not cross(p[1], p[2], p[3], p[0])


def measure(spark, pairs):
    rows = [(i, ring(a), ring(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"i int, a {RING}, b {RING}")
    got = df.select(
        "i", geo.iou(F.col("a"), F.col("b")).alias("iou"), geo.intersection_area(F.col("a"), F.col("b")).alias("c"),
        geo.valid(F.col("a")).alias("valid"),
    ).collect()
    return {r.i: r for r in got}


SQUARE = [(0, 0), (0, 2), (2, 2), (2, 0)]


def test_iou_of_known_shapes(spark):
    shift = lambda dx, dy: [(x + dx, y + dy) for x, y in SQUARE]
    bowtie = [(0, 0), (2, 2), (2, 0), (0, 2)]
    flat = [(0, 0), (1, 0), (2, 0), (3, 0)]
    dart = [(0, 0), (2, 1), (4, 0), (2, 4)]
    small = [(0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5)]
    touch = [(0, 0), (0, 2), (0, 1), (2, 0)]
    got = measure(
        spark,
        [
            (SQUARE, SQUARE), (SQUARE, SQUARE[::-1]), (SQUARE, shift(1, 0)), (SQUARE, shift(2, 0)), (SQUARE, shift(2, 2)), (SQUARE, small),
            (bowtie, SQUARE), (flat, SQUARE), (dart, dart), (SQUARE, shift(9, 9)), (touch, SQUARE),
        ],
    )
    expect = [1, 1, 1 / 3, 0, 0, 0.0625, 0, 0, 1, 0, 0]
    assert all(abs(got[i].iou - e) < 1e-12 for i, e in enumerate(expect)), [got[i].iou for i in range(len(expect))]
    assert [got[i].valid for i in (0, 6, 7, 8, 10)] == [True, False, False, True, False]


def test_intersection_of_random_quads(spark):
    rnd = random.Random(11)
    pairs = []
    while len(pairs) < 40:
        a, b = ([(rnd.uniform(0, 4), rnd.uniform(0, 4)) for _ in range(4)] for _ in range(2))
        if simple(a) and simple(b):
            pairs.append((a, b))
    got = measure(spark, pairs)
    n = 200
    for i, (a, b) in enumerate(pairs):
        cells = sum(inside(p, a) and inside(p, b) for x in range(n) for y in range(n) for p in [((x + 0.5) * 4 / n, (y + 0.5) * 4 / n)])
        assert abs(got[i].c - cells * 16 / n / n) < 0.06


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-80, 80), st.floats(-179, 179), st.floats(0, 900000)), min_size=1, max_size=20))
def test_frames_round_trip(spark, points):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double, alt double")
    jd = F.lit(2459420.5)
    eci = frames.ecef_to_eci(frames.latlon_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), jd)
    back = df.withColumn("e", eci).select("i", frames.ecef_to_geodetic(frames.eci_to_ecef(F.col("e"), jd)).alias("g")).collect()
    for r in back:
        assert abs(r.g.lat - points[r.i][0]) < 1e-6 and abs(r.g.lon - points[r.i][1]) < 1e-6
    nadir = df.withColumn(
        "n", frames.nadir_eci(F.col("lat"), F.col("lon"), F.col("alt"), jd),
    ).select("i", frames.altitude_m(F.col("n")).alias("h")).collect()
    assert all(abs(r.h - points[r.i][2]) < 1e-3 for r in nadir)


def test_long_products_are_loops(spark):
    rows = spark.range(1).select(*(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x * f / 7).alias(c) for c, f in (("a", 1.5), ("b", -2.5))))
    plan = lambda n: rows.select(dot(F.col("a"), F.col("b"), n).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan(64).count("a#") < 8 < plan(12).count("a#")
    same = rows.select(dot(F.col("a"), F.col("b"), 64).alias("x"), sum((F.col("a")[i] * F.col("b")[i] for i in range(1, 64)), F.col("a")[0] * F.col("b")[0]).alias("y")).first()
    assert same.x == same.y


def test_geodetic_steps_do_not_repeat_their_vector(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0), (1.0, 3.0, 4.0)], "x double, y double, z double")
    v = F.struct(F.cosh("x").alias("x"), "y", "z")
    found = rows.select(frames.ecef_to_geodetic(v).alias("g"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("COSH(") == 1
    assert [round(r.g.lon, 6) for r in found.collect()] == [round(math.degrees(math.atan2(y, math.cosh(1.0))), 6) for y in (0.0, 3.0)]


def test_bearings_have_length_one(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (2304.0, 1296.0), (4608.0, 2592.0)], "u double, v double",
    ).select(frames.pixel_bearing(F.col("u"), F.col("v")).alias("b"))
    got = [r.b for r in df.collect()]
    assert all(abs(b.x**2 + b.y**2 + b.z**2 - 1) < 1e-12 for b in got) and tuple(got[1]) == (0.0, 0.0, 1.0)
    half = math.degrees(math.acos(got[0].z / math.hypot(got[0].x, got[0].z)))
    assert abs(half - 33.05) < 1e-9


def test_pixels_and_homography(spark):
    corners = F.array(*(ids.corner(F.lit(y), F.lit(x)) for y, x in ((0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0))))
    at = lambda u, v, h, w: geo.pixel_to_latlon(corners, F.lit(u), F.lit(v), F.lit(h), F.lit(w))
    one = [float(i in (0, 4, 8)) for i in range(9)]
    r = spark.range(1).select(
        at(0.0, 0.0, 11, 21).alias("tl"), at(20.0, 10.0, 11, 21).alias("br"), at(0.0, 0.0, 1, 1).alias("one"),
        geo.project(F.array(*map(F.lit, one)), F.lit(3.0), F.lit(4.0)).alias("same"),
    ).first()
    assert tuple(r.tl) == (1.0, 0.0) and tuple(r.br) == (0.0, 2.0) and tuple(r.one) == (1.0, 0.0) and tuple(r.same) == (3.0, 4.0)


def test_names_parse_and_fail(spark):
    good = "db/2021_09/@44.0@9.0@46.0@9.0@46.0@11.0@44.0@11.0@09_271_180@20210724@45.0@10.0@34969@0.0@.jpg"
    r = spark.createDataFrame([(good,)], "p string").select(ids.parse_footprint(F.col("p")).alias("x")).first().x
    assert r.tile_id == "09_271_180@20210724" and [tuple(c) for c in r.corners] == [(44, 9), (46, 9), (46, 11), (44, 11)] and r.sq_km_area == 34969 and r.error is None
    for bad in (good.replace("@0.0@", "@"), good.replace("@0.0@", "@0.0@1@"), good.replace("44.0", "x", 1)):
        df = spark.createDataFrame([(bad,)], "p string")
        soft = df.select(ids.parse_footprint(F.col("p"), strict=False).alias("x")).first().x
        assert soft.tile_id is None and soft.error
        try:
            df.select(ids.parse_footprint(F.col("p")).alias("x")).collect()
            raise AssertionError("a malformed name passed")
        except Exception as e:  # noqa: BLE001
            assert "footprint name" in str(e)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(
        dot(F.col("a"), F.col("b")).alias("d"), dot(F.col("a"), F.col("b"), 2).alias("u"), normalized(F.col("a")).alias("n"),
    ).collect()
    assert [(r.d, r.u) for r in got] == [(11.0, 11.0), (0.0, 0.0)] and got[0].n == [0.6, 0.8] and got[1].n == [0.0, 0.0]
