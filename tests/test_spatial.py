import math
import random

from strophe.operators.spatial import EARTH_KM, inside_regions, near_keys, near_positions


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))


def brute(points, limit):
    return {(a, b) for i, (a, *p) in enumerate(points) for b, *q in points[:i] + points[i + 1 :] if a < b and km(p, q) <= limit}


def test_near_equals_brute_force(spark):
    rng = random.Random(5)
    pts = []
    for lon, lat in ((10, 50), (179.999, 0), (-179.999, 0), (0, 89.9999), (90, 89.9999), (-120, -89.99)):
        pts += [(f"k{len(pts) + i:03d}", lon + rng.uniform(-0.01, 0.01) if abs(lon) < 179 else float(lon), max(-90.0, min(90.0, lat + rng.uniform(-0.005, 0.005)))) for i in range(25)]
    pts += [("same1", 5.0, 5.0), ("same2", 5.0, 5.0)]
    df = spark.createDataFrame(pts, "id string, lon double, lat double")
    for limit in (0.5, 3.0, 200.0):
        got = {tuple(r) for r in near_keys(df, "id", "lon", "lat", limit).collect()}
        assert got == brute(pts, limit)


def test_near_edges(spark):
    rows = [("a", 1.0, 1.0), ("b", None, 1.0), ("c", float("nan"), 1.0), ("d", 0.0, 0.0), ("e", 181.0, 1.0), ("f", 1.0, 91.0), (None, 1.0, 1.0), ("a", 1.0, 1.0), ("g", 1.0, 1.001)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, lon double, lat double, key string")
    assert {tuple(r) for r in near_keys(df, "id", "lon", "lat", 0.5).collect()} == {("a", "g")}
    assert near_keys(df.where("false"), "id", "lon", "lat", 0.5).count() == 0
    # a bucket that is split gives the same pairs
    many = spark.createDataFrame([(f"k{i}", 2.0 + i * 1e-6, 2.0) for i in range(120)], "id string, lon double, lat double")
    assert near_positions(many, "id", "lon", "lat", 0.5, hot=7)[1].count() == 120 * 119 // 2


def test_regions(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    far = [(100, -80), (140, -80), (120, -30), (100, -80)]
    shapes = [(r, ring, i, float(x), float(y)) for r, ring, pts in (("s", 0, square), ("s", 1, hole), ("t", 0, far)) for i, (x, y) in enumerate(pts)]
    s = spark.createDataFrame(shapes, "adcode string, ring int, seq int, lon double, lat double")
    rng = random.Random(3)
    pts = [(i, rng.uniform(-1, 11), rng.uniform(-1, 11)) for i in range(400)] + [(1000 + i, rng.uniform(95, 145), rng.uniform(-85, -25)) for i in range(200)]
    p = spark.createDataFrame([(*x, "c") for x in pts], "id long, lon double, lat double, adcode string")
    got = {(r[0], r[1]) for r in inside_regions(p, "id", "lon", "lat", s).collect()}

    def inside(x, y, ring):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) % 2 == 1

    want = {(i, "s") for i, x, y in pts if inside(x, y, square) and not inside(x, y, hole)} | {(i, "t") for i, x, y in pts if inside(x, y, far)}
    assert got == want
    assert inside_regions(p.where("false"), "id", "lon", "lat", s).count() == 0
    assert inside_regions(p, "id", "lon", "lat", s.where("false")).count() == 0
