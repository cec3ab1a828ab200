"""Points near points and points inside regions, by cell codes of a space-filling curve.

Discs on the sphere are covered in three dimensions (no poles, no date line): a
point's unit vector is cut into cells and the cells are numbered along a Morton
curve. Regions are covered in the lon/lat plane by a quadtree whose cells are
ranges of a two-dimensional Morton code. Both are range joins on sorted codes
inside a bucket (a code prefix), followed by the exact test. Everything but the
covering of regions (one small group per region) runs in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strophe.functions.text import number_present
from strophe.operators.skew import join_split
from strophe.session import cut, parallelism

EARTH_KM = 6371.0
_BITS3 = 20  # bits per axis of a full code on the sphere
_BITS2 = 26  # bits per axis of a full code in the plane


def possible_position(lon: Column, lat: Column) -> Column:
    """Both present, within range, and not the 0/0 of an unset position."""
    lon, lat = number_present(lon), number_present(lat)
    ok = (F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~((lon == 0) & (lat == 0))
    return F.coalesce(ok, F.lit(False))


def _spread(x: Column, steps: list[tuple[int, int]]) -> Column:
    for shift, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


# The public shift-and-mask constants that part the bits of a Morton code.
_STEPS3 = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]
_STEPS2 = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three non-negative integers of up to 20 bits."""
    a, b, c = (_spread(v.cast("long"), _STEPS3) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def morton2(x: Column, y: Column) -> Column:
    """Interleaved bits of two non-negative integers of up to 26 bits."""
    a, b = (_spread(v.cast("long"), _STEPS2) for v in (x, y))
    return a.bitwiseOR(F.shiftleft(b, 1))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6,371 km."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def near_positions(df: DataFrame, key: str, lon: str, lat: str, km: float, hot: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Membership ``(key, pos)`` and pairs of different positions ``(pos_a, pos_b, km)`` at most km apart.

    Rows at one exact position are one position, so a place that holds a third of
    all rows is one point of the join. Rows without key or without a possible
    position are left out. A bucket of more than ``hot`` positions is split:
    its points by hash, its discs copied to each part, so that no task gets it whole.
    """
    rows = df.where(possible_position(F.col(lon), F.col(lat)) & F.col(key).isNotNull())
    members = rows.select(F.col(key).alias("key"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).distinct()
    members = members.withColumn("pos", F.struct("lon", "lat"))
    points = members.select("lon", "lat").distinct()

    chord = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    level = max(0, min(_BITS3, int(math.floor(math.log2(2 / (4 * chord))))))
    cells, fine = 1 << level, 1 << _BITS3
    rlat, rlon = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(rlat) * F.cos(rlon), "y": F.cos(rlat) * F.sin(rlon), "z": F.sin(rlat)}
    points = points.select("lon", "lat", *[v.alias(k) for k, v in axes.items()])

    def grid(v: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor((v + 1) / 2 * n), F.lit(0)), F.lit(n - 1))

    shift = 3 * (_BITS3 - level)
    coded = points.withColumn("code", morton3(*[grid(F.col(a), fine) for a in axes])).withColumn("bucket", F.shiftright("code", shift))
    discs = points
    for a in axes:
        discs = discs.withColumn(a + "c", F.explode(F.sequence(grid(F.col(a) - chord, cells), grid(F.col(a) + chord, cells))))
    discs = discs.withColumn("bucket", morton3(F.col("xc"), F.col("yc"), F.col("zc")))
    discs = discs.select(
        F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), "bucket",
        F.shiftleft("bucket", shift).alias("lo"), (F.shiftleft(F.col("bucket") + 1, shift) - 1).alias("hi"),
    )
    parts = coded.groupBy("bucket").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    coded = coded.join(parts, "bucket", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("lon", "lat"), F.col("parts"))).cast("int"))
    discs = discs.join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    a, b = discs.alias("a"), coded.select("lon", "lat", "bucket", "part", "code").alias("b")
    cond = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.part") == F.col("b.part")) & F.col("b.code").between(F.col("a.lo"), F.col("a.hi"))
    cond &= F.struct("a.lon_a", "a.lat_a") < F.struct("b.lon", "b.lat")
    got = a.join(b, cond).withColumn("km", haversine_km(F.col("lon_a"), F.col("lat_a"), F.col("lon"), F.col("lat"))).where(F.col("km") <= km)
    pairs = got.select(F.struct(F.col("lon_a").alias("lon"), F.col("lat_a").alias("lat")).alias("pos_a"), F.struct("lon", "lat").alias("pos_b"), "km")
    return members.select("key", "pos"), pairs


def near_keys(df: DataFrame, key: str, lon: str, lat: str, km: float) -> DataFrame:
    """Pairs ``(key_a, key_b)``, key_a < key_b, of distinct keys at most km apart: positions joined, then expanded."""
    members, pairs = near_positions(df, key, lon, lat, km)
    a, b = members.select(F.col("key").alias("a"), F.col("pos").alias("pos_a")), members.select(F.col("key").alias("b"), F.col("pos").alias("pos_b"))
    # a hot position is dealt over several tasks
    apart = join_split(b, join_split(a, pairs, ["pos_a"]), ["pos_b"]).select("a", "b")
    same = join_split(a, b.withColumnRenamed("pos_b", "pos_a"), ["pos_a"]).where("a < b").select("a", "b")
    return apart.where("a <> b").unionAll(same).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def _crossings(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Even-odd test of points against edges (x1, y1, x2, y2)."""
    x1, y1, x2, y2 = (e[:, i][None, :] for i in range(4))
    py, px = y[:, None], x[:, None]
    cut = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1) * (py - y1) / (y2 - y1) + x1
    return (np.sum(cut & (px < at), axis=1) % 2).astype(bool)


def _touches(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Edges that meet the box (by clipping each edge against it)."""
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    t0, t1 = np.zeros(len(e)), np.ones(len(e))
    ok = np.ones(len(e), bool)
    for p, q in ((-dx, e[:, 0] - x0), (dx, x1 - e[:, 0]), (-dy, e[:, 1] - y0), (dy, y1 - e[:, 1])):
        flat = p == 0
        ok &= ~(flat & (q < 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = q / p
        t0 = np.where(~flat & (p < 0), np.maximum(t0, r), t0)
        t1 = np.where(~flat & (p > 0), np.minimum(t1, r), t1)
    return ok & (t0 <= t1)


def cover_region(edges: np.ndarray, deepest: int) -> list[tuple[int, int, bool]]:
    """Ranges (lo, hi, wholly inside) of full plane codes that cover the region, from a quadtree over the world."""
    out: list[tuple[int, int, bool]] = []
    stack = [(0, 0, 0, np.arange(len(edges)))]
    while stack:
        level, cx, cy, near = stack.pop()
        w = 360.0 / (1 << level)
        x0, y0 = cx * w - 180.0, cy * w - 90.0
        pad = w * 1e-9
        hit = near[_touches(edges[near], x0 - pad, y0 - pad, x0 + w + pad, y0 + w + pad)]
        code = 0
        for bit in range(level):
            code |= ((cx >> bit) & 1) << (2 * bit) | ((cy >> bit) & 1) << (2 * bit + 1)
        size = 2 * (_BITS2 - level)
        if not len(hit):
            if _crossings(np.array([x0 + w / 2]), np.array([y0 + w / 2]), edges)[0]:
                out.append((code << size, ((code + 1) << size) - 1, True))
        elif level == deepest:
            out.append((code << size, ((code + 1) << size) - 1, False))
        else:
            stack += [(level + 1, 2 * cx + i, 2 * cy + j, hit) for i in (0, 1) for j in (0, 1)]
    merged: list[tuple[int, int, bool]] = []
    for lo, hi, whole in sorted(out):
        if merged and merged[-1][2] == whole and merged[-1][1] + 1 == lo:
            merged[-1] = (merged[-1][0], hi, whole)
        else:
            merged.append((lo, hi, whole))
    return merged


def inside_regions(points: DataFrame, key: str, lon: str, lat: str, shapes: DataFrame, region: str = "adcode", deepest: int = 12, bucket_level: int = 10) -> DataFrame:
    """``(key, region)`` of each point and each region that holds it (even-odd rule over all rings, so holes are outside).

    shapes: one row per vertex (region, ring, seq, lon, lat) with closed rings. Points with an impossible
    position or no key are left out; a point in no region gives no row. Rings of under three vertices hold nothing.
    """
    import pyspark.sql.window as W

    order = W.Window.partitionBy(region, "ring").orderBy("seq")
    v = shapes.select(region, "ring", "seq", F.col("lon").cast("double").alias("x1"), F.col("lat").cast("double").alias("y1")).distinct()
    e = v.withColumn("x2", F.lead("x1").over(order)).withColumn("y2", F.lead("y1").over(order)).where("x2 is not null")
    outlines = e.groupBy(region).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))

    def cover(batches):
        for b in batches:
            rows = []
            for r, es in zip(b[region], b["edges"]):
                arr = np.array([[d["x1"], d["y1"], d["x2"], d["y2"]] for d in es], dtype=float)
                rows += [(r, *x) for x in cover_region(arr, deepest)]
            yield pd.DataFrame(rows, columns=[region, "lo", "hi", "whole"])

    rtype = shapes.schema[region].dataType
    schema = T.StructType([T.StructField(region, rtype), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("whole", T.BooleanType())])
    shift = 2 * (_BITS2 - bucket_level)
    # one region a group of the shuffle, and covered once, though both branches below read the ranges
    outlines = cut(outlines.repartition(parallelism(points.sparkSession), region))
    ranges = cut(outlines.mapInPandas(cover, schema)).withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))

    n = 1 << _BITS2
    ok = points.where(possible_position(F.col(lon), F.col(lat)) & F.col(key).isNotNull())
    p = ok.select(F.col(key).alias("key"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).distinct()
    gx = F.least(F.floor((F.col("x") + 180) / 360 * n), F.lit(n - 1))
    gy = F.floor((F.col("y") + 90) / 360 * n)
    p = p.withColumn("code", morton2(gx, gy)).withColumn("bucket", F.shiftright("code", shift))
    met = p.join(ranges, (p["bucket"] == ranges["bucket"]) & p["code"].between(ranges["lo"], ranges["hi"])).select("key", "x", "y", region, "whole")
    crossing = F.filter(
        "edges",
        lambda d: ((d["y1"] > F.col("y")) != (d["y2"] > F.col("y")))
        & (F.col("x") < (d["x2"] - d["x1"]) * (F.col("y") - d["y1"]) / F.when(d["y2"] != d["y1"], d["y2"] - d["y1"]) + d["x1"]),
    )
    sure = met.where("whole").select("key", region)
    tested = met.where("not whole").join(outlines, region).where(F.size(crossing) % 2 == 1).select("key", region)
    return sure.unionAll(tested).distinct()
