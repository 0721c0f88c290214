"""Distance joins where the grid ends: across the 180th meridian, beyond the widest radius, far from any edge; repeated segments."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwarden.operators import models, regions, spatial


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(x))


def test_pairs_meet_across_the_meridian(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-89, 89), rng.choice([-179.999, 179.999, -179.0, 179.2, 0.0]) + rng.uniform(-0.0005, 0.0005)) for i in range(150)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    for radius in (500.0, 200_000.0, 5_000_000.0, 20_100_000.0):
        got = sorted((r["l_id"], r["r_id"]) for r in spatial.earth_pairs(df, df, radius).collect())
        assert got == sorted((a[0], b[0]) for a in points for b in points if metres(a[1:], b[1:]) <= radius)


def test_nearest_is_found_however_far(spark):
    origins = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 179.9)], "id long, lat double, lon double")
    targets = spark.createDataFrame([(7, 0.0, 170.0), (8, 0.0, 100.0), (9, 10.0, -179.9)], "t long, lat double, lon double")
    got = {r["id"]: (r["t"], round(r["distance"])) for r in spatial.nearest(origins, targets, "id", "t").collect()}
    assert got == {1: (8, round(metres((0, 0), (0, 100)))), 2: (9, round(metres((10, 179.9), (10, -179.9))))}


def test_nearest_edge_is_found_however_far(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90_000.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    line = "array<struct<x:double,y:double>>"
    edges = spark.createDataFrame([("a", [(0.0, 5.0), (10.0, 5.0)]), ("b", [(20_000.0, -1.0), (20_000.0, 9.0)])], f"edge string, line {line}")
    got = {r["id"]: (r["edge"], r["distance"]) for r in spatial.nearest_edge(points, edges, "id", "edge").collect()}
    assert got == {1: ("a", 5.0), 2: ("b", 70_000.0)}
    assert spatial.nearest_edge(points, edges.where("false"), "id", "edge").count() == 0


def test_repeated_segments_count_once(spark):
    rows = [("s1", 10.0, 0.9, "A"), ("s1", 12.0, 0.9, "A"), ("s2", 10.0, 0.1, "A")]
    df = spark.createDataFrame(rows, "segment_id string, length_m double, cmcs_final double, district string")
    df = df.withColumns({c: F.lit(2.0) for c in ("has_crosswalk", "has_signal", "has_speed_bump", "has_cctv")} | {"narrow_sidewalk_norm": F.lit(1.5), "accident_count": F.lit(0), "center_x": F.lit(1.0), "center_y": F.lit(1.0)})
    r = regions.district_summary(df).first()
    assert (r["segment_count"], r["average_cmcs"], r["infrastructure_coverage"], r["walking_comfort"]) == (2, pytest.approx(0.5), 1.0, 0.0)
    g = regions.region_features(df).first()
    assert g["segment_count"] == 2 and g["length_m_sum"] == 20.0


def test_effects_count_as_far_as_their_signs_agree(spark):
    coefs = np.array([[1.0], [2.0], [-0.5], [3.0]])
    r = models._evidence_rows(spark, coefs * models.SPECS[0][2], 0.5).first()
    assert (r["signed_effect"], r["consistency"], r["score"]) == (1.5, 0.75, pytest.approx(1.5 * 0.75 * 0.5))


def test_edges_without_a_line_play_no_part(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    line = "array<struct<x:double,y:double>>"
    none = spark.createDataFrame([("a", None), ("b", []), ("c", [(1.0, None)])], f"edge string, line {line}")
    assert spatial.nearest_edge(points, none, "id", "edge").count() == 0
    assert spatial.nearest_edge(points.where("false"), none, "id", "edge").count() == 0
    some = none.unionByName(spark.createDataFrame([("d", [(3.0, 4.0)])], none.schema))
    assert [tuple(r) for r in spatial.nearest_edge(points, some, "id", "edge").collect()] == [(1, "d", 5.0)]


def test_polygons_of_any_shape(spark):
    """Holed-out, thin, nested and huge rings against a plain test of every pair."""
    rng = random.Random(9)
    star = lambda cx, cy, r, n: [(cx + r * (1 if k % 2 else 0.35) * math.cos(math.pi * k / n), cy + r * (1 if k % 2 else 0.35) * math.sin(math.pi * k / n)) for k in range(2 * n)]
    rings = [(f"s{k}", star(rng.uniform(0, 1000), rng.uniform(0, 1000), rng.choice([5, 60, 200]), rng.randint(3, 9))) for k in range(25)]
    rings += [("thin", [(0.0, 500.0), (1000.0, 503.0), (1000.0, 504.0)]), ("zero", [(50.0, 50.0)]), ("huge", [(-4000.0, -4000.0), (-3000.0, -4000.0), (-4000.0, -3000.0)])]
    points = [(k, rng.uniform(-200, 1200), rng.uniform(-200, 1200)) for k in range(400)] + [(900, -3900.0, -3900.0), (901, None, 1.0)]

    def inside(x, y, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    def off(x, y, ring):
        out = math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
            out = min(out, (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2)
        return out

    want = {}
    for k, x, y in points:
        held = [] if x is None else [n for n, r in rings if inside(x, y, r)]
        want[k] = None if x is None else min(held) if held else min((off(x, y, r), n) for n, r in rings)[1]
    df = spark.createDataFrame(points, "id long, x double, y double")
    polygons = spark.createDataFrame(rings, "zone string, ring array<struct<x:double,y:double>>")
    for size in (None, 40.0):
        assert {r["id"]: r["zone"] for r in spatial.within(df, polygons, "id", "zone", size).collect()} == want
    assert {r["zone"] for r in spatial.within(df, polygons.limit(0), "id", "zone").collect()} == {None}


def test_buffers_reach_between_vertices(spark):
    line = "array<struct<x:double,y:double>>"
    edges = [("cross", [(500.0, -900.0), (500.0, 900.0)]), ("far", [(500.0, 120.0), (800.0, 400.0)]), ("beside", [(-3000.0, 99.0), (4000.0, 99.0)]), ("dot", [(1000.0, -50.0)]), ("none", None)]
    df = spark.createDataFrame(edges, f"edge string, line {line}")
    route = spark.createDataFrame([([(0.0, 0.0), (1000.0, 0.0)],)], f"line {line}")
    assert {r["edge"] for r in spatial.route_buffer(df, route, "edge", 100.0).collect()} == {"cross", "beside", "dot"}
    assert spatial.route_buffer(df, route.where("false"), "edge").count() == 5


def test_clusters_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    spots = [(rng.uniform(36.2, 36.5), rng.uniform(127.3, 127.6)) for _ in range(12)] + [(36.3, 179.999), (36.3, -179.999), (-0.0001, 10.0), (0.0001, 10.0), (89.99, 0.0), (89.99, 120.0)]
    points = [(i, spots[i % len(spots)][0] + rng.uniform(-0.012, 0.012) * (i % 18 < 12), (spots[i % len(spots)][1] + rng.uniform(-0.012, 0.012) + 180) % 360 - 180) for i in range(900)]
    df = spark.createDataFrame([*points, (5000, None, 1.0), (5001, 36.3, float("nan")), (3, 10.0, 10.0)], "id long, lat double, lon double")
    for radius in (60.0, 400.0):
        least = {i: i for i, _, _ in points}
        find = lambda i: i if least[i] == i else find(least[i])  # noqa: B023, E731
        for a in points:
            for b in points[: a[0]]:
                if metres(a[1:], b[1:]) <= radius:
                    x, y = sorted((find(a[0]), find(b[0])))
                    least[y] = x
        got = {r["id"]: r["cluster"] for r in spatial.clusters(df, "id", radius).collect()}
        assert got == {i: find(i) for i in least} | {5000: 5000, 5001: 5001}


def test_rounds_of_labels_keep_no_plan(spark):
    """A chain of 200 nodes takes many rounds; with checkpoints their constraints doubled each time, until the driver had no memory left."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got = spatial.least_labels(edges)
    assert {r["label"] for r in got.collect()} == {0}
    assert got._jdf.queryExecution().analyzed().constraints().size() <= 2 * len(got.columns)


def test_rings_and_radii_follow_the_density(spark, monkeypatch):
    """Of many pairs within reach, few are sorted by the searches; results are those of all pairs."""
    rng = random.Random(5)
    points = [(i, 36.3 + rng.choice([0.0, 0.0, 0.2]) + rng.uniform(0, 0.04), 127.4 + rng.uniform(0, 0.04)) for i in range(600)] + [(900, 36.4, 127.9)]
    df, kept, made = spark.createDataFrame(points, "id long, lat double, lon double"), spatial.stored, []
    monkeypatch.setattr(spatial, "stored", lambda d: made.append(d) or kept(d))
    got = {(r["origin"], r["destination"]) for r in spatial.band_pairs(df, "id").collect()}
    want = set()
    for a in points:
        near = [(abs(d - 1600), b[0]) for b in points if b[0] != a[0] and 700 <= (d := metres(a[1:], b[1:])) <= 3000]
        if near:
            want.add(tuple(sorted((a[0], min(near)[1]))))
    assert got == want and len(made) > 1
    made.clear()
    t = df.withColumnRenamed("id", "t")
    moved = df.withColumn("lat", F.col("lat") + 0.0003)
    got = {r["id"]: r["t"] for r in spatial.nearest(moved, t, "id", "t").collect()}
    assert got == {a[0]: min((metres((a[1] + 0.0003, a[2]), b[1:]), b[0]) for b in points)[1] for a in points} and len(made) > 1
