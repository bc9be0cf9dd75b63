"""Polygons and lines against loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import polygons
from tilewright.operators.profile import apply_profile

SCHEMA = "pid long, rings array<array<struct<x:double,y:double>>>"


def ring(r, x, y, size, n, closed):
    """A star-shaped ring, concave, of n corners."""
    at = [(x + size * k * math.cos(a), y + size * k * math.sin(a)) for a, k in ((2 * math.pi * i / n, r.uniform(0.2, 1)) for i in range(n))]
    return at + at[:1] * closed


def shapes(seed, n=40):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y, size = r.uniform(-170, 170), r.uniform(-80, 80), r.choice([0.3, 2, 9, 40])
        rings = [ring(r, x, y, size, r.randint(3, 30), k % 2)]
        if k % 3 == 0:
            rings.append(ring(r, x, y, size / 5, 6, False))
        if k % 7 == 0:
            rings.append(ring(r, x + 1, y + 3 * size, size, 5, True))
        out.append((k, rings))
    return [*out, (900, []), (901, None), (902, [[]]), (903, [[(0.0, 0.0), (1.0, 1.0)]])]


def inside(rings, x, y):
    odd = False
    for p in rings or ():
        if len(p) >= 3:
            for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
    return odd


def frame(spark, rows):
    return spark.createDataFrame([(k, None if rings is None else [[{"x": float(a), "y": float(b)} for a, b in p] for p in rings]) for k, rings in rows], SCHEMA)


@pytest.mark.parametrize("cell", [0.5, 7.0])
def test_points_in_polygons(spark, cell):
    r = random.Random(1)
    own = shapes(2)
    points = [(k, r.uniform(-180, 180), r.uniform(-90, 90)) for k in range(300)] + [(1000 + k, *p) for k, p in enumerate(p for _, rings in own[:6] for q in rings for p in q)]
    points += [(2000 + k, x + r.gauss(0, 1), y + r.gauss(0, 1)) for k, (x, y) in enumerate(rings[0][0] for _, rings in own[:40])] + [(5000, None, 1.0), (5001, float("nan"), 1.0)]
    got = polygons.points_in_polygons(spark.createDataFrame(points, "id long, x double, y double"), frame(spark, own), "id", "pid", cell=cell, wraps=False)
    want = sorted((i, k) for i, x, y in points if x is not None and not math.isnan(x) for k, rings in own if inside(rings, x, y))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30
    assert not [x for x in ("Python", "Arrow", "NestedLoop", "Cartesian") if x in got._jdf.queryExecution().executedPlan().toString()]


def test_across_the_antimeridian(spark):
    square = [(175.0, -5.0), (-175.0, -5.0), (-175.0, 5.0), (175.0, 5.0)]
    hole = [(179.0, -1.0), (-179.0, -1.0), (-179.0, 1.0), (179.0, 1.0)]
    points = [(1, 176.0, 0.0), (2, -176.0, 0.0), (3, 180.0, 0.0), (4, -179.5, 0.5), (5, 0.0, 0.0), (6, -174.0, 0.0), (7, -180.0, 3.0)]
    got = polygons.points_in_polygons(spark.createDataFrame(points, "id long, x double, y double"), frame(spark, [(1, [square, hole])]), "id", "pid")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 7]


def test_points_near_lines(spark):
    r = random.Random(3)
    lines = [(k, [[(r.uniform(0, 50), r.uniform(0, 50)) for _ in range(r.randint(1, 6))] for _ in range(r.randint(1, 2))]) for k in range(25)]
    points = [(k, r.uniform(-2, 52), r.uniform(-2, 52)) for k in range(120)]

    def away(x, y, parts):
        best = math.inf
        for p in parts:
            for (x1, y1), (x2, y2) in zip(p, p[1:] or p, strict=False):
                d = (x2 - x1) ** 2 + (y2 - y1) ** 2
                t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d)) if d else 0
                best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        return best

    for radius in (0.4, 5.0):
        got = {(a, b): d for a, b, d in polygons.points_near_lines(spark.createDataFrame(points, "id long, x double, y double"), frame(spark, lines), "id", "pid", radius, "rings").collect()}
        want = {(i, k): d for i, x, y in points for k, parts in lines if (d := away(x, y, parts)) <= radius}
        assert got.keys() == want.keys() and all(math.isclose(got[k], d, abs_tol=1e-9) for k, d in want.items())


def test_points_that_stand_for_polygons(spark):
    own = [s for s in shapes(5) if s[0] % 7]
    got = frame(spark, own).select("pid", polygons.centroid(F.col("rings")).alias("c"), polygons.point_on_surface(F.col("rings")).alias("s")).collect()
    rings = dict(own)

    def area(p):
        cross = [(x1 * y2 - x2 * y1, x1 + x2, y1 + y2) for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True)]
        a = sum(c for c, *_ in cross)
        s = -1 if a < 0 else 1
        return s * a, s * sum(c * x for c, x, _ in cross), s * sum(c * y for c, _, y in cross)

    for r in got:
        if r["pid"] < 900:
            each = [area(p) for p in rings[r["pid"]]]
            total = [each[0][k] - sum(e[k] for e in each[1:]) for k in range(3)]
            assert math.isclose(r["c"]["x"], total[1] / 3 / total[0], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["c"]["y"], total[2] / 3 / total[0], rel_tol=1e-6, abs_tol=1e-9)
            assert inside(rings[r["pid"]], r["s"]["x"], r["s"]["y"])
        elif r["pid"] == 903:
            assert tuple(r["s"]) in ((0.0, 0.0), (0.5, 0.5)) and tuple(r["c"]) == (0.5, 0.5)
        else:
            assert r["c"] is None and r["s"] is None


def test_profile_gives_the_geometry_of_its_rule(spark):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]
    rows = [(1, "polygon", {"addr:housenumber": "7"}, square), (2, "point", {"addr:housenumber": "8"}, [[{"x": 9.0, "y": 9.0}]]), (3, "polygon", {"building": "yes"}, square)]
    df = spark.createDataFrame(rows, "osm_id long, geom_kind string, tags map<string,string>, geom array<array<struct<x:double,y:double>>>")
    got = {(r["osm_id"], r["layer"]): r["geom"] for r in apply_profile(df).collect()}
    assert [tuple(p) for p in got[(1, "housenumber")][0]] == [(2.0, 1.0)] and [tuple(p) for p in got[(2, "housenumber")][0]] == [(9.0, 9.0)] and len(got[(3, "building")][0]) == 4


def test_equal_polygons_are_tested_once_and_never_broadcast(spark):
    r = random.Random(5)
    own = shapes(8, 12)
    copies = [(k + 1000 * c, rings) for c in range(5) for k, rings in own]
    points = [(k, x + r.gauss(0, 1), y + r.gauss(0, 1)) for k, (x, y) in enumerate(rings[0][0] for _ in range(20) for _, rings in own[:12])]
    got = polygons.points_in_polygons(spark.createDataFrame(points, "id long, x double, y double"), frame(spark, copies), "id", "pid", cell=2.0, wraps=False)
    want = sorted((i, k) for i, x, y in points for k, rings in copies if inside(rings, x, y))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
