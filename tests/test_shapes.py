"""Lines of many vertices and parts, polygons with holes and parts, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardspark.operators import shapes

POINTS = "array<array<struct<x:double,y:double>>>"


def inside(x, y, rings):
    """Ray to the east over all edges of all rings; borders belong to the east and north."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
    return n % 2 == 1


def star(rng, cx, cy, size, n):
    return [(cx + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def polygons():
    """Stars with holes and islands in the holes, far larger and far smaller than a cell; rings on cell borders; one that repeats its first point."""
    rng = random.Random(7)
    out = {k: [star(rng, rng.uniform(-900, 900), rng.uniform(-900, 900), size, n), star(rng, 0, 0, size / 9, 5)] for k, (size, n) in enumerate([(800, 40), (800, 7), (30, 5), (3, 4), (500, 300)])}
    square = lambda low, high: [(low, low), (high, low), (high, high), (low, high)]
    out[10] = [square(-1000.0, 1000.0), square(-600.0, 600.0), square(-200.0, 200.0)]
    out[11] = [square(0.0, 100.0) + [(0.0, 0.0)], square(300.0, 400.0)[::-1]]
    out[12] = [[(0.0, 0.0), (50.0, 0.0)], []]
    return out


@pytest.mark.parametrize("size", [100.0, 37.5, 5000.0])
def test_points_in_polygons(spark, size):
    rng = random.Random(int(size))
    points = [(rng.uniform(-1100, 1100), rng.uniform(-1100, 1100)) for _ in range(1500)] + [(float(x), float(y)) for x in (-1000, -600, 0, 100, 300, 400, 1000) for y in (-600, -200, 0, 50, 100, 350, 1000)] + [(37.5, 20.0), (75.0, 75.0)]
    shapes_ = polygons()
    p = spark.createDataFrame([(i, *xy) for i, xy in enumerate(points)], "id int, x double, y double")
    z = spark.createDataFrame([*shapes_.items(), (13, None), (14, [None])], f"zone int, rings {POINTS}")
    got = {(r.id, r.zone) for r in shapes.points_in_polygons(p, z, "zone", size, "inner").collect()}
    assert got == {(i, k) for i, (x, y) in enumerate(points) for k, rings in shapes_.items() if inside(x, y, rings)}
    left = shapes.points_in_polygons(p, z, "zone", size)
    assert {r.id for r in left.filter("zone is null").collect()} == {i for i in range(len(points))} - {i for i, _ in got}


def test_inner_cells_carry_no_edges(spark):
    """Most cells of a large doughnut are inside as a whole; no cell carries the whole ring."""
    ring = lambda r: [(r * math.cos(k / 200 * math.pi), r * math.sin(k / 200 * math.pi)) for k in range(400)]
    z = spark.createDataFrame([(1, [ring(5000.0), ring(2000.0)])], f"zone int, rings {POINTS}")
    cells = shapes.cell_index(z, "zone", 100.0).select("corner", F.size("edges").alias("n")).toPandas()
    area = math.pi * (50**2 - 20**2)
    assert 0.85 * area < (cells.n == 0).sum() < area and cells.corner[cells.n == 0].all() and cells.n.max() < 12


def lengths_by_hand(parts, rings, steps=4000):
    total = 0.0
    for part in parts:
        for (ax, ay), (bx, by) in zip(part, part[1:]):
            hits = sum(inside(ax + (k + 0.5) / steps * (bx - ax), ay + (k + 0.5) / steps * (by - ay), rings) for k in range(steps))
            total += hits / steps * math.hypot(bx - ax, by - ay)
    return total


def test_clipped_lengths(spark):
    rng = random.Random(2)
    lines = {k: [[(rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 2))] for k in range(5)}
    lines[9] = [[(-1200.0, 1000.0), (1200.0, 1000.0)], [(0.0, -1000.0), (0.0, -600.0), (0.0, 700.0)]]  # along borders
    held = {k: polygons()[k] for k in (1, 10, 11)}
    got = {(r.line, r.zone): r.meters for r in shapes.clipped_lengths(spark.createDataFrame([*lines.items(), (50, None)], f"line int, parts {POINTS}"), spark.createDataFrame(list(held.items()), f"zone int, rings {POINTS}"), 150.0, "line", "zone").collect()}
    for i, parts in lines.items():
        for k, rings in held.items():
            assert abs(got.get((i, k), 0.0) - lengths_by_hand(parts, rings)) < 4
    lengths = {r.line: r.meters for r in shapes.line_lengths(spark.createDataFrame([*lines.items(), *lines.items(), (50, None)], f"line int, parts {POINTS}"), "line").collect()}
    assert lengths[50] == 0 and all(abs(lengths[i] - sum(math.dist(a, b) for p in parts for a, b in zip(p, p[1:]))) < 1e-6 for i, parts in lines.items())


def test_nearest_of_all_parts(spark):
    rng = random.Random(5)
    lines = {k: [[(rng.uniform(0, 3000), rng.uniform(0, 3000)) for _ in range(rng.randint(1, 50))] for _ in range(2)] for k in range(12)}
    points = [(i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(300)] + [(999, 1e6, 1e6)]

    def away(x, y, a, b):
        d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = min(1, max(0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / d))
        return math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1]))

    got = {r.id: (r.line, r.meters) for r in shapes.nearest_line(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(list(lines.items()), f"line int, parts {POINTS}"), 60.0, "id", "line").collect()}
    for i, x, y in points:
        best = min((away(x, y, a, b), k) for k, parts in lines.items() for p in parts for a, b in zip(p, p[1:]))
        assert (i in got) == (best[0] <= 60) and (i not in got or (got[i][0] == best[1] and abs(got[i][1] - best[0]) < 1e-6))


def meetings(spark, lines):
    df = spark.createDataFrame(list(lines.items()), f"id int, parts {POINTS}")
    return sorted((r.a, r.b, round(r.x, 6), round(r.y, 6), r.kind, round(r.meters, 6)) for r in shapes.line_meetings(df, "id", 100.0).collect())


def test_stretches_run_across_vertices(spark):
    """Around a corner as one stretch with its middle by length; a touch apart from it is a point of its own; either direction; loops that come back."""
    ell = [(float(x), 0.0) for x in range(0, 301, 60)] + [(300.0, float(y)) for y in range(50, 201, 50)]
    back = [(300.0, 200.0), (300.0, 77.0), (300.0, 0.0), (222.0, 0.0), (100.0, 0.0)]
    assert meetings(spark, {1: [ell], 2: [back]}) == [(1, 2, 300.0, 0.0, "overlap", 400.0)]
    assert meetings(spark, {1: [ell], 2: [[(140.0, 0.0), (140.0, -20.0), (160.0, 0.0), (200.0, 0.0)]]}) == [(1, 2, 140.0, 0.0, "point", 0.0), (1, 2, 180.0, 0.0, "overlap", 40.0)]
    assert meetings(spark, {1: [ell], 2: [[(120.0, -50.0), (120.0, 50.0)], [(300.0, 50.0), (400.0, 50.0)]]}) == [(1, 2, 120.0, 0.0, "point", 0.0), (1, 2, 300.0, 50.0, "point", 0.0)]
    assert meetings(spark, {1: [ell], 2: [[(0.0, 0.0), (100.0, 0.0), (50.0, 0.0), (150.0, 0.0)]], 3: [[(0.0, 9.0), (100.0, 9.0)]]}) == [(1, 2, 75.0, 0.0, "overlap", 150.0)]
    assert meetings(spark, {1: [[(0.0, 0.0), (50.0, 0.0)], [(50.0, 0.0), (90.0, 0.0)]], 2: [[(50.0, -9.0), (50.0, 9.0)]], 5: [[(7.0, 7.0)]]}) == [(1, 2, 50.0, 0.0, "point", 0.0)]


def test_two_streets_that_share_a_block(spark):
    """The middle of the shared block, in degrees times a thousand."""
    west, east = [(-87700.0, 41850.0), (-87600.0, 41850.0)], [(-87650.0, 41850.0), (-87550.0, 41850.0)]
    assert meetings(spark, {1: [west], 2: [east]}) == [(1, 2, -87625.0, 41850.0, "overlap", 50.0)]


def test_lines_away(spark):
    lines = spark.createDataFrame([(1, [[(0.0, 5.0), (100.0, 5.0)], [(0.0, 900.0), (9.0, 900.0)]]), (2, [[(0.0, 830.0), (40.0, 835.0), (100.0, 830.0)]]), (3, None)], f"id int, parts {POINTS}")
    routes = spark.createDataFrame([(9, [[(0.0, 0.0), (50.0, 0.0), (100.0, 0.0)]])], f"id int, parts {POINTS}")
    assert sorted(r.id for r in shapes.lines_away_from(lines, routes, 25.0, "id").collect()) == [2, 3]
