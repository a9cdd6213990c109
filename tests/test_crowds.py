"""Crowded cells and long chains: results as ever, work spread, rounds bounded."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardspark.operators import graph, ranking, shapes, spatial
from wardspark.sources import files


@pytest.fixture()
def small_crowds(monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 40)


def crowd(rng, n):
    """Nine in ten points in one cell of 100 m, a third of these at one place; the rest wide apart."""
    out = []
    for i in range(n):
        k = rng.random()
        out.append((i, 30.0, 40.0) if k < 0.3 else (i, rng.uniform(0, 99), rng.uniform(0, 99)) if k < 0.9 else (i, rng.uniform(-900, 900), rng.uniform(-900, 900)))
    return out


def test_nearest_in_a_crowd(spark, small_crowds):
    rng = random.Random(1)
    points = crowd(rng, 1500)
    lines = [(k, *(rng.uniform(-200, 250) for _ in range(4))) for k in range(40)] + [(40, 30.0, 40.0, 30.0, 40.5), (41, -2000.0, 50.0, 2000.0, 50.0)]

    def away(x, y, a, b, c, d):
        t = min(1, max(0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(x - a - t * (c - a), y - b - t * (d - b))

    p, q = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(lines, "line int, x1 double, y1 double, x2 double, y2 double")
    assert spatial.crowded_cells(p, 30.0).select("level").distinct().count() == spatial.DEPTH + 1
    for size in (30.0, 100.0):
        got = {r.id: (r.line, r.meters) for r in spatial.nearest_line(p, q, 30.0, "id", "line", size).collect()}
        for i, x, y in points:
            best = min((away(x, y, *line[1:]), line[0]) for line in lines)
            assert (i in got) == (best[0] <= 30) and (i not in got or (abs(got[i][1] - best[0]) < 1e-6 and got[i][0] == best[1]))


def test_work_is_spread(spark, monkeypatch):
    """With nine points in ten in one cell, no leaf of the join holds many: the fullest of eight partitions has less than three times the median."""
    monkeypatch.setattr(spatial, "CROWD", 500)
    p = spark.createDataFrame(crowd(random.Random(2), 40_000), "id int, x double, y double")
    leaves = spatial._leaf_of_points(p, spatial.crowded_cells(p, 100.0), 100.0, "id")
    most = leaves.groupBy("level", "cx", "cy", "part").count().agg(F.max("count")).first()[0]
    per = sorted(r["count"] for r in leaves.repartition(8, "level", "cx", "cy", "part").groupBy(F.spark_partition_id()).count().collect())
    assert most < 700 and len(per) == 8 and per[-1] < 3 * per[4]


def test_polygons_in_a_crowd(spark, small_crowds):
    rng = random.Random(3)
    points = crowd(rng, 900)
    rings = "array<array<struct<x:double,y:double>>>"
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    zones = {1: [square(0.0, 50.0), square(20.0, 35.0)], 2: [square(-500.0, 500.0)], 3: [square(600.0, 700.0)]}
    p, z = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(list(zones.items()), f"zone int, rings {rings}")
    got = sorted((r.id, r.zone) for r in shapes.points_in_polygons(p, z, "zone", 100.0, "inner").collect())
    within = lambda x, y, a, b: a <= x < b and a <= y < b
    want = [(i, k) for i, x, y in points for k, (a, *hole) in zones.items() if within(x, y, a[0][0], a[1][0]) and not any(within(x, y, h[0][0], h[1][0]) for h in hole)]
    assert got == sorted(want)
    assert shapes.points_in_polygons(p, z, "zone", 100.0).select("id").distinct().count() == len(points)


def by_hand(rows):
    seen_a, seen_b, kept = set(), set(), []
    for n, a, b in sorted(rows):
        if not ((a is not None and a in seen_a) or (b is not None and b in seen_b)):
            kept.append(n)
            seen_a.add(a)
            seen_b.add(b)
    return kept


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(1000)]
    made = []
    write = files.kept
    for at in (files, graph):
        monkeypatch.setattr(at, "kept", lambda df: (made.append(1), write(df))[1])
    got = sorted(r.n for r in ranking.dedupe_by_either(spark.createDataFrame(rows, "n int, a string, b string").repartition(4), "a", "b", "n").collect())
    assert got == by_hand(rows) and len(made) < 80


def test_clusters_of_chains_stars_and_loops(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUBS", 10)
    rng = random.Random(6)
    names = list(range(900))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(300)] + [(names[400], names[k]) for k in range(401, 500)] + [(names[k], names[500 + (k + 1) % 30]) for k in range(500, 530)] + [(5, 5), (names[600], names[601]), (names[601], names[600])]
    low = {n: n for n in names}
    for _ in range(400):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.id: r.cluster for r in graph.clusters(spark.createDataFrame([(n,) for n in names], "id int"), spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == low


@pytest.mark.parametrize("largest", [10**6, 30, 0])
def test_either_key_against_brute_force(spark, largest):
    """Hot keys, chains, null keys on either or both sides; all in one pass, some by rounds, all by rounds."""
    rng = random.Random(largest)
    rows = [(i, rng.choice([None, "hot", *(f"a{k}" for k in range(60))]), rng.choice([None, *(f"b{k}" for k in range(90))])) for i in range(400)] + [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    assert sorted(r.n for r in ranking.dedupe_by_either(df, "a", "b", "n", largest).collect()) == by_hand(rows)
