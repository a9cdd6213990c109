"""Plans and steps whose cost grows no faster than the input."""

import math
import random

from pyspark.sql import functions as F

from wardspark.operators import graph, shapes, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_line_by_place(spark):
    """Lines' cells are not broadcast though the lines look small, what is within reach is not sorted, and many points of one place are one."""
    points = spark.range(2000).selectExpr("id", "cast(id % 7 as double) x", "cast(id % 5 as double) y")
    lines = spark.range(300).selectExpr("id as line", "cast(id as double) x1", "0d y1", "cast(id as double) + 50 x2", "9d y2")
    out = spatial.nearest_line(points, lines, 30.0, "id", "line")
    told = plan(out)
    assert "BroadcastHashJoin [cx" not in told and "SortAggregate" not in told

    def away(x, y, k):
        u = min(1, max(0, ((x - k) * 50 + y * 9) / (50 * 50 + 81)))
        return math.hypot(x - k - u * 50, y - u * 9)

    want = {(x, y): min((round(away(x, y, k), 9), k) for k in range(300)) for x in range(7) for y in range(5)}
    got = {r.id: (round(r.meters, 9), r.line) for r in out.collect()}
    assert len(got) == 2000 and all(got[i] == want[i % 7, i % 5] for i in got)


def test_points_of_a_hot_place(spark, monkeypatch):
    """Most points at one place: all are answered, ties to the least id."""
    monkeypatch.setattr(spatial, "CROWD", 50)
    points = spark.range(1000).selectExpr("id", "if(id < 900, 1d, cast(id as double)) x", "2d y")
    lines = spark.createDataFrame([(8, 0.0, 0.0, 2000.0, 0.0), (3, 0.0, 0.0, 2000.0, 0.0)], "line int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.nearest_line(points, lines, 2.0, "id", "line").collect()
    assert sorted(r.id for r in got) == list(range(1000)) and {(r.line, r.meters) for r in got} == {(3, 2.0)}


def test_dense_lines_meet_few_routes(spark, monkeypatch):
    """Only lines that share no cell with a route are tested edge by edge; results equal brute force."""
    rng = random.Random(4)
    line = lambda k, wide: (k, *(p := (rng.uniform(0, wide), rng.uniform(0, wide))), p[0] + rng.uniform(-90, 90), p[1] + rng.uniform(-90, 90))
    columns = "id int, x1 double, y1 double, x2 double, y2 double"
    met, pairs = [], spatial._line_pairs
    monkeypatch.setattr(spatial, "_line_pairs", lambda a, *rest: (met.append(a.count()), pairs(a, *rest))[1])
    for wide in (300, 4000):
        a, b = [line(k, wide) for k in range(200)], [line(k, wide) for k in range(60)]
        got = {r.id for r in spatial.lines_away_from(spark.createDataFrame(a, columns), spark.createDataFrame(b, columns), 40.0, "id").collect()}

        def near(p, q):
            def to(x, y, s):
                dx, dy = s[3] - s[1], s[4] - s[2]
                u = min(1, max(0, ((x - s[1]) * dx + (y - s[2]) * dy) / (dx * dx + dy * dy)))
                return math.hypot(x - s[1] - u * dx, y - s[2] - u * dy)

            side = lambda s, x, y: (s[3] - s[1]) * (y - s[2]) - (s[4] - s[2]) * (x - s[1])
            cross = side(p, *q[1:3]) * side(p, *q[3:]) < 0 and side(q, *p[1:3]) * side(q, *p[3:]) < 0
            return cross or min(to(*p[1:3], q), to(*p[3:], q), to(*q[1:3], p), to(*q[3:], p)) <= 40

        assert got == {p[0] for p in a if not any(near(p, q) for q in b)}
    assert met[0] < 20


def test_chained_points_meet_where_cells_are_doubtful(spark):
    """Same clusters as all pairs give, at densities from lone points to crowds; in a crowd no cells are left to test but by their corners."""
    rng = random.Random(9)
    for n, wide in ((120, 3000), (200, 900), (150, 200)):
        points = [(i, rng.uniform(-wide, wide), rng.uniform(-wide, wide)) for i in range(n)] + [(n, 0.0, 5000.0), (n + 1, 0.0, 5150.0), (n + 2, 0.0, 5300.1)]
        df = spark.createDataFrame(points, "id int, x double, y double")
        low = {i: i for i, _, _ in points}
        for _ in range(len(points)):
            before = dict(low)
            for i, x, y in points:
                low[i] = min(low[j] for j, u, v in points if math.hypot(x - u, y - v) <= 150)
            if low == before:
                break
        got = {r.id: r.cluster for r in graph.clusters(df, spatial.chained_points(df, 150.0, "id")).collect()}
        assert got == low and got[n + 1] == n and got[n + 2] == n + 2
    crowd = spark.range(40_000).selectExpr("id", "(id % 200) * 5d + 1 x", "(id div 200) * 5d + 1 y").select("id", F.floor(F.col("x") / 12.5).cast("int").alias("sx"), F.floor(F.col("y") / 12.5).cast("int").alias("sy"))
    boxes = crowd.select(F.floor(F.col("sx") / 8).cast("int").alias("cx"), F.floor(F.col("sy") / 8).cast("int").alias("cy"), "sx", "sy").distinct()
    sure, doubtful = spatial._near_cells(boxes, 150.0)
    assert sure.count() > 400 and doubtful.count() < 10 * 100


def test_records_of_six_digits_are_not_cut(spark, tmp_path):
    """Item 100001 is not published although item 10000 is: records keep all their digits."""
    from wardspark.plans import registry

    registry.load()
    one = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(1).drop("o_orderkey")
    one.crossJoin(spark.createDataFrame([(10000,), (100001,), (100004,)], "o_orderkey long")).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.item: r.tracked for r in registry.QUERIES["decorated_items"](spark, str(tmp_path)).collect()}
    assert got == {10000: True, 100001: False, 100004: True}


def test_stretches_take_one_shuffle_of_bounded_tasks(spark, monkeypatch):
    """All steps use one shuffle by line, into partitions of some SHARE rows."""
    from wardspark.operators import ranking
    from wardspark.plans import registry

    registry.load()
    assert [ranking.partitions(spark.range(n), 500) for n in (0, 1, 500, 501)] == [1, 1, 1, 2]
    monkeypatch.setattr(ranking.partitions, "__defaults__", (100,))
    df = registry.QUERIES["best_grade_stretches"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    made = plan(df).split("- Exchange ")[1:]
    assert made and all("hashpartitioning(line#" in part and f", {-(-rows // 100)})" in part for part in made)


def test_meetings_in_cells_of_the_edges_size(spark, monkeypatch):
    """Many short edges and a very long one: few pairs are tested, and the meetings are those of any cell size."""
    grid = [(k, [[(k % 20 * 30.0 + 10 * i, k // 20 * 30.0) for i in range(3)]]) for k in range(400)] + [(900, [[(0.0, 10.0), (420.0, 430.0)]]), (901, [[(5.0, -5.0), (5.0, 5.0)]])]
    lines = spark.createDataFrame(grid, "id int, parts array<array<struct<x:double,y:double>>>")
    tested, pairs = [], spatial._line_pairs
    monkeypatch.setattr(spatial, "_line_pairs", lambda *a: (tested.append(pairs(*a).count()), pairs(*a))[1])
    told = lambda df: sorted((r.a, r.b, round(r.x, 6), round(r.y, 6), r.kind) for r in df.collect())
    some, all_ = told(shapes.line_meetings(lines, "id")), told(shapes.line_meetings(lines, "id", 500.0))
    assert some == all_ and len(some) > 5 and tested[0] < tested[1] / 5


def test_parts_are_read_once(spark):
    """Rows are counted in the bytes that the digest takes: no second read of the files, which went back for each row."""
    from wardspark.plans import registry

    registry.load()
    df = registry.QUERIES["columnar_rows"](spark, "/root/testdata/sf0.001")
    assert plan(df).count("Scan ") == 1 and "json" not in plan(df).split("Scan ")[1].split("[")[0]
    assert df.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
