"""Queries on points, zones and line networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.functions.scalars import distance, ratio
from wardspark.operators import graph, ranking, spatial
from wardspark.plans.registry import query
from wardspark.plans.standins import CELL, NEAREST, POINTS, REACH, SEGMENTS, points, segments, t, zones


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_polygons(points(spark, sf_dir), zones(spark), CELL)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_line(points(spark, sf_dir), segments(spark, sf_dir), REACH, "event_id", "seg_id")


@query(f"""WITH {POINTS}, r AS (SELECT zone, count(*) AS incidents, count(*) FILTER (severity IN ('incapacitating', 'non_incapacitating', 'reported_not_evident')) AS injuries,
  count(*) FILTER (severity = 'fatal') AS fatalities FROM points GROUP BY zone),
  o AS (SELECT list(incidents ORDER BY incidents) AS v FROM r)
  SELECT zone, incidents, injuries, fatalities, CASE WHEN incidents <= v[greatest(0, len(v) // 3 - 1) + 1] THEN 'low' WHEN incidents <= v[greatest(0, len(v) * 2 // 3 - 1) + 1] THEN 'medium' ELSE 'high' END AS band FROM r, o""")
def zone_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1 JON-1 AGG-2 WIN-3: incidents per zone and their density band; zones without one count 0."""
    hurt = F.col("severity").isin("incapacitating", "non_incapacitating", "reported_not_evident")
    counts = located(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("incidents"), F.count_if(hurt).alias("injuries"), F.count_if(F.col("severity") == "fatal").alias("fatalities"))
    rolled = zones(spark).select("zone").join(counts, "zone", "left").fillna(0)
    return ranking.terciles(rolled, "incidents", "band").orderBy("zone")


@query(f"WITH {POINTS} SELECT zone, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY zone)::BIGINT AS total FROM points GROUP BY zone, event_type")
def zone_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-3: points counted by the polygon that holds them, not by an attribute."""
    n = located(spark, sf_dir).groupBy("zone", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("zone")))


@query(f"WITH {POINTS}, {SEGMENTS}, {NEAREST} SELECT event_id, seg_id, round(meters, 3) AS meters FROM nearest")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-2: the nearest segment within reach, inclusive; the least id on ties."""
    return nearest(spark, sf_dir).withColumn("meters", F.round("meters", 3))


@query(f"WITH {POINTS}, {SEGMENTS}, {NEAREST} SELECT s.seg_id, count(event_id) AS incidents FROM segments s LEFT JOIN nearest USING (seg_id) GROUP BY s.seg_id")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1 JON-11: incidents per segment, zero where none."""
    n = nearest(spark, sf_dir).groupBy("seg_id").agg(F.count(F.lit(1)).alias("incidents"))
    return segments(spark, sf_dir).select("seg_id").join(n, "seg_id", "left").fillna(0)


@query(f"""WITH {POINTS}, g AS (SELECT CAST(round_even(x / 1e3, 0) AS BIGINT) AS cx, CAST(round_even(y / 1e3, 0) AS BIGINT) AS cy, count(*) AS incidents, round(avg(x), 3) AS mean_x, round(avg(y), 3) AS mean_y FROM points GROUP BY 1, 2 HAVING count(*) >= 2),
  k AS (SELECT CAST(round_even(x / 1e3, 0) AS BIGINT) AS cx, CAST(round_even(y / 1e3, 0) AS BIGINT) AS cy, event_type, count(*) AS n FROM points GROUP BY ALL),
  m AS (SELECT cx, cy, event_type, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, event_type) AS rn FROM k)
  SELECT g.cx, g.cy, incidents, mean_x, mean_y, event_type AS label FROM g JOIN m ON g.cx = m.cx AND g.cy = m.cy AND rn = 1 ORDER BY incidents DESC, g.cx, g.cy LIMIT 25""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4 ORD-4: the 25 grid cells (the nearest multiple of a kilometre, halves to even) with most incidents, centroid and most frequent label (first by name on ties)."""
    p = points(spark, sf_dir).select(F.rint(F.col("x") / 1000).cast("long").alias("cx"), F.rint(F.col("y") / 1000).cast("long").alias("cy"), "x", "y", "event_type")
    kinds = p.groupBy("cx", "cy", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    cells = kinds.groupBy("cx", "cy").agg(F.sum("n").alias("incidents"), F.round(F.sum("sx") / F.sum("n"), 3).alias("mean_x"), F.round(F.sum("sy") / F.sum("n"), 3).alias("mean_y"), F.min(F.struct(-F.col("n"), "event_type")).alias("m"))
    return cells.filter("incidents >= 2").select("cx", "cy", "incidents", "mean_x", "mean_y", F.col("m.event_type").alias("label")).orderBy(F.col("incidents").desc(), "cx", "cy").limit(25)


@query(f"WITH {POINTS} SELECT CAST(floor(x / 5e2) AS BIGINT) AS bx, CAST(floor(y / 5e2) AS BIGINT) AS by, (floor(x / 5e2) + 0.5e0) * 500 AS center_x, (floor(y / 5e2) + 0.5e0) * 500 AS center_y, count(*) AS n FROM points GROUP BY ALL")
def density_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5: counts per bin and the bin's centre."""
    bx, by = F.floor(F.col("x") / 500), F.floor(F.col("y") / 500)
    n = points(spark, sf_dir).groupBy(bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("bx", "by", ((F.col("bx") + 0.5) * 500).alias("center_x"), ((F.col("by") + 0.5) * 500).alias("center_y"), "n")


_CLIP = f"""WITH {SEGMENTS}, z AS (SELECT CAST(range AS INTEGER) AS zone, ((range - 1) % 5) * 660 * 8.3e0 AS ax, ((range - 1) % 5 + 1) * 660 * 8.3e0 AS bx, ((range - 1) // 5) * 380 * 11.132e0 AS ay, ((range - 1) // 5 + 1) * 380 * 11.132e0 AS ty FROM range(1, 51)),
  c AS (SELECT seg_id, corridor, zone, x2 - x1 AS dx, y2 - y1 AS dy,
    greatest(0e0, (ax - x1) / (x2 - x1), CASE WHEN y2 > y1 THEN (ay - y1) / (y2 - y1) WHEN y1 >= ay AND y1 < ty THEN 0e0 ELSE 2e0 END) AS t0,
    least(1e0, (bx - x1) / (x2 - x1), CASE WHEN y2 > y1 THEN (ty - y1) / (y2 - y1) ELSE 1e0 END) AS t1 FROM segments, z),
  clipped AS (SELECT seg_id, corridor, zone, (t1 - t0) * sqrt(dx * dx + dy * dy) AS meters FROM c WHERE t1 - t0 > 1e-9)"""


@query(f"{_CLIP} SELECT seg_id, zone, round(meters, 3) AS meters FROM clipped")
def clipped_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-6: metres of each line inside each polygon."""
    out = spatial.clipped_lengths(segments(spark, sf_dir).drop("corridor"), zones(spark), CELL, "seg_id", "zone")
    return out.filter("meters > 1e-6").select("seg_id", "zone", F.round("meters", 3).alias("meters"))


@query(f"{_CLIP} SELECT zone, corridor % 5 AS category, round(sum(meters), 2) AS meters FROM clipped GROUP BY ALL")
def clipped_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-7: metres per polygon and category."""
    out = spatial.clipped_lengths(segments(spark, sf_dir), zones(spark), CELL, "seg_id", "zone")
    return out.filter("meters > 1e-6").groupBy("zone", (F.col("corridor") % 5).alias("category")).agg(F.round(F.sum("meters"), 2).alias("meters"))


def _seg_distance_sql(limit: str) -> str:
    def ps(p: str, q: str) -> str:  # distance of point p (x, y columns) from segment q (prefix)
        px, py = p.split()
        dx, dy = f"({q}x2 - {q}x1)", f"({q}y2 - {q}y1)"
        tt = f"least(1e0, greatest(0e0, (({px} - {q}x1) * {dx} + ({py} - {q}y1) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
        return f"sqrt(power({px} - ({q}x1 + {tt} * {dx}), 2) + power({py} - ({q}y1 + {tt} * {dy}), 2))"

    def side(a: str, px: str, py: str) -> str:
        return f"(({a}x2 - {a}x1) * ({py} - {a}y1) - ({a}y2 - {a}y1) * ({px} - {a}x1))"

    cross = f"({side('a.', 'b.x1', 'b.y1')} * {side('a.', 'b.x2', 'b.y2')} < 0 AND {side('b.', 'a.x1', 'a.y1')} * {side('b.', 'a.x2', 'a.y2')} < 0)"
    return cross if limit == "cross" else f"({cross} OR least({ps('a.x1 a.y1', 'b.')}, {ps('a.x2 a.y2', 'b.')}, {ps('b.x1 b.y1', 'a.')}, {ps('b.x2 b.y2', 'a.')}) <= {limit})"


@query(f"WITH {SEGMENTS} SELECT seg_id FROM segments a WHERE seg_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM segments b WHERE b.seg_id % 3 = 0 AND {_seg_distance_sql('250e0')})")
def parts_away_from_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-8: line parts with no route within 250 m."""
    s = segments(spark, sf_dir).drop("corridor")
    return spatial.lines_away_from(s.filter("seg_id % 3 <> 0"), s.filter("seg_id % 3 = 0"), 250.0, "seg_id").select("seg_id")


@query(f"""WITH {POINTS}, u AS (SELECT user_id, count(*) AS trips, min(event_id) AS first_event FROM events GROUP BY user_id)
  SELECT zone, CAST(sum(trips) AS BIGINT) AS trips, count(*) AS stations FROM u JOIN points ON first_event = event_id GROUP BY zone""")
def station_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-4: trips are counted per station first, then each station is located once."""
    p = points(spark, sf_dir)
    stations = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("trips"), F.min(F.struct("event_id", "x", "y")).alias("s")).select("trips", "s.x", "s.y")
    return spatial.points_in_polygons(stations, zones(spark), CELL, "inner").groupBy("zone").agg(F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("stations"))


@query(f"""WITH {POINTS}, {SEGMENTS}, {NEAREST} SELECT p.event_id, zone, severity, CASE WHEN seg_id IS NULL THEN 'off_network' ELSE 'category_' || (corridor % 5) END AS facility
  FROM points p LEFT JOIN nearest USING (event_id) LEFT JOIN segments USING (seg_id) WHERE severity IN ('fatal', 'incapacitating') AND zone BETWEEN 10 AND 30 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def filtered_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-13: part of the composite filter, with the facility of the nearest segment or off_network."""
    p = located(spark, sf_dir).filter(F.col("severity").isin("fatal", "incapacitating") & F.col("zone").between(10, 30) & (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-20"))
    seg = nearest(spark, sf_dir).join(segments(spark, sf_dir).select("seg_id", "corridor"), "seg_id").select("event_id", F.concat(F.lit("category_"), F.col("corridor") % 5).alias("facility"))
    return p.join(seg, "event_id", "left").select("event_id", "zone", "severity", F.coalesce("facility", F.lit("off_network")).alias("facility"))


@query(f"""WITH {POINTS}, r AS (SELECT zone, count(*) AS incidents, count(*) FILTER (severity = 'fatal') AS fatal FROM points GROUP BY zone),
  s AS (SELECT *, (row_number() OVER (ORDER BY incidents, zone) - 1) * 100e0 / (count(*) OVER () - 1) AS rank_incidents, CASE WHEN fatal > 0 THEN fatal * 1e0 / incidents END AS rate FROM r),
  f AS (SELECT *, CASE WHEN rate IS NOT NULL THEN (row_number() OVER (PARTITION BY rate IS NOT NULL ORDER BY rate, zone) - 1) * 100e0 / (count(*) OVER (PARTITION BY rate IS NOT NULL) - 1) END AS rank_rate FROM s),
  d AS (SELECT zone, incidents, fatal, CASE WHEN rank_rate IS NULL THEN rank_incidents ELSE (rank_incidents + rank_rate) / 2 END AS score FROM f)
  SELECT zone, incidents, fatal, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, zone) AS INTEGER) AS position FROM d""")
def danger_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1 WIN-2 WIN-4: mean of the percentile ranks that exist, and the published order, nulls last."""
    r = located(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("severity") == "fatal").alias("fatal"))
    r = r.withColumn("rate", F.when(F.col("fatal") > 0, F.col("fatal") / F.col("incidents")))
    r = ranking.percentile_rank(ranking.percentile_rank(r, "incidents", "zone", "a"), "rate", "zone", "b")
    d = ranking.blended(r, ["a", "b"], "score")
    place = F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "zone"))
    return d.select("zone", "incidents", "fatal", F.round("score", 4).alias("score"), place.alias("position"))


@query("""WITH i AS (SELECT l_orderkey AS line, l_linenumber * 7 AS a, l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS b, CAST(round(l_discount * 100) AS INTEGER) % 5 AS grade FROM lineitem),
  p AS (SELECT DISTINCT line, v FROM (SELECT line, a AS v FROM i UNION ALL SELECT line, b FROM i)), e AS (SELECT line, v AS a, lead(v) OVER (PARTITION BY line ORDER BY v) AS b FROM p),
  g AS (SELECT e.line, e.a, e.b, max(grade) AS grade FROM e JOIN i ON e.line = i.line AND i.a <= e.a AND i.b >= e.b WHERE e.b IS NOT NULL GROUP BY ALL),
  n AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(grade) OVER w = grade THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY line ORDER BY a)),
  k AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY a) AS island FROM n)
  SELECT line, min(a) AS start_at, max(b) AS end_at, grade FROM k GROUP BY line, island, grade""")
def best_grade_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16: overlapping graded intervals cut at every boundary, the better grade taken, equal neighbours merged."""
    li = t(spark, sf_dir, "lineitem")
    a = F.col("l_linenumber") * 7
    i = li.select(F.col("l_orderkey").alias("line"), a.alias("a"), (a + F.col("l_quantity").cast("int")).alias("b"), (F.round(F.col("l_discount") * 100).cast("int") % 5).alias("grade"))
    # One shuffle by line for all steps, into so many partitions that none grows with the input.
    i = i.repartition(ranking.partitions(li), "line")
    cuts = i.select("line", F.explode(F.array("a", "b")).alias("at")).distinct()
    w = Window.partitionBy("line").orderBy("at")
    pieces = cuts.select(F.col("line"), F.col("at").alias("lo"), F.lead("at").over(w).alias("hi")).filter("hi is not null")
    graded = pieces.join(i, "line").filter("a <= lo and b >= hi").groupBy("line", "lo", "hi").agg(F.max("grade").alias("grade"))
    v = Window.partitionBy("line").orderBy("lo")
    fresh = F.when((F.lag("hi").over(v) == F.col("lo")) & (F.lag("grade").over(v) == F.col("grade")), 0).otherwise(1)
    islands = graded.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(v))
    return islands.groupBy("line", "island", "grade").agg(F.min("lo").alias("start_at"), F.max("hi").alias("end_at")).drop("island")
