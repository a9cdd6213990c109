"""Stand-ins with the same arithmetic in Spark and SQL: points, zones, segments, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.scalars import severity

REACH = 300.0
CELL = 2000.0

POINTS = """
  pts AS (SELECT event_id, ts, user_id, event_type, (event_id * 7919) % 3300 AS lon_i, (event_id * 104729) % 3800 AS lat_i FROM events),
  points AS (SELECT *, lon_i * 8.3e0 AS x, lat_i * 11.132e0 AS y, CAST(floor(lon_i / 660e0) + 5 * floor(lat_i / 380e0) + 1 AS INTEGER) AS zone,
    CASE event_type WHEN 'error' THEN 'fatal' WHEN 'purchase' THEN 'incapacitating' WHEN 'signup' THEN 'non_incapacitating'
      WHEN 'click' THEN 'reported_not_evident' ELSE 'unknown' END AS severity FROM pts)"""
SEGMENTS = """
  s0 AS (SELECT s_suppkey AS seg_id, s_nationkey AS corridor, ((s_suppkey * 4513) % 3200) * 8.3e0 AS x1, ((s_suppkey * 2917) % 3700) * 11.132e0 AS y1,
    (20 + (s_suppkey * 31) % 80) * 8.3e0 AS dx, ((s_suppkey * 17) % 60) * 11.132e0 AS dy FROM supplier),
  segments AS (SELECT seg_id, corridor, x1, y1, x1 + dx AS x2, y1 + dy AS y2 FROM s0)"""
# Lines of 3 to 50 vertices; every third has two parts, of which the first may be a single point.
POLYLINES = f"""{SEGMENTS}, v0 AS (SELECT seg_id, corridor, x1, y1, 3 + seg_id % 48 AS nv, unnest(range(3 + seg_id % 48)) AS j FROM segments),
  v1 AS (SELECT seg_id, corridor, j, CASE WHEN seg_id % 3 = 0 AND j >= nv // 2 THEN 1 ELSE 0 END AS part, x1 + j * (40 + seg_id % 7 * 10) AS x, y1 + ((j * j * 7 + seg_id * 13) % 11) * 60e0 AS y FROM v0),
  v AS (SELECT seg_id, corridor, part, j, x, y + 700e0 * part AS y FROM v1),
  edges AS (SELECT a.seg_id, a.corridor, a.part, a.j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.seg_id = b.seg_id AND a.part = b.part AND b.j = a.j + 1)"""
NEAREST = """
  d0 AS (SELECT event_id, seg_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM points, segments),
  d1 AS (SELECT *, least(1e0, greatest(0e0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM d0),
  d2 AS (SELECT event_id, seg_id, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS meters FROM d1),
  d3 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY meters, seg_id) AS rn FROM d2 WHERE meters <= 300e0),
  nearest AS (SELECT event_id, seg_id, meters FROM d3 WHERE rn = 1)"""


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    lon, lat = (F.col("event_id") * 7919) % 3300, (F.col("event_id") * 104729) % 3800
    return e.select("event_id", "ts", "user_id", "event_type", (lon * 8.3).alias("x"), (lat * 11.132).alias("y"), severity(F.col("event_type")).alias("severity"))


def zones(spark: SparkSession) -> DataFrame:
    """50 rectangles as rings."""
    z = spark.range(1, 51).select(F.col("id").cast("int").alias("zone"))
    i, j = (F.col("zone") - 1) % 5, F.floor((F.col("zone") - 1) / 5)

    def corner(a: int, b: int):
        return F.struct(((i + a) * 660 * 8.3).alias("x"), ((j + b) * 380 * 11.132).alias("y"))

    return z.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x1, y1 = ((k * 4513) % 3200) * 8.3, ((k * 2917) % 3700) * 11.132
    return t(spark, sf_dir, "supplier").select(
        k.alias("seg_id"), F.col("s_nationkey").alias("corridor"), x1.alias("x1"), y1.alias("y1"),
        (x1 + (20 + (k * 31) % 80) * 8.3).alias("x2"), (y1 + ((k * 17) % 60) * 11.132).alias("y2"),
    )


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seg_id")
    n = 3 + k % 48
    first = F.when(k % 3 == 0, F.floor(n / 2)).otherwise(n)

    def at(j: Column) -> Column:
        return F.struct((F.col("x1") + j * (40 + k % 7 * 10)).alias("x"), (F.col("y1") + ((j * j * 7 + k * 13) % 11) * 60.0 + F.when(j >= first, 700.0).otherwise(0.0)).alias("y"))

    every = F.transform(F.sequence(F.lit(0), n - 1), at)
    parts = F.filter(F.array(F.slice(every, F.lit(1), first), F.slice(every, first + 1, n)), lambda p: F.size(p) > 0)
    return segments(spark, sf_dir).select("seg_id", "corridor", parts.alias("parts"))


def boxed_lengths(edges: str, keys: str = "seg_id, corridor") -> str:
    """SQL: clipped (keys, region, meters), the length of ``edges`` inside ``boxes`` (region, sign, ax, bx, ay, ty), with their signs."""

    def span(p: str, low: str, high: str) -> tuple[str, str]:
        d, at = f"({p}2 - {p}1)", f"{p}1"
        enter = f"CASE WHEN {d} > 0 THEN ({low} - {at}) / {d} WHEN {d} < 0 THEN ({high} - {at}) / {d} WHEN {at} >= {low} AND {at} < {high} THEN 0e0 ELSE 2e0 END"
        leave = f"CASE WHEN {d} > 0 THEN ({high} - {at}) / {d} WHEN {d} < 0 THEN ({low} - {at}) / {d} ELSE 1e0 END"
        return enter, leave

    (x0, x1), (y0, y1) = span("x", "ax", "bx"), span("y", "ay", "ty")
    return f"""c AS (SELECT {keys}, region, sign, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS long, greatest(0e0, {x0}, {y0}) AS t0, least(1e0, {x1}, {y1}) AS t1 FROM {edges}, boxes),
  clipped AS (SELECT {keys}, region, sum(sign * (t1 - t0) * long) AS meters FROM c WHERE t1 > t0 GROUP BY ALL)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by district: order, date, status, priority, price and the nation of the customer."""
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("c_nationkey").alias("district"))


FACTS = """
  facts AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, c_nationkey AS district
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
