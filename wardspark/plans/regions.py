"""Queries on lines of many vertices and parts, and on zones with holes and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators import shapes
from wardspark.plans.geo import _seg_distance_sql
from wardspark.plans.network import _LATTICE, _streets
from wardspark.plans.registry import query
from wardspark.plans.standins import CELL, POINTS, POLYLINES, boxed_lengths, points, polylines

# Stand-in zones: the inner rectangle of each even zone is a hole, and a part of the zone before it.
_ENCLAVES = f"""{POINTS}, regions AS (SELECT *, CASE WHEN zone % 2 = 0 AND lon_i % 660 >= 198 AND lon_i % 660 < 462 AND lat_i % 380 >= 114 AND lat_i % 380 < 266 THEN zone - 1 ELSE zone END AS region FROM points)"""


def regions(spark: SparkSession) -> DataFrame:
    """The 50 zones as rings."""
    z = F.col("region")

    def rectangle(zone: Column, x: tuple[int, int], y: tuple[int, int]) -> Column:
        i, j = (zone - 1) % 5, F.floor((zone - 1) / 5)
        corner = lambda a, b: F.struct(((i * 660 + a) * 8.3).alias("x"), ((j * 380 + b) * 11.132).alias("y"))
        return F.array(corner(x[0], y[0]), corner(x[1], y[0]), corner(x[1], y[1]), corner(x[0], y[1]))

    inner = rectangle(F.when(z % 2 == 0, z).otherwise(z + 1), (198, 462), (114, 266))
    return spark.range(1, 51).select(F.col("id").cast("int").alias("region")).withColumn("rings", F.array(rectangle(z, (0, 660), (0, 380)), inner))


@query(f"WITH {_ENCLAVES} SELECT region, event_type, count(*) AS n FROM regions GROUP BY ALL")
def regions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-1 JON-3: points counted by the zone that holds them, where zones have holes and parts inside others; cells without a border need no test."""
    located = shapes.points_in_polygons(points(spark, sf_dir), regions(spark), "region", CELL / 2)
    return located.groupBy("region", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ENCLAVES}, c AS (SELECT user_id, arg_min(region, event_id) AS region FROM regions GROUP BY user_id) SELECT user_id, region FROM c")
def clicked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-5: the zone of each user's first point, holes and parts included."""
    first = points(spark, sf_dir).groupBy("user_id").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p")).select("user_id", "p.x", "p.y")
    return shapes.points_in_polygons(first, regions(spark), "region", CELL / 2).select("user_id", "region")


@query(f"""WITH {POINTS}, {POLYLINES},
  d0 AS (SELECT event_id, seg_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM points, edges WHERE x BETWEEN least(x1, x2) - 3e2 AND greatest(x1, x2) + 3e2 AND y BETWEEN least(y1, y2) - 3e2 AND greatest(y1, y2) + 3e2),
  d1 AS (SELECT *, least(1e0, greatest(0e0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM d0),
  d2 AS (SELECT event_id, seg_id, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS meters FROM d1)
  SELECT event_id, seg_id, round(meters, 3) AS meters FROM d2 WHERE meters <= 300e0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY meters, seg_id) = 1""")
def nearest_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-2: the nearest line within reach, over all edges of all its parts; the least id on ties."""
    return shapes.nearest_line(points(spark, sf_dir), polylines(spark, sf_dir), 300.0, "event_id", "seg_id").withColumn("meters", F.round("meters", 3))


_BOXES = """z AS (SELECT CAST(range AS INTEGER) AS zone, ((range - 1) % 5) * 660 AS i, ((range - 1) // 5) * 380 AS j FROM range(1, 51)),
  boxes AS (SELECT zone AS region, 1 AS sign, i * 8.3e0 AS ax, (i + 660) * 8.3e0 AS bx, j * 11.132e0 AS ay, (j + 380) * 11.132e0 AS ty FROM z
    UNION ALL SELECT zone, CASE WHEN zone % 2 = 0 THEN -1 ELSE 1 END, (k + 198) * 8.3e0, (k + 462) * 8.3e0, (l + 114) * 11.132e0, (l + 266) * 11.132e0
      FROM (SELECT z.zone, o.i AS k, o.j AS l FROM z JOIN z o ON o.zone = CASE WHEN z.zone % 2 = 0 THEN z.zone ELSE z.zone + 1 END))"""
_CLIPPED = f"{POLYLINES}, {_BOXES}, {boxed_lengths('edges')}"


@query(f"WITH {_CLIPPED} SELECT seg_id, region, round(meters, 3) AS meters FROM clipped WHERE meters > 1e-4")
def clipped_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-6: metres of each line, all vertices and parts, inside each zone with holes and parts."""
    out = shapes.clipped_lengths(polylines(spark, sf_dir), regions(spark), CELL / 2, "seg_id", "region")
    return out.filter("meters > 1e-4").select("seg_id", "region", F.round("meters", 3).alias("meters"))


@query(f"WITH {_CLIPPED} SELECT region, corridor % 5 AS category, round(sum(meters), 2) AS meters FROM clipped GROUP BY ALL HAVING sum(meters) > 1e-4")
def clipped_regions_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-7: metres per zone and category over all vertices."""
    lines = polylines(spark, sf_dir)
    out = shapes.clipped_lengths(lines, regions(spark), CELL / 2, "seg_id", "region").join(lines.select("seg_id", "corridor"), "seg_id")
    return out.groupBy("region", (F.col("corridor") % 5).alias("category")).agg(F.sum("meters").alias("m")).filter("m > 1e-4").select("region", "category", F.round("m", 2).alias("meters"))


@query(f"""WITH {POLYLINES}, a AS (SELECT seg_id, least(x1, x2) - 300 AS w, greatest(x1, x2) + 300 AS e, x1, y1, x2, y2 FROM edges WHERE seg_id % 5 <> 0), b AS (SELECT x1, y1, x2, y2 FROM edges WHERE seg_id % 5 = 0),
  near AS (SELECT DISTINCT a.seg_id FROM a JOIN b ON b.x1 <= a.e AND b.x2 >= a.w AND {_seg_distance_sql('250e0')}) SELECT seg_id, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 2) AS meters FROM a WHERE seg_id NOT IN (SELECT seg_id FROM near) GROUP BY seg_id""")
def polylines_away_from_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-8: lines of which no edge comes within 250 m of a route, and their lengths."""
    lines = polylines(spark, sf_dir)
    away = shapes.lines_away_from(lines.filter("seg_id % 5 <> 0"), lines.filter("seg_id % 5 = 0"), 250.0, "seg_id")
    return shapes.line_lengths(away, "seg_id").select("seg_id", F.round("meters", 2).alias("meters"))


@query(f"""WITH {_LATTICE}, legs AS (SELECT id, x1, y1, x2, y2 FROM streets WHERE id % 4 <> 0 UNION ALL SELECT id, x1, y1, x1 + 120, y1 FROM streets WHERE id % 4 = 0 UNION ALL SELECT id, x1 + 180, y1, x2, y1 FROM streets WHERE id % 4 = 0),
  p AS (SELECT a.id AS a, b.id AS b, greatest(a.x1, b.x1) AS w, least(a.x2, b.x2) AS e, greatest(a.y1, b.y1) AS s, least(a.y2, b.y2) AS n FROM legs a JOIN legs b ON a.id < b.id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2)
  SELECT DISTINCT a, b, round((w + e) / 2, 3) AS x, round((s + n) / 2, 3) AS y, CASE WHEN w < e OR s < n THEN 'overlap' ELSE 'point' END AS kind, round(e - w + n - s, 3) AS meters FROM p""")
def polyline_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-9: crossings of lines with many vertices, and the middles of the stretches that they share across these; every other horizontal line has a gap."""
    k = F.col("id")
    s = _streets(spark, sf_dir).withColumns({"dx": F.when(k % 2 == 0, 1.0).otherwise(0.0), "dy": F.when(k % 2 == 0, 0.0).otherwise(1.0)})

    def leg(start: int, end: int) -> Column:
        steps = F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"), 7 + k % 40)
        return F.transform(F.concat(steps, F.array(F.lit(end).cast("long"))), lambda m: F.struct((F.col("x1") + m * F.col("dx")).alias("x"), (F.col("y1") + m * F.col("dy")).alias("y")))

    lines = s.select("id", F.when(k % 4 == 0, F.array(leg(0, 120), leg(180, 300))).otherwise(F.array(leg(0, 300))).alias("parts"))
    out = shapes.line_meetings(lines, "id")
    return out.select("a", "b", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "kind", F.round("meters", 3).alias("meters"))
