"""Queries on files of features, line networks, corridors and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.functions.scalars import box, boxes_disjoint, chain_length, coordinate, degree_metres, distance, nearest_on_chain, ratio, utm16
from wardspark.operators import graph, ranking, shapes, spatial
from wardspark.plans.geo import _seg_distance_sql, located, nearest
from wardspark.plans.registry import query
from wardspark.plans.standins import CELL, NEAREST, POINTS, POLYLINES, SEGMENTS, boxed_lengths, points, polylines, segments, t, zones
from wardspark.sources import files, parts

# The box of valid places (south, west, north, east), and the classes and status of streets that count.
PLACES = (41.6, -88.0, 42.1, -87.5)
STREET_CLASSES, STREET_STATUS = ("2", "3", "4"), ("N",)
# Room around a box, metres.
PAD = 66.8


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '0' WHEN event_id % 10 = 1 THEN 'n/a' WHEN event_id % 10 = 2 THEN NULL ELSE CAST(41.64e0 + ((event_id * 104729) % 3800) / 1e4 AS VARCHAR) END AS lat, CASE WHEN event_id % 10 = 0 THEN '0' WHEN event_id % 10 = 3 THEN '-187.5' ELSE CAST(-87.85e0 + ((event_id * 7919) % 3300) / 1e4 AS VARCHAR) END AS lon FROM events)
  SELECT event_id, round(CAST(lat AS DOUBLE), 4) AS lat, round(CAST(lon AS DOUBLE), 4) AS lon FROM p WHERE TRY_CAST(lat AS DOUBLE) BETWEEN 41.6 AND 42.1 AND TRY_CAST(lon AS DOUBLE) BETWEEN -88.0 AND -87.5""")
def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6: rows whose coordinates parse and lie in the box; "0", text and nulls are no places."""
    k = F.col("event_id")
    lat = F.when(k % 10 == 0, "0").when(k % 10 == 1, "n/a").when(k % 10 == 2, F.lit(None)).otherwise((41.64 + ((k * 104729) % 3800) / 1e4).cast("string"))
    lon = F.when(k % 10 == 0, "0").when(k % 10 == 3, "-187.5").otherwise((-87.85 + ((k * 7919) % 3300) / 1e4).cast("string"))
    p = t(spark, sf_dir, "events").select("event_id", coordinate(lat, lon, PLACES).alias("p")).filter("p is not null")
    return p.select("event_id", F.round("p.lat", 4).alias("lat"), F.round("p.lon", 4).alias("lon"))


@query(f"""WITH {POINTS} SELECT event_id FROM points WHERE 41.64e0 + lat_i / 1e4 BETWEEN 41.7 AND 41.9 AND -87.85e0 + lon_i / 1e4 BETWEEN -87.8 AND -87.6""")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: points in a box given as south, west, north, east, its edges included."""
    south, west, north, east = 41.7, -87.8, 41.9, -87.6
    k = F.col("event_id")
    lon, lat = -87.85 + ((k * 7919) % 3300) / 1e4, 41.64 + ((k * 104729) % 3800) / 1e4
    return t(spark, sf_dir, "events").filter(lat.between(south, north) & lon.between(west, east)).select("event_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS dooring_i, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS weather, CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice END AS speed,
  CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN {'by': 'one', 'n': 7::BIGINT}::VARCHAR END AS rare FROM orders""")
def ragged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4: records that leave out what is null; no column is declared, the union of their keys is found, even a key of one record; not-a-number is null."""
    k, o = F.col("o_orderkey"), t(spark, sf_dir, "orders")
    speed = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    raw = F.struct(k.alias("id"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("dooring_i"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("weather"), speed.cast("double").alias("speed"), F.when(k == F.col("last"), F.struct(F.lit("one").alias("by"), F.lit(7).alias("n"))).alias("rare"))
    path = files.shared_path(spark)
    o.crossJoin(o.agg(F.max("o_orderkey").alias("last"))).select(F.replace(F.to_json(raw), F.lit('"NaN"'), F.lit("NaN")).alias("value")).write.text(path)  # one row
    rows = files.read_ragged(spark, path)
    return rows.withColumn("rare", F.when(F.col("rare").isNotNull(), F.concat(F.lit("{'by': "), "rare.by", F.lit(", 'n': "), F.col("rare.n"), F.lit("}"))))


def _street_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as FeatureCollections in order, in parts of bounded size, and read again: class, status and, but for some, a geometry."""
    k = F.col("seg_id")
    line = F.when(k % 9 != 0, F.struct(F.lit("LineString").alias("type"), F.transform(F.col("parts")[0], lambda p: F.array(p.x, p.y)).alias("coordinates")))
    held = F.struct(k.cast("string").alias("OBJECTID"), (k % 6).cast("string").alias("class"), F.when(k % 7 == 0, "C").otherwise("N").alias("status"), F.col("corridor").cast("string").alias("corridor"))
    feature = F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), held.alias("properties"))
    path = files.shared_path(spark)
    lines = polylines(spark, sf_dir).select("seg_id", F.col("corridor").alias("sheet"), F.to_json(feature).alias("feature"))
    parts.write_parts(lines, "sheet", ["seg_id"], F.col("feature"), path, '{"type":"FeatureCollection","features":[', ",", "]}")
    return files.read_features(spark, path, "struct<type: string, coordinates: array<array<double>>>")


@query(f"""WITH {POLYLINES}, s AS (SELECT CASE WHEN corridor % 7 = 0 THEN '' WHEN corridor % 7 <> 1 THEN 'Corridor ' || CAST(corridor AS VARCHAR) END AS street, seg_id, x, y FROM v)
  SELECT coalesce(nullif(street, ''), '(unnamed)') AS corridor, count(DISTINCT seg_id) AS n, round(min(y) - {PAD}, 3) AS low_y, round(min(x) - {PAD}, 3) AS low_x, round(max(y) + {PAD}, 3) AS high_y, round(max(x) + {PAD}, 3) AS high_x FROM s GROUP BY 1""")
def corridor_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-42: lines by street with a bucket for the unnamed (null or empty), and the union of the padded boxes of all their vertices and parts; a line's box is made in its row, so only four numbers travel."""
    k = F.col("corridor") % 7
    street = F.when(k == 0, "").when(k != 1, F.concat(F.lit("Corridor "), F.col("corridor")))
    lines = polylines(spark, sf_dir).select(F.coalesce(F.nullif(street, F.lit("")), F.lit("(unnamed)")).alias("corridor"), F.flatten("parts").alias("v"))
    end = lambda f, axis: f(F.transform("v", lambda p: p[axis]))
    each = lines.select("corridor", *[(end(f, axis) + pad).alias(f"{name}_{axis}") for name, f, pad in (("low", F.array_min, -PAD), ("high", F.array_max, PAD)) for axis in ("y", "x")])
    out = each.groupBy("corridor").agg(F.count(F.lit(1)).alias("n"), F.min("low_y").alias("low_y"), F.min("low_x").alias("low_x"), F.max("high_y").alias("high_y"), F.max("high_x").alias("high_x"))
    return out.select("corridor", "n", *[F.round(c, 3).alias(c) for c in ("low_y", "low_x", "high_y", "high_x")])


@query(f"WITH {SEGMENTS} SELECT CAST(seg_id AS VARCHAR) AS segment_id, CASE WHEN seg_id % 9 <> 0 THEN round(x1, 3) END AS first_x, CAST(CASE WHEN seg_id % 9 = 0 THEN 0 WHEN seg_id % 3 = 0 THEN (3 + seg_id % 48) // 2 ELSE 3 + seg_id % 48 END AS INTEGER) AS vertices FROM segments")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: a row for each feature of collections, its id under whichever name the file has for it; a feature may lack its geometry."""
    f = _street_file(spark, sf_dir)
    key = F.coalesce(files.property_named(F.col("properties"), "objectid", "objectid_1", "segment_id", "id"), F.col("place").cast("string"))
    return f.select(key.alias("segment_id"), F.round(F.col("geometry.coordinates")[0][0], 3).alias("first_x"), F.coalesce(F.size("geometry.coordinates"), F.lit(0)).alias("vertices"))


@query(f"""WITH {POLYLINES}, streets AS (SELECT * FROM edges WHERE part = 0 AND seg_id % 6 IN (2, 3, 4) AND seg_id % 7 <> 0 AND seg_id % 9 <> 0), z AS (SELECT CAST(range AS INTEGER) AS zone, ((range - 1) % 5) * 660 AS i, ((range - 1) // 5) * 380 AS j FROM range(1, 51)),
  boxes AS (SELECT zone AS region, 1 AS sign, i * 8.3e0 AS ax, (i + 660) * 8.3e0 AS bx, j * 11.132e0 AS ay, (j + 380) * 11.132e0 AS ty FROM z), {boxed_lengths('streets')},
  k AS (SELECT region AS zone, sum(meters) / 1e3 AS road_km, sum(CASE WHEN corridor % 5 = 1 THEN meters END) / 1e3 AS way_km FROM clipped GROUP BY region)
  SELECT z.zone, round(road_km, 3) AS road_km, round(way_km, 3) AS way_km, round(way_km * 100 / road_km, 2) AS pct FROM z LEFT JOIN k USING (zone)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13 FLT-7 FLT-12 JON-14: streets of the counted classes and status with a geometry, all their vertices clipped to polygons; the share with a way; no road means null, not zero."""
    p = lambda c: F.element_at("properties", c)
    grid = _street_file(spark, sf_dir).filter(p("class").isin(*STREET_CLASSES) & p("status").isin(*STREET_STATUS) & F.col("geometry").isNotNull())
    part = F.transform("geometry.coordinates", lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    lines = grid.select(p("OBJECTID").cast("long").alias("seg_id"), p("corridor").cast("int").alias("corridor"), F.array(part).alias("parts"))
    rings = zones(spark).select("zone", F.array("ring").alias("rings"))
    out = shapes.clipped_lengths(lines, rings, CELL / 2, "seg_id", "zone").join(lines.select("seg_id", "corridor"), "seg_id")
    k = out.groupBy("zone").agg((F.sum("meters") / 1000).alias("road"), (F.sum(F.when(F.col("corridor") % 5 == 1, F.col("meters"))) / 1000).alias("way"))
    z = zones(spark).select("zone").join(k, "zone", "left")
    return z.select("zone", F.round("road", 3).alias("road_km"), F.round("way", 3).alias("way_km"), F.round(ratio(F.col("way"), F.col("road"), 100), 2).alias("pct"))


@query(f"""WITH {SEGMENTS}, k AS (SELECT seg_id, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS meters, seg_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM segments b WHERE b.seg_id % 3 = 0 AND {_seg_distance_sql('250e0')}) AS kept FROM segments a WHERE seg_id % 3 <> 0)
  SELECT count(*) FILTER (kept) AS parts_kept, round(sum(meters) FILTER (NOT kept) * 100 / sum(meters), 2) AS dropped_pct FROM k""")
def dropped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-8: how many line parts stay away from all routes, and the share of length that goes."""
    s = segments(spark, sf_dir).drop("corridor")
    parts = s.filter("seg_id % 3 <> 0").withColumn("meters", distance(*(F.col(c) for c in spatial.LINE)))
    kept = spatial.lines_away_from(parts, s.filter("seg_id % 3 = 0"), 250.0, "seg_id").select("seg_id", F.lit(True).alias("kept"))
    j = parts.join(kept, "seg_id", "left")
    return j.agg(F.count("kept").alias("parts_kept"), F.round(F.sum(F.when(F.col("kept").isNull(), F.col("meters"))) * 100 / F.sum("meters"), 2).alias("dropped_pct"))


# Stand-in streets on a lattice of whole numbers: lines cross, touch and run along each other; tens of lines lie far from other tens.
_LATTICE = """lattice AS (SELECT s_suppkey AS id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 37) % 1000 ELSE (s_suppkey % 10) * 100 END AS DOUBLE) AS x1, CAST(CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 10) * 100 ELSE (s_suppkey * 53) % 1000 END + (s_suppkey // 100) * 5000 AS DOUBLE) AS y1 FROM supplier),
  streets AS (SELECT id, x1, y1, x1 + CASE WHEN id % 2 = 0 THEN 300e0 ELSE 0e0 END AS x2, y1 + CASE WHEN id % 2 = 0 THEN 0e0 ELSE 300e0 END AS y2 FROM lattice)"""


def _streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    even = k % 2 == 0
    x = F.when(even, (k * 37) % 1000).otherwise((k % 10) * 100).cast("double")
    y = (F.when(even, (k % 10) * 100).otherwise((k * 53) % 1000) + F.floor(k / 100) * 5000).cast("double")
    return t(spark, sf_dir, "supplier").select(k.alias("id"), x.alias("x1"), y.alias("y1"), (x + F.when(even, 300.0).otherwise(0.0)).alias("x2"), (y + F.when(even, 0.0).otherwise(300.0)).alias("y2"))


_MEETINGS = f"""{_LATTICE}, p AS (SELECT a.id AS a, b.id AS b, a.x1 AS ax, a.y1 AS ay, a.x2 AS bx, a.y2 AS "by", b.x1 AS cx, b.y1 AS cy, b.x2 AS dx, b.y2 AS dy FROM streets a JOIN streets b ON a.id < b.id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2),
  meetings AS (SELECT a, b, (greatest(ax, cx) + least(bx, dx)) / 2 AS x, (greatest(ay, cy) + least("by", dy)) / 2 AS y, CASE WHEN greatest(ax, cx) < least(bx, dx) OR greatest(ay, cy) < least("by", dy) THEN 'overlap' ELSE 'point' END AS kind FROM p)"""


@query(f"WITH {_MEETINGS} SELECT a, b, round(x, 3) AS x, round(y, 3) AS y, kind FROM meetings")
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-9: where two streets cross or touch, and the middle of the stretch that two share, found among those whose padded boxes share a cell."""
    out = spatial.line_crossings(_streets(spark, sf_dir), "id", pad=150.0)
    return out.select("a", "b", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "kind")


@query(f"""WITH {SEGMENTS}, b AS (SELECT seg_id, least(x1, x2) - 150 AS w, least(y1, y2) - 150 AS s, greatest(x1, x2) + 150 AS e, greatest(y1, y2) + 150 AS n FROM segments)
  SELECT b.seg_id, count(c.seg_id) AS near FROM b LEFT JOIN b c ON b.seg_id <> c.seg_id AND NOT (b.e < c.w OR c.e < b.w OR b.n < c.s OR c.n < b.s) GROUP BY b.seg_id""")
def boxes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-8: how many other padded boxes are not disjoint from the box of each line."""
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    b = segments(spark, sf_dir).select("seg_id", box(line, 150.0).alias("box")).select("seg_id", "box", "box.*")
    other = b.select(F.col("seg_id").alias("other"), F.col("box").alias("other_box"), "west", "south", "east", "north")
    pairs = spatial.boxes_overlapping(b, other, "seg_id", "other", 1000.0).filter("seg_id <> other")
    boxes = b.select("seg_id", "box")
    sure = pairs.join(boxes, "seg_id").join(boxes.select(F.col("seg_id").alias("other"), F.col("box").alias("other_box")), "other").filter(~boxes_disjoint(F.col("box"), F.col("other_box")))
    return boxes.select("seg_id").join(sure.groupBy("seg_id").agg(F.count(F.lit(1)).alias("near")), "seg_id", "left").fillna(0)


@query(f"""WITH {POINTS}, {SEGMENTS}, c AS (SELECT user_id, arg_min(x, event_id) AS px, arg_min(y, event_id) AS py FROM points GROUP BY 1), k AS (SELECT user_id, px, py, seg_id, x1, y1, x2, y2 FROM c JOIN segments ON seg_id = user_id % 50),
  m AS (SELECT *, (x1 + x2) / 2 AS mx, y1 + 400e0 AS my FROM k), l AS (SELECT user_id, px, py, x1 AS ax, y1 AS ay, mx AS bx, my AS "by" FROM m UNION ALL SELECT user_id, px, py, mx, my, x2, y2 FROM m),
  d AS (SELECT *, least(1e0, greatest(0e0, ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) AS u FROM l)
  SELECT user_id, round(min(sqrt(power(px - ax - u * (bx - ax), 2) + power(py - ay - u * ("by" - ay), 2))), 3) AS meters FROM d GROUP BY user_id""")
def nearest_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-9: how far each place is from the nearest point of a line of three vertices."""
    first = points(spark, sf_dir).groupBy("user_id").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line = F.array(at(F.col("x1"), F.col("y1")), at((F.col("x1") + F.col("x2")) / 2, F.col("y1") + 400.0), at(F.col("x2"), F.col("y2")))
    lines = segments(spark, sf_dir).select("seg_id", line.alias("line"))
    j = first.join(lines, F.col("user_id") % 50 == F.col("seg_id"))
    return j.select("user_id", F.round(nearest_on_chain(F.col("p.x"), F.col("p.y"), F.col("line")).meters, 3).alias("meters"))


_DEGREES = """d AS (SELECT s_suppkey AS id, -87.9e0 + ((s_suppkey * 4513) % 3200) / 1e4 AS lon, 41.6e0 + ((s_suppkey * 2917) % 3700) / 1e4 AS lat FROM supplier), v AS (SELECT id, lon AS a0, lat AS b0, lon + 0.01e0 AS a1, lat + 0.002e0 AS b1, lon + 0.013e0 AS a2, lat - 0.004e0 AS b2 FROM d)"""


@query(f"""WITH {_DEGREES} SELECT id, round(sqrt(power((a1 - a0) * cos(radians((b0 + b1) / 2)) * 111320e0, 2) + power((b1 - b0) * 111320e0, 2)) + sqrt(power((a2 - a1) * cos(radians((b1 + b2) / 2)) * 111320e0, 2) + power((b2 - b1) * 111320e0, 2)), 3) AS meters FROM v""")
def degree_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5: lengths of lines in degrees, a degree of longitude being shorter the farther north."""
    lines = _degree_lines(spark, sf_dir)
    return lines.select("id", F.round(chain_length(F.col("line"), lambda p, q: degree_metres(p.x, p.y, q.x, q.y)), 3).alias("meters"))


def _degree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = -87.9 + ((k * 4513) % 3200) / 1e4, 41.6 + ((k * 2917) % 3700) / 1e4
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return t(spark, sf_dir, "supplier").select(k.alias("id"), F.array(at(lon, lat), at(lon + 0.01, lat + 0.002), at(lon + 0.013, lat - 0.004)).alias("line"))


def _utm_lengths_sql() -> str:
    from wardspark.plans.records import _utm_sql

    e = [_utm_sql(f"a{i}", f"b{i}") for i in range(3)]
    legs = [f"sqrt(power({e[i][0]} - {e[i + 1][0]}, 2) + power({e[i][1]} - {e[i + 1][1]}, 2))" for i in range(2)]
    return f"WITH {_DEGREES} SELECT id, round({legs[0]} + {legs[1]}, 2) AS meters FROM v"


@query(_utm_lengths_sql())
def projected_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-6: lengths of lines of several vertices, each projected once."""
    def placed(p):
        east, north = utm16(p.x, p.y)
        return F.struct(east.alias("x"), north.alias("y"))

    flat = _degree_lines(spark, sf_dir).select("id", F.transform("line", placed).alias("line"))
    return flat.select("id", F.round(chain_length(F.col("line"), lambda p, q: distance(p.x, p.y, q.x, q.y)), 2).alias("meters"))


_STOPS = f"""WITH RECURSIVE {SEGMENTS}, l AS (SELECT a.seg_id AS a, b.seg_id AS b FROM segments a JOIN segments b ON sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)) <= 1500e0),
  r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a)"""


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stops = segments(spark, sf_dir).select(F.col("seg_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "corridor")
    return stops, graph.clusters(stops, spatial.chained_points(stops, 1500.0, "id"))


@query(f"{_STOPS} SELECT id, cluster FROM c")
def clustered_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-5: points within reach of each other, transitively; links between cells, not all pairs."""
    return _clusters(spark, sf_dir)[1]


@query(f"""{_STOPS}, n AS (SELECT cluster, round(avg(x1), 2) AS x, round(avg(y1), 2) AS y, array_to_string(list_sort(list_distinct(list(lpad(CAST(corridor AS VARCHAR), 2, '0')))), ',') AS lines FROM c JOIN segments ON id = seg_id GROUP BY cluster HAVING count(DISTINCT corridor) >= 2),
  u AS (SELECT 0 AS part, cluster AS place, x, y, lines FROM n UNION ALL SELECT 1, n_nationkey, n_nationkey * 100e0, n_nationkey * 50e0, '' FROM nation)
  SELECT 'node-' || lpad(CAST(row_number() OVER (ORDER BY part, place) AS VARCHAR), 3, '0') AS node, CASE part WHEN 0 THEN 'interchange' ELSE 'orientation' END AS kind, x, y, lines FROM u""")
def interchange_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3 SET-5: clusters on two lines or more at their centroid with the union of their lines, then the curated points, numbered through."""
    stops, c = _clusters(spark, sf_dir)
    lines = F.array_sort(F.collect_set(F.lpad(F.col("corridor").cast("string"), 2, "0")))
    n = stops.join(c, "id").groupBy("cluster").agg(F.round(F.avg("x"), 2).alias("x"), F.round(F.avg("y"), 2).alias("y"), lines.alias("lines")).filter(F.size("lines") >= 2)
    derived = n.select(F.lit(0).alias("part"), F.col("cluster").alias("place"), F.lit("interchange").alias("kind"), "x", "y", F.array_join("lines", ",").alias("lines"))
    k = F.col("n_nationkey")
    curated = t(spark, sf_dir, "nation").select(F.lit(1).alias("part"), k.cast("long").alias("place"), F.lit("orientation").alias("kind"), (k * 100.0).alias("x"), (k * 50.0).alias("y"), F.lit("").alias("lines"))
    numbered = ranking.numbered(derived.unionByName(curated), ["part", "place"], "n")
    return numbered.select(F.format_string("node-%03d", "n").alias("node"), "kind", "x", "y", "lines")


_CORRIDORS = f"""{POINTS}, {SEGMENTS}, {NEAREST}, n AS (SELECT seg_id, count(*) AS incidents FROM nearest GROUP BY seg_id),
  f AS (SELECT corridor, seg_id % 3 AS facility, count(*) AS k FROM segments GROUP BY ALL), fm AS (SELECT corridor, array_to_string(list('type_' || CAST(facility AS VARCHAR) || '=' || CAST(k AS VARCHAR) ORDER BY facility), ', ') AS facilities FROM f GROUP BY corridor),
  c AS (SELECT corridor, count(*) AS segments, sum(sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))) / 1e3 AS km, CAST(coalesce(sum(incidents), 0) AS BIGINT) AS incidents FROM segments LEFT JOIN n USING (seg_id) GROUP BY corridor),
  corridors AS (SELECT corridor, segments, round(km, 3) AS km, incidents, CASE WHEN km >= 0.2e0 THEN round(incidents / km, 3) END AS per_km, facilities FROM c JOIN fm USING (corridor))"""


def _corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nearest(spark, sf_dir).groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"))
    length = distance(*(F.col(c) for c in spatial.LINE)) / 1000
    each = segments(spark, sf_dir).withColumn("len", length).join(n, "seg_id", "left").groupBy("corridor", F.concat(F.lit("type_"), F.col("seg_id") % 3).alias("facility"))
    typed = each.agg(F.count(F.lit(1)).alias("k"), F.sum("len").alias("km"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rolled = typed.groupBy("corridor").agg(F.sum("k").alias("segments"), F.sum("km").alias("km"), F.sum("n").alias("incidents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("facility", "k")))).alias("facilities"))
    return rolled.withColumn("per_km", F.when(F.col("km") >= 0.2, F.round(F.col("incidents") / F.col("km"), 3))).withColumn("km", F.round("km", 3))


@query(f"WITH {_CORRIDORS} SELECT * FROM corridors")
def corridor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3 JON-12 ORD-3: corridors with length, incidents, a map of facilities and a rate that is null under 0.2 km; a null rate sorts as 0."""
    told = F.array_join(F.transform(F.map_entries("facilities"), lambda e: F.concat(e.key, F.lit("="), e.value)), ", ")
    return _corridors(spark, sf_dir).withColumn("facilities", told).orderBy(F.coalesce("per_km", F.lit(0.0)).desc(), "corridor")


@query(f"WITH {_CORRIDORS} SELECT corridor, per_km FROM corridors WHERE coalesce(per_km, 0) > 0 ORDER BY per_km DESC, corridor LIMIT 5")
def top_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-3: the five corridors of the highest rate among those that have one."""
    return _corridors(spark, sf_dir).filter("per_km > 0").orderBy(F.col("per_km").desc(), "corridor").limit(5).select("corridor", "per_km")


_ZONE_BOX = "zb AS (SELECT CAST(range AS INTEGER) AS zone, ((range - 1) % 5) * 660 * 8.3e0 AS zx, ((range - 1) // 5) * 380 * 11.132e0 AS zy, ((range - 1) % 5 + 1) * 660 * 8.3e0 AS ze, ((range - 1) // 5 + 1) * 380 * 11.132e0 AS zn FROM range(1, 51))"


@query(f"""WITH {POINTS}, {SEGMENTS}, {NEAREST}, n AS (SELECT seg_id, count(*) AS incidents FROM nearest GROUP BY seg_id), {_ZONE_BOX},
  c AS (SELECT zone, corridor, CAST(coalesce(sum(incidents), 0) AS BIGINT) AS incidents, sum(sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))) AS meters FROM zb JOIN segments ON x1 <= ze AND x2 >= zx AND y1 <= zn AND y2 >= zy LEFT JOIN n USING (seg_id) GROUP BY zone, corridor),
  r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY incidents DESC, corridor) AS place FROM c) SELECT zone, corridor, incidents, round(meters + 0.001234567e0, 2) AS meters, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def corridors_near_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-27: of the corridors with a segment whose box meets the zone's box the three of most incidents on such segments; lengths are shifted off rounding ties."""
    n = nearest(spark, sf_dir).groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"))
    s = segments(spark, sf_dir).join(n, "seg_id", "left").withColumns({"west": F.least("x1", "x2"), "east": F.greatest("x1", "x2"), "south": F.least("y1", "y2"), "north": F.greatest("y1", "y2")})
    z = zones(spark).select("zone", box(F.col("ring")).alias("b")).select("zone", "b.*")
    pairs = spatial.boxes_overlapping(z, s, "zone", "seg_id", CELL).join(s.select("seg_id", "corridor", "n", distance(*(F.col(c) for c in spatial.LINE)).alias("m")), "seg_id")
    c = pairs.groupBy("zone", "corridor").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"), F.round(F.sum("m") + 0.001234567, 2).alias("meters"))
    return ranking.top_k(c, ["zone"], [F.col("incidents").desc(), "corridor"], 3).withColumnRenamed("rank", "place")


@query(f"""WITH {POINTS}, {SEGMENTS}, b AS (SELECT corridor, min(x1) AS ax, max(x2) AS bx, min(y1) AS ay, max(y2) AS ty FROM segments GROUP BY corridor), g AS (SELECT CAST(round_even(x / 1e3, 0) AS BIGINT) AS cx, CAST(round_even(y / 1e3, 0) AS BIGINT) AS cy, count(*) AS incidents, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1, 2 HAVING count(*) >= 2),
  h AS (SELECT * FROM g ORDER BY incidents DESC, cx, cy LIMIT 25) SELECT corridor, cx, cy, incidents FROM b JOIN h ON x BETWEEN ax AND bx AND y BETWEEN ay AND ty""")
def hotspots_in_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-28: the hotspots inside the box of each corridor."""
    p = points(spark, sf_dir).groupBy(F.rint(F.col("x") / 1000).cast("long").alias("cx"), F.rint(F.col("y") / 1000).cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("incidents"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    hot = p.filter("incidents >= 2").orderBy(F.col("incidents").desc(), "cx", "cy").limit(25)
    spot = hot.select(F.struct("cx", "cy", "incidents").alias("spot"), F.col("x").alias("west"), F.col("x").alias("east"), F.col("y").alias("south"), F.col("y").alias("north"))
    b = segments(spark, sf_dir).groupBy("corridor").agg(F.min("x1").alias("west"), F.max("x2").alias("east"), F.min("y1").alias("south"), F.max("y2").alias("north"))
    return spatial.boxes_overlapping(b, spot, "corridor", "spot", 5000.0).select("corridor", "spot.*")


@query(f"""WITH {POINTS}, {SEGMENTS}, {NEAREST}, a AS (SELECT count(*) AS incidents, round(avg(CASE WHEN seg_id IS NULL THEN 1e0 ELSE 0e0 END), 4) AS off_network, round(avg(CASE WHEN zone IS NULL THEN 1e0 ELSE 0e0 END), 4) AS no_zone FROM points LEFT JOIN nearest USING (event_id)),
  w AS (SELECT zone, count(*) AS n FROM points GROUP BY zone ORDER BY n DESC, zone LIMIT 5) SELECT a.*, (SELECT array_to_string(list(CAST(zone AS VARCHAR) || '=' || CAST(n AS VARCHAR) ORDER BY n DESC, zone), ', ') FROM w) AS top_zones FROM a""")
def join_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-39: shares of rows that a spatial join left unmatched, and the five zones of most rows."""
    j = located(spark, sf_dir).select("event_id", "zone").join(nearest(spark, sf_dir), "event_id", "left")
    by = j.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seg_id").isNull()).alias("off"))
    total = by.agg(F.sum("n").alias("incidents"), F.round(F.sum("off") / F.sum("n"), 4).alias("off_network"), F.round(F.coalesce(F.sum(F.when(F.col("zone").isNull(), F.col("n"))), F.lit(0)) / F.sum("n"), 4).alias("no_zone"))
    top = by.filter("zone is not null").orderBy(F.col("n").desc(), "zone").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "zone"))).alias("t"))
    told = F.array_join(F.transform("t", lambda x: F.concat(x.zone.cast("string"), F.lit("="), (-x.m).cast("string"))), ", ")
    return total.crossJoin(F.broadcast(top.select(told.alias("top_zones"))))  # one row


@query(f"""WITH {POINTS}, {SEGMENTS}, {NEAREST} SELECT p.event_id, zone, severity, CASE WHEN seg_id IS NULL THEN 'off_network' ELSE 'category_' || (corridor % 5) END AS facility, p.event_id % 9 = 0 AS dooring
  FROM points p LEFT JOIN nearest USING (event_id) LEFT JOIN segments USING (seg_id) WHERE severity IN ('fatal', 'incapacitating') AND zone BETWEEN 5 AND 45 AND event_type <> 'view' AND (seg_id IS NULL OR corridor % 5 = 2) AND p.event_id % 9 = 0 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'""")
def filtered_incidents_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-8: zone, severity, type, facility or off-network, dooring and dates at once."""
    p = located(spark, sf_dir).withColumn("dooring", F.col("event_id") % 9 == 0)
    p = p.filter(F.col("dooring") & F.col("severity").isin("fatal", "incapacitating") & F.col("zone").between(5, 45) & (F.col("event_type") != "view") & (F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-25"))
    seg = nearest(spark, sf_dir).join(segments(spark, sf_dir).select("seg_id", "corridor"), "seg_id").select("event_id", F.concat(F.lit("category_"), F.col("corridor") % 5).alias("facility"))
    j = p.join(seg, "event_id", "left").withColumn("facility", F.coalesce("facility", F.lit("off_network")))
    return j.filter(F.col("facility").isin("category_2", "off_network")).select("event_id", "zone", "severity", "facility", "dooring")


@query(f"""WITH {POINTS}, {SEGMENTS}, {NEAREST}, z AS (SELECT DISTINCT zone FROM points), f AS (SELECT DISTINCT 'category_' || CAST(corridor % 5 AS VARCHAR) AS value FROM nearest JOIN segments USING (seg_id) UNION SELECT 'off_network')
  SELECT 'zone' AS filter, CAST(zone AS VARCHAR) AS value, CAST(row_number() OVER (ORDER BY zone) AS INTEGER) AS place FROM z UNION ALL SELECT 'facility', value, CAST(row_number() OVER (ORDER BY value = 'off_network', value) AS INTEGER) FROM f""")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-40: the distinct values that a filter offers, numbers in numeric order, off-network last."""
    z = located(spark, sf_dir).select(F.lit("zone").alias("filter"), F.col("zone").cast("string").alias("value")).filter("value is not null").distinct()
    seg = nearest(spark, sf_dir).select("seg_id").distinct().join(segments(spark, sf_dir), "seg_id")
    f = seg.select(F.lit("facility").alias("filter"), F.concat(F.lit("category_"), F.col("corridor") % 5).alias("value")).distinct()
    off = spark.range(1).select(F.lit("facility").alias("filter"), F.lit("off_network").alias("value"))
    order = [F.col("value") == "off_network", F.col("value").try_cast("int"), F.col("value")]
    return z.union(f).union(off).withColumn("place", F.row_number().over(Window.partitionBy("filter").orderBy(*order)))


@query(f"""WITH {_CORRIDORS}, a AS (SELECT CAST(max(ts) AS DATE) AS anchor, count(*) FILTER (event_id % 9 = 0) AS doorings, count(*) AS total, count(*) FILTER (event_id % 4 = 0) AS fled FROM points),
  k AS (SELECT count(*) FILTER (severity IN ('fatal', 'incapacitating') AND CAST(ts AS DATE) > anchor - 7) AS recent, count(*) FILTER (severity IN ('fatal', 'incapacitating') AND CAST(ts AS DATE) > anchor - 14 AND CAST(ts AS DATE) <= anchor - 7) AS prior FROM points, a),
  top AS (SELECT corridor, per_km FROM corridors WHERE per_km > 0 ORDER BY per_km DESC, corridor LIMIT 1), w AS (SELECT zone, count(*) AS n FROM points GROUP BY zone ORDER BY n DESC, zone LIMIT 5)
  SELECT 1 AS place, 'ksi-trend' AS finding, CAST(recent AS VARCHAR) AS stat, 'Counted over the days to ' || CAST(anchor AS VARCHAR) || ' (' || CAST(recent AS VARCHAR) || ' incidents), against ' || CAST(prior AS VARCHAR) || ' before.' AS caveat FROM k, a WHERE anchor IS NOT NULL
  UNION ALL SELECT 2, 'top-corridors', CAST(corridor AS VARCHAR), 'Incidents by kilometre through ' || CAST(anchor AS VARCHAR) || '.' FROM top, a
  UNION ALL SELECT 3, 'hit-and-run', CAST(CAST(round(fled * 100e0 / total) AS BIGINT) AS VARCHAR) || '%', 'Share of reports through ' || CAST(anchor AS VARCHAR) || '.' FROM a WHERE total > 0
  UNION ALL SELECT 4, 'zone-concentration', CAST(CAST(round((SELECT sum(n) FROM w) * 100e0 / total) AS BIGINT) AS VARCHAR) || '%', 'Five zones of most incidents through ' || CAST(anchor AS VARCHAR) || '.' FROM a WHERE total > 0
  UNION ALL SELECT 6, 'dooring-undercount', CAST(doorings AS VARCHAR) || '+', 'Incidents that carry the flag (' || CAST(doorings AS VARCHAR) || ' incidents), a floor.' FROM a""")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-38: one row for each finding in a fixed order, left out where its input is missing (place 5, roads, has no source here)."""
    p = located(spark, sf_dir)
    day, ksi = F.to_date("ts"), F.col("severity").isin("fatal", "incapacitating")
    a = p.agg(F.max(day).alias("anchor"), F.count_if(F.col("event_id") % 9 == 0).alias("doorings"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_id") % 4 == 0).alias("fled"))
    dated = p.crossJoin(F.broadcast(a.select("anchor")))  # one row
    k = dated.agg(F.count_if(ksi & (day > F.date_sub("anchor", 7))).alias("recent"), F.count_if(ksi & (day > F.date_sub("anchor", 14)) & (day <= F.date_sub("anchor", 7))).alias("prior"))
    top = _corridors(spark, sf_dir).filter("per_km > 0").orderBy(F.col("per_km").desc(), "corridor").limit(1).select("corridor")
    five = p.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "zone").limit(5).agg(F.sum("n").alias("five"))
    roads = spark.range(0).select(F.lit(None).cast("double").alias("pct"))  # no source of roads here
    one = lambda *d: a if not d else a.crossJoin(F.broadcast(d[0]))  # one row each

    def told(df: DataFrame, place: int, name: str, stat, caveat) -> DataFrame:
        return df.select(F.lit(place).alias("place"), F.lit(name).alias("finding"), stat.alias("stat"), caveat.alias("caveat"))

    share = lambda n: F.concat(F.round(F.col(n) * 100.0 / F.col("total")).cast("long").cast("string"), F.lit("%"))
    until = lambda s: F.concat(F.lit(s + " through "), F.col("anchor").cast("string"), F.lit("."))
    rows = [
        told(one(k).filter("anchor is not null"), 1, "ksi-trend", F.col("recent").cast("string"), F.concat(F.lit("Counted over the days to "), "anchor", F.lit(" ("), "recent", F.lit(" incidents), against "), "prior", F.lit(" before."))),
        told(one(top), 2, "top-corridors", F.col("corridor").cast("string"), until("Incidents by kilometre")),
        told(one().filter("total > 0"), 3, "hit-and-run", share("fled"), until("Share of reports")),
        told(one(five).filter("total > 0"), 4, "zone-concentration", share("five"), until("Five zones of most incidents")),
        told(one(roads), 5, "street-coverage", F.col("pct").cast("string"), until("Share of streets")),
        told(one(), 6, "dooring-undercount", F.concat(F.col("doorings").cast("string"), F.lit("+")), F.concat(F.lit("Incidents that carry the flag ("), "doorings", F.lit(" incidents), a floor."))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("place")
