"""Lines of any number of vertices and parts, and polygons with parts and holes, as tables of edges.

A line is an array of parts, a polygon an array of rings (outer ones, holes and
further parts alike: inside is where a ray crosses an odd number of edges); a part or
ring is an array of points (x, y) in metres.  Every operator works on edges, so no
row grows with a whole shape, and folds them back by the line's id.

Defined results: a null shape, part or point, and a part of one point, have no
edge; a ring may repeat its first point at its end or not; edges of no length
count for nothing; repeated lines are one line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.functions.scalars import distance
from wardspark.operators import spatial
from wardspark.sources.files import kept

EDGE = spatial.LINE
#: Stretches whose ends are this near are one (metres).
TOUCH = 1e-6


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def _sides(points: Column, closed: bool) -> Column:
    """The edges of one array of points."""
    known = F.filter(points, lambda p: p.x.isNotNull() & p.y.isNotNull())
    n = F.size(known)
    start = known if closed else F.slice(known, F.lit(1), F.greatest(n - 1, F.lit(0)))
    each = F.transform(start, lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get(known, (i + 1) % n).x.alias("x2"), F.get(known, (i + 1) % n).y.alias("y2")))
    return F.filter(each, lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))


def _exploded(shapes: DataFrame, column: str, closed: bool) -> DataFrame:
    kept = [c for c in shapes.columns if c != column]
    parts = shapes.select(*kept, F.posexplode(F.filter(column, lambda p: p.isNotNull())).alias("part", "_points"))
    return parts.select(*kept, "part", F.posexplode(_sides(F.col("_points"), closed)).alias("edge", "_e")).select(*kept, "part", "edge", "_e.*")


def line_edges(lines: DataFrame, column: str = "parts") -> DataFrame:
    """The other columns of lines with part, edge, x1, y1, x2, y2: a row for each edge."""
    return _exploded(lines, column, False)


def ring_edges(polygons: DataFrame, column: str = "rings") -> DataFrame:
    """As line_edges; each ring is closed."""
    return _exploded(polygons, column, True)


def line_lengths(lines: DataFrame, line_id: str, column: str = "parts") -> DataFrame:
    """(line_id, meters) of all lines, 0 for one without an edge."""
    edges = line_edges(lines.select(line_id, column).dropDuplicates([line_id]), column)
    total = edges.groupBy(line_id).agg(F.sum(distance(*(F.col(c) for c in EDGE))).alias("meters"))
    return lines.select(line_id).distinct().join(total, line_id, "left").fillna(0.0, ["meters"])


def cell_index(polygons: DataFrame, polygon_id: str, size: float, column: str = "rings") -> DataFrame:
    """(polygon_id, cx, cy, corner, edges): the cells that meet each polygon.

    ``edges`` are the polygon's edges that touch the cell; a cell that none touches
    lies inside as a whole and has an empty array, so its points need no test.
    ``corner`` tells whether the cell's low corner is inside; it comes from the
    crossings of the cell row's lower border, sorted along the row: the corners between
    an odd crossing and the next are inside.  A row of the index grows with the edges
    of one cell, and the spans of a row with the crossings of one line, never with
    the polygon.
    """
    edges = ring_edges(polygons.select(polygon_id, column), column).select(polygon_id, *EDGE)
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    rowed = edges.withColumn("cy", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    south, north = F.col("cy") * size, (F.col("cy") + 1) * size
    # Where the edge runs inside the row, a little wider than it is, so that rounding loses no cell.
    at = lambda y: F.when(y1 == y2, x1).otherwise(x1 + (F.greatest(low, F.least(high, y)) - y1) / (y2 - y1) * (x2 - x1))
    ends = [F.when(y1 == y2, x1).otherwise(at(south)), F.when(y1 == y2, x2).otherwise(at(north))]
    pad = size * 1e-9
    touched = rowed.withColumn("cx", F.explode(F.sequence(_cell(F.least(*ends) - pad, size), _cell(F.greatest(*ends) + pad, size))))
    border = touched.select(polygon_id, "cx", "cy", F.struct(*EDGE).alias("edge"), F.lit(False).alias("corner"))

    crossing = rowed.filter((y1 > south) != (y2 > south)).select(polygon_id, "cy", (x1 + (south - y1) / (y2 - y1) * (x2 - x1)).alias("x"))
    along = Window.partitionBy(polygon_id, "cy").orderBy("x")
    spans = crossing.select(polygon_id, "cy", "x", F.lead("x").over(along).alias("until"), F.row_number().over(along).alias("n")).filter("n % 2 = 1")
    first, last = F.ceil(F.col("x") / size).cast("int"), (F.ceil(F.col("until") / size) - 1).cast("int")
    inside = spans.filter(first <= last).withColumn("cx", F.explode(F.sequence(first, last)))
    corners = inside.select(polygon_id, "cx", "cy", F.lit(None).cast(border.schema["edge"].dataType).alias("edge"), F.lit(True).alias("corner"))
    return border.union(corners).groupBy(polygon_id, "cx", "cy").agg(F.max("corner").alias("corner"), F.collect_list("edge").alias("edges"))


def _inside(x: Column, y: Column, west: Column, south: Column, corner: Column, edges: Column) -> Column:
    """From the cell's low corner up to the point's height, then along to the point: every edge crossed turns inside to outside."""

    def turns(e: Column) -> Column:
        upright = ((e.x1 > west) != (e.x2 > west)) & (e.y1 + (west - e.x1) / (e.x2 - e.x1) * (e.y2 - e.y1)).between(south, y) & (e.y1 + (west - e.x1) / (e.x2 - e.x1) * (e.y2 - e.y1) > south)
        at = e.x1 + (y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)
        level = ((e.y1 > y) != (e.y2 > y)) & (at > west) & (at <= x)
        return upright.cast("int") + level.cast("int")

    crossed = F.aggregate(edges, F.lit(0), lambda n, e: n + F.coalesce(turns(e), F.lit(0)))
    return F.when(F.size(edges) == 0, corner).otherwise((crossed + corner.cast("int")) % 2 == 1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, polygon_id: str, size: float, how: str = "left", column: str = "rings") -> DataFrame:
    """points (any columns and x, y) with the id of every polygon that holds them; borders are half-open, to the west and south inside.

    A point meets the index of its own cell only, and a test only where an edge
    of the polygon touches that cell.
    """
    index = cell_index(polygons, polygon_id, size, column)
    x, y = F.col("x"), F.col("y")
    held = _inside(x, y, F.col("cx") * size, F.col("cy") * size, F.col("corner"), F.col("edges"))
    keyed = points.withColumns({"_px": _cell(x, size), "_py": _cell(y, size), "_pp": F.lit(0)})
    index = index.withColumn("_part", F.lit(0))
    crowded = spatial.crowded_cells(points.select("x", "y"), size).filter("level = 0").select("cx", "cy", F.ceil(F.col("n") / spatial.CROWD).cast("int").alias("_parts"))
    if not crowded.isEmpty():
        # A crowded cell's points are dealt into parts, and its few polygons go to each.
        index = index.join(F.broadcast(crowded), ["cx", "cy"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        dealt = crowded.withColumnsRenamed({"cx": "_px", "cy": "_py"})
        keyed = keyed.join(F.broadcast(dealt), ["_px", "_py"], "left").withColumn("_pp", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return keyed.join(index, (F.col("_px") == F.col("cx")) & (F.col("_py") == F.col("cy")) & (F.col("_pp") == F.col("_part")) & held, how).drop("_px", "_py", "_pp", "cx", "cy", "_part", "corner", "edges")


def nearest_line(points: DataFrame, lines: DataFrame, reach: float, point_id: str, line_id: str, column: str = "parts") -> DataFrame:
    """(point_id, line_id, meters): the nearest line within reach, inclusive; the least id on ties; only matched points."""
    return spatial.nearest_line(points, line_edges(lines.select(line_id, column), column), reach, point_id, line_id)


def clipped_lengths(lines: DataFrame, polygons: DataFrame, size: float, line_id: str, polygon_id: str, line_column: str = "parts", polygon_column: str = "rings") -> DataFrame:
    """(line_id, polygon_id, meters) of the part of every line inside every polygon, where it is positive.

    Each edge is cut where polygon edges of its cells cross it; no polygon's border
    then runs through a piece, so its middle tells where it lies.
    """
    edges = line_edges(lines.select(line_id, line_column).dropDuplicates([line_id]), line_column).select(line_id, "part", "edge", *EDGE)
    borders = ring_edges(polygons.select(polygon_column), polygon_column).select(*EDGE)
    pairs = spatial._line_pairs(edges, borders, 0.0, size)
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    ex, ey = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    gx, gy = F.col("b_x1") - x1, F.col("b_y1") - y1
    det = F.nullif((x2 - x1) * ey - (y2 - y1) * ex, F.lit(0.0))
    t, s = (gx * ey - gy * ex) / det, (gx * (y2 - y1) - gy * (x2 - x1)) / det
    met = pairs.select(line_id, "part", "edge", F.when((t > 0) & (t < 1) & (s >= 0) & (s <= 1), t).alias("t"))
    # An edge along a border has no crossing with it, but the border's ends cut it.
    long = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    flat = (det.isNull()) & (gx * (y2 - y1) - gy * (x2 - x1) == 0)
    along = pairs.filter(flat).select(line_id, "part", "edge", F.explode(F.array((gx * (x2 - x1) + gy * (y2 - y1)) / long, ((gx + ex) * (x2 - x1) + (gy + ey) * (y2 - y1)) / long)).alias("t")).filter("t > 0 and t < 1")
    cuts = met.filter("t is not null").union(along).groupBy(line_id, "part", "edge").agg(F.collect_set("t").alias("cuts"))
    cut_edges = edges.join(cuts, [line_id, "part", "edge"], "left")
    ts = F.array_sort(F.array_union(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("cuts", F.array().cast("array<double>"))))
    pieces = cut_edges.withColumn("_t", ts).withColumn("_p", F.explode(F.zip_with(F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    middle = (F.col("_p.a") + F.col("_p.b")) / 2
    placed = pieces.select(line_id, (x1 + middle * (x2 - x1)).alias("x"), (y1 + middle * (y2 - y1)).alias("y"), ((F.col("_p.b") - F.col("_p.a")) * distance(x1, y1, x2, y2)).alias("meters"))
    held = points_in_polygons(placed, polygons.select(polygon_id, polygon_column), polygon_id, size, "inner", polygon_column)
    return held.groupBy(line_id, polygon_id).agg(F.sum("meters").alias("meters")).filter("meters > 0")


def lines_away_from(lines: DataFrame, routes: DataFrame, reach: float, line_id: str, line_column: str = "parts", route_column: str = "parts") -> DataFrame:
    """Lines of which no edge is within reach of a route (a buffer anti join)."""
    near = spatial.lines_near(line_edges(lines.select(line_id, line_column), line_column), line_edges(routes.select(route_column), route_column), reach, line_id)
    return lines.join(near, line_id, "left_anti")


def _chained(lines: DataFrame, line_id: str, column: str) -> DataFrame:
    """Edges with ``at``, the way along their part where they begin, and their length."""
    edges = line_edges(lines.select(line_id, column).dropDuplicates([line_id]), column).withColumn("long", distance(*(F.col(c) for c in EDGE)))
    along = Window.partitionBy(line_id, "part").orderBy("edge")
    return edges.withColumn("at", F.sum("long").over(along) - F.col("long"))


def cell_for(edges: DataFrame) -> float:
    """The root of the mean square of the edges' extents.  In cells of this size the boxes of n edges cover 4 n cells at most, whatever their lengths."""
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    mean = edges.agg(F.avg((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))).first()[0]
    return math.sqrt(mean) if mean else 1.0


def line_meetings(lines: DataFrame, line_id: str, size: float | None = None, column: str = "parts") -> DataFrame:
    """(a, b, x, y, kind, meters): where two lines cross or touch (point), and the middle of each stretch that they share (overlap), a < b.

    A stretch may run across vertices of both lines: what pairs of edges share is
    put together by the way along the lesser line, and the points at its ends
    and vertices belong to it.  Cells are as large as edges are, unless size is given.
    """
    edges = kept(_chained(lines, line_id, column))
    size = size or cell_for(edges)
    pairs = spatial._line_pairs(edges, edges.select(line_id, *EDGE), 0.0, size).filter(F.col(line_id) < F.col(f"b_{line_id}"))
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    dx, dy, ex, ey = x2 - x1, y2 - y1, F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    gx, gy = F.col("b_x1") - x1, F.col("b_y1") - y1
    det, off, long = dx * ey - dy * ex, gx * dy - gy * dx, dx * dx + dy * dy
    t, u = (gx * ey - gy * ex) / F.nullif(det, F.lit(0.0)), off / F.nullif(det, F.lit(0.0))
    first, last = (gx * dx + gy * dy) / long, ((gx + ex) * dx + (gy + ey) * dy) / long
    low, high = F.greatest(F.lit(0.0), F.least(first, last)), F.least(F.lit(1.0), F.greatest(first, last))
    crossing = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    beside = (det == 0) & (off == 0) & (low <= high)
    span = F.when(crossing, F.struct(t.alias("low"), t.alias("high"))).when(beside, F.struct(low.alias("low"), high.alias("high")))
    met = pairs.withColumn("_s", span).filter("_s is not null").select(
        F.col(line_id).alias("a"), F.col(f"b_{line_id}").alias("b"), "part", "at", "long", *EDGE,
        (F.col("at") + F.col("_s.low") * F.col("long")).alias("low"), (F.col("at") + F.col("_s.high") * F.col("long")).alias("high"), ((F.col("_s.high") - F.col("_s.low")) * F.col("long") > TOUCH).alias("runs"),
    ).distinct()
    order = Window.partitionBy("a", "b", "part").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(F.col("low") > reached + TOUCH, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = met.withColumn("stretch", stretch)
    spot = F.struct("low", "high", "at", "long", *EDGE)
    whole = held.groupBy("a", "b", "part", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("runs").alias("runs"), F.collect_list(spot).alias("spots"))
    middle = whole.withColumn("_m", (F.col("low") + F.col("high")) / 2)
    on = middle.withColumn("_e", F.get(F.filter("spots", lambda e: (e.low <= F.col("_m") + TOUCH) & (F.col("_m") <= e.high + TOUCH)), F.lit(0)))
    share = (F.col("_m") - F.col("_e.at")) / F.col("_e.long")
    placed = on.select("a", "b", (F.col("_e.x1") + share * (F.col("_e.x2") - F.col("_e.x1"))).alias("x"), (F.col("_e.y1") + share * (F.col("_e.y2") - F.col("_e.y1"))).alias("y"), F.when(F.col("runs"), "overlap").otherwise("point").alias("kind"), F.when(F.col("runs"), F.col("high") - F.col("low")).otherwise(0.0).alias("meters"))
    # Parts of one line may touch at a point where the other crosses: one meeting.
    near = {c: F.round(c, 6) for c in ("x", "y")}
    return placed.groupBy("a", "b", near["x"].alias("_x"), near["y"].alias("_y")).agg(F.max(F.struct("meters", "kind", "x", "y")).alias("m")).select("a", "b", "m.x", "m.y", "m.kind", "m.meters")
