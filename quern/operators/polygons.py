"""Polygons as edges dealt over grid cells.

A polygon is rows, one a corner or an edge, never an array, so that a coast
line of any length is spread over tasks. Each edge is cut at the lines of a
grid, and everything is decided within a cell: whether it holds a point, by
the parity of the cell's corner and the cell's own edges between corner and
point; which polygons meet, by edges and corners that share a cell; what area
of a cell a polygon covers, by the trapezoids under the cell's own pieces and
the heights of the pieces to its west. Sums along a row of cells carry parity
and height over cells that no edge enters, and holes and parts come out by
even and odd.

Points are moved off edges in thought, a little to the east and much less to
the north, which makes each comparison below strict on one side: no corner,
edge or grid line can fall on another.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import settle

ENDS = ["x1", "y1", "x2", "y2"]
#: Edges reach into cells that they pass at this share of a cell's width, so that rounding leaves none out.
RIM = 1e-9
#: Areas up to this share of a cell are rounding.
SPECK = 1e-12


def ring_corners(polygons: DataFrame) -> DataFrame:
    """(code, ring, k, x, y) of polygons whose ``rings`` are arrays of arrays of (x, y)."""
    rings = polygons.select("code", F.posexplode("rings").alias("ring", "_corners"))
    return rings.select("code", "ring", F.posexplode("_corners").alias("k", "_p")).select("code", "ring", "k", "_p.x", "_p.y")


def support_hulls(points: DataFrame, directions: int, hole: float) -> DataFrame:
    """(code, ring, k, x, y): the points of each code of ``points(code, x, y)`` that lie farthest in so many directions, anticlockwise, and the same ring ``hole`` times as large as a hole in it.

    The corners are those of the convex hull that these directions see; the
    hole lies about the middle of two opposite ones. Found by one aggregate,
    whatever a code's number of points.
    """
    turns = [2 * math.pi * k / directions for k in range(directions)]
    found = points.groupBy("code").agg(*[F.expr(f"max(struct(x * {math.cos(t)!r}D + y * {math.sin(t)!r}D AS d, x, y)) AS p{k}") for k, t in enumerate(turns)])
    mid = lambda c: f"(p0.{c} + p{directions // 2}.{c}) / 2"
    inner = lambda k, c: f"{mid(c)} + {hole!r}D * (p{k}.{c} - {mid(c)}) AS {c}"
    outer_ring = [f"struct(0 AS ring, {k} AS k, p{k}.x AS x, p{k}.y AS y)" for k in range(directions)]
    hole_ring = [f"struct(1 AS ring, {k} AS k, {inner(k, 'x')}, {inner(k, 'y')})" for k in range(directions)]
    return found.selectExpr("code", f"inline(array({', '.join([*outer_ring, *hole_ring])}))")


def polygon_edges(corners: DataFrame, wrap: bool = True, oriented: bool = False) -> DataFrame:
    """(code, ring, x1, y1, x2, y2) of ``corners(code, ring, k, x, y)`` in the order of k; ring 0 is the outer one of its code.

    Edges of no length are left out; a ring that is left open is closed. Outer
    rings are turned anticlockwise, others clockwise, unless they are
    ``oriented`` so already, as where a code has several outer rings. With ``wrap`` x is a
    longitude: a ring that steps over the antimeridian goes on beyond 180
    degrees, and rings stand again a full circle away where they reach into
    -180..180.
    """
    ring = Window.partitionBy("code", "ring")
    order = ring.orderBy("k")
    c = corners
    if wrap:
        step = F.col("x") - F.lag("x").over(order)
        jump = c.withColumn("_turns", F.when(step > 180, -1).when(step < -180, 1).otherwise(0))
        c = jump.withColumn("x", F.col("x") + 360 * F.sum("_turns").over(order)).drop("_turns")
    last = F.row_number().over(order) == F.count(F.lit(1)).over(ring)
    following = lambda v: F.when(last, F.first(v).over(order)).otherwise(F.lead(v).over(order))
    edges = c.select("code", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), following("x").alias("x2"), following("y").alias("y2"))
    edges = settle(edges.where("x1 <> x2 or y1 <> y2"))
    turned = edges.groupBy("code", "ring").agg(F.sum(F.expr("x1 * y2 - x2 * y1")).alias("_area"), F.min("x1").alias("_west"), F.max("x1").alias("_east"))
    back = F.lit(False) if oriented else (F.col("_area") > 0) != (F.col("ring") == 0)
    turned = turned.select("code", "ring", back.alias("_back"), "_west", "_east")
    swapped = [F.when(F.col("_back"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))]
    out = edges.join(turned, ["code", "ring"]).select("code", "ring", *swapped, "_west", "_east")
    if wrap:
        out = out.withColumn("_by", F.explode(F.array(*[F.lit(v) for v in (-360.0, 0.0, 360.0)]))).where("_by = 0 or (_west + _by <= 180 and _east + _by >= -180)")
        out = out.withColumns({x: F.col(x) + F.col("_by") for x in ("x1", "x2")})
    return out.select("code", "ring", *ENDS)


def _x_at(y: str) -> str:
    """Where the edge's line is at the height y; the edge's own ends are met exactly."""
    return f"CASE WHEN {y} = y1 THEN x1 WHEN {y} = y2 THEN x2 ELSE x1 + try_divide((x2 - x1) * ({y} - y1), y2 - y1) END"


def _y_at(x: str) -> str:
    return f"CASE WHEN {x} = x1 THEN y1 WHEN {x} = x2 THEN y2 ELSE y1 + try_divide((y2 - y1) * ({x} - x1), x2 - x1) END"


def _row_pieces(edges: DataFrame, size: float) -> DataFrame:
    """``edges`` once for each row of cells that they reach: cy, and the piece xa, ya, xb, yb in it."""
    rows = edges.withColumn("cy", F.expr(f"explode(sequence(floor(least(y1, y2) / {size!r}D), floor(greatest(y1, y2) / {size!r}D)))"))
    inside = lambda y: f"greatest(cy * {size!r}D, least((cy + 1) * {size!r}D, {y}))"
    rows = rows.withColumns({"ya": F.expr(inside("y1")), "yb": F.expr(inside("y2"))})
    return rows.withColumns({"xa": F.expr(f"CASE WHEN y1 = y2 THEN x1 ELSE {_x_at('ya')} END"), "xb": F.expr(f"CASE WHEN y1 = y2 THEN x2 ELSE {_x_at('yb')} END")})


def edge_cells(edges: DataFrame, size: float) -> DataFrame:
    """``edges(code, x1, y1, x2, y2)`` once for each cell (cx, cy) that they touch, with the piece xa, ya, xb, yb in the cell's row."""
    return _row_pieces(edges, size).withColumn("cx", F.expr(f"explode(sequence(floor(least(xa, xb) / {size!r}D - {RIM}D), floor(greatest(xa, xb) / {size!r}D + {RIM}D)))"))


def cell_parities(edges: DataFrame, size: float) -> DataFrame:
    """(code, cx, cy, odd, edged): cells that a polygon touches or fills, whether it holds their lower left corner, and whether edges enter.

    Crossings of a row's lower line are counted by cell and summed from the
    east; the cells between two with edges are all in or all out, and only
    those that are in are listed.
    """
    touched, line = edge_cells(edges, size), f"cy * {size!r}D"
    crossed = _row_pieces(edges, size).where(f"(y1 > {line}) <> (y2 > {line})").select("code", "cy", F.expr(_x_at(line)).alias("x"))
    west = f"floor(x / {size!r}D) - CASE WHEN x > floor(x / {size!r}D) * {size!r}D THEN 0 ELSE 1 END"  # the last cell whose corner lies west of the crossing
    crossing = crossed.selectExpr("code", "cy", f"{west} AS cx", "1 AS n", "false AS e")
    every = touched.selectExpr("code", "cy", "cx", "0 AS n", "true AS e").union(crossing)
    cells = every.groupBy("code", "cy", "cx").agg(F.sum("n").alias("n"), F.bool_or("e").alias("edged"))
    row = Window.partitionBy("code", "cy").orderBy(F.desc("cx"))
    so_far = cells.withColumn("odd", F.sum("n").over(row) % 2 == 1).withColumn("_next", F.lead("cx").over(row))
    spread = F.expr("CASE WHEN odd AND cx - _next > 1 THEN sequence(_next + 1, cx) ELSE array(cx) END")
    listed = so_far.select("code", F.explode(spread).alias("at"), "cx", "cy", "odd", "edged")
    return listed.selectExpr("code", "at AS cx", "cy", "odd", "edged AND at = cx AS edged")


def _crossed(size: float) -> Column:
    """How often the way from the cell's corner up its western side and east to the point (lon, lat) meets the edge."""
    x0, y0 = f"cx * {size!r}D", f"cy * {size!r}D"
    rising = "y1 <> y2 AND (y2 > y1) = (x2 > x1)"
    above = lambda at: f"({_y_at(x0)} > {at} OR {_y_at(x0)} = {at} AND {rising})"
    up = f"(x1 > {x0}) <> (x2 > {x0}) AND {above(y0)} AND NOT {above('lat')}"
    along = f"(y1 > lat) <> (y2 > lat) AND {_x_at('lat')} > {x0} AND {_x_at('lat')} <= lon"
    return F.expr(f"CASE WHEN {up} THEN 1 ELSE 0 END + CASE WHEN {along} THEN 1 ELSE 0 END")


def _turn(e: list[str], p: list[str]) -> str:
    ax, ay, bx, by = e
    return f"(({bx} - {ax}) * ({p[1]} - {ay}) - ({by} - {ay}) * ({p[0]} - {ax}))"


def _on(p: list[str], e: list[str]) -> str:
    """Whether the point lies on the edge."""
    spans = [f"{p[k]} BETWEEN least({e[k]}, {e[k + 2]}) AND greatest({e[k]}, {e[k + 2]})" for k in (0, 1)]
    return f"({_turn(e, p)} = 0 AND {spans[0]} AND {spans[1]})"


def covering(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(id, code) of the polygons that cover each of ``points(id, lon, lat)``, boundaries included.

    A point meets the cells of the polygons that reach into its cell, and of
    each of them the edges of this one cell.
    """
    celled = points.select("id", "lon", "lat", F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
    cells = settle(cell_parities(edges, size))
    near = celled.join(cells, ["cx", "cy"])
    filled = near.where("not edged and odd").select("id", "code")
    own = edge_cells(edges, size).select("code", "cx", "cy", *ENDS)
    met = near.where("edged").join(own, ["code", "cx", "cy"])
    counted = met.groupBy("id", "code").agg(F.bool_or("odd").alias("odd"), F.sum(_crossed(size)).alias("n"), F.expr(f"bool_or({_on(['lon', 'lat'], ENDS)})").alias("on"))
    return filled.union(counted.where("on OR odd <> (n % 2 = 1)").select("id", "code"))


def points_in_polygons(points: DataFrame, edges: DataFrame, size: float = 10.0) -> DataFrame:
    """Each point with the number of polygons that cover it, boundaries included, and the lowest code of them; code -1 and 0 if none."""
    found = covering(points, edges, size).groupBy("id").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("hits"))
    return points.join(found, "id", "left").select("id", F.coalesce("code", F.lit(-1)).alias("code"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def meeting_polygons(edges: DataFrame, size: float = 10.0) -> DataFrame:
    """(a, b) of all pairs a < b of polygons that share a point: edges that meet within a cell, or a ring's corner that the other covers."""
    own = edge_cells(edges, size)
    one, two = (own.select("cx", "cy", F.col("code").alias(c), *[F.col(e).alias(e + c) for e in ENDS]) for c in ("a", "b"))
    e, f = ([x + c for x in ENDS] for c in ("a", "b"))
    side = lambda g, h, k: f"signum({_turn(g, h[2 * k : 2 * k + 2])})"
    proper = f"{side(e, f, 0)} * {side(e, f, 1)} < 0 AND {side(f, e, 0)} * {side(f, e, 1)} < 0"
    touching = [_on(f[:2], e), _on(f[2:], e), _on(e[:2], f), _on(e[2:], f)]
    crossing = one.join(two, ["cx", "cy"]).where("a < b").where(" OR ".join([f"({proper})", *touching])).select("a", "b")
    corner = edges.groupBy("code", "ring").agg(F.min(F.struct("x1", "y1")).alias("p")).select(F.col("code").alias("id"), F.col("p.x1").alias("lon"), F.col("p.y1").alias("lat"))
    held = covering(corner, edges, size).where("id <> code").select(F.least("id", "code").alias("a"), F.greatest("id", "code").alias("b"))
    return crossing.union(held).distinct()


def overlay_areas(edges: DataFrame, size: float) -> DataFrame:
    """(code, cx, cy, area) of what each polygon covers of each grid cell, for rings that do not cross themselves.

    Each piece of an edge in a cell adds the trapezoid between itself and the
    cell's eastern side, and its height times the width to all cells further
    east in the row.
    """
    inside = lambda x: f"greatest(cx * {size!r}D, least((cx + 1) * {size!r}D, {x}))"
    pieces = edge_cells(edges, size).where("ya <> yb").withColumns({"_xa": F.expr(inside("xa")), "_xb": F.expr(inside("xb"))})
    y_at = lambda x: f"CASE WHEN {x} = xa THEN ya WHEN {x} = xb THEN yb ELSE ya + (yb - ya) * try_divide({x} - xa, xb - xa) END"
    rise = f"CASE WHEN xa <> xb THEN {y_at('_xb')} - {y_at('_xa')} WHEN floor(xa / {size!r}D) = cx THEN yb - ya ELSE 0D END"
    sums = pieces.withColumn("_dy", F.expr(rise)).groupBy("code", "cy", "cx").agg(F.sum("_dy").alias("_dy"), F.expr(f"sum(_dy * ((cx + 1) * {size!r}D - (_xa + _xb) / 2)) AS own"))
    row = Window.partitionBy("code", "cy").orderBy("cx")
    before = F.coalesce(F.sum("_dy").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = settle(sums.select("code", "cy", "cx", (-F.col("own") - size * before).alias("area"), (-size * (before + F.col("_dy"))).alias("beyond"), F.lead("cx").over(row).alias("_next")))
    gaps = placed.where((F.col("_next") - F.col("cx") > 1) & (F.col("beyond") > SPECK * size * size)).select("code", F.explode(F.expr("sequence(cx + 1, _next - 1)")).alias("cx"), "cy", F.col("beyond").alias("area"))
    return placed.select("code", "cx", "cy", "area").union(gaps).where(F.col("area") > SPECK * size * size)
