"""Rings that cross or touch themselves, made into valid ones.

What a polygon holds is what even and odd crossings say. Its edges are cut
where they meet; of pieces that lie on one another an even number cancels;
each piece that is left has the inside on one side only, so together they are
the boundary. Each is turned to have the inside on its left, the pieces that
leave and reach a node are paired by their angle, and rings are what the pairs
make. All of it is joins within grid cells, within nodes and along rings, so
one polygon may have any number of edges.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.polygons import ENDS, _crossed, _turn, cell_parities, edge_cells
from quern.plans.staging import settle

#: Cuts move edges by rounding, which can make them meet anew; so often cutting is repeated at most.
ROUNDS = 12
#: Crossings are rounded to multiples of this, so that edges which cross at one point share a node,
GRID = 2.0**-30
#: and an end this near to an edge lies on it.
NEAR = 2.0**-29
#: Where on a piece its side is looked at: not in the middle, which often lies on a grid line.
PLACE = "0.41421356D"


def _meetings(edges: DataFrame, size: float) -> DataFrame:
    """(code, e, x, y, proper): points at which edges (code, e, x1, y1, x2, y2) have to be cut, as another edge of their code meets them there."""
    own = edge_cells(edges, size).select("code", "cx", "cy", "e", *ENDS)
    one, two = (own.select("code", "cx", "cy", *[F.col(c).alias(c + s) for c in ["e", *ENDS]]) for s in ("a", "b"))
    e, f = ([c + s for c in ENDS] for s in ("a", "b"))
    pairs = one.join(two, ["code", "cx", "cy"]).where("ea < eb").drop("cx", "cy").distinct()
    long = lambda g: f"sqrt(({g[2]} - {g[0]}) * ({g[2]} - {g[0]}) + ({g[3]} - {g[1]}) * ({g[3]} - {g[1]}))"
    side = lambda g, h, k: f"CASE WHEN abs({_turn(g, h[2 * k : 2 * k + 2])}) <= {NEAR!r}D * {long(g)} THEN 0 ELSE signum({_turn(g, h[2 * k : 2 * k + 2])}) END"
    proper = f"({side(e, f, 0)}) * ({side(e, f, 1)}) < 0 AND ({side(f, e, 0)}) * ({side(f, e, 1)}) < 0"
    share = f"{_turn(f, e[:2])} / ({_turn(f, e[:2])} - {_turn(f, e[2:])})"
    grid = lambda v: f"round(({v}) / {GRID!r}D) * {GRID!r}D"
    at = f"named_struct('x', {grid(f'x1a + (x2a - x1a) * ({share})')}, 'y', {grid(f'y1a + (y2a - y1a) * ({share})')})"
    along = lambda p, g: f"(({p[0]} - {g[0]}) * ({g[2]} - {g[0]}) + ({p[1]} - {g[1]}) * ({g[3]} - {g[1]}))"
    inner = lambda p, g: f"(abs({_turn(g, p)}) <= {NEAR!r}D * {long(g)} AND {along(p, g)} > {NEAR!r}D * {long(g)} AND {along(p, g)} < {long(g)} * ({long(g)} - {NEAR!r}D))"
    cut = lambda e, x, y, p: f"named_struct('e', {e}, 'x', {x}, 'y', {y}, 'proper', {p})"
    touched = [f"CASE WHEN {inner(g[2 * k : 2 * k + 2], h)} THEN {cut(name, g[2 * k], g[2 * k + 1], 'false')} END" for g, h, name in ((f, e, "ea"), (e, f, "eb")) for k in (0, 1)]
    crossed = pairs.withColumn("_at", F.expr(f"CASE WHEN {proper} THEN {at} END"))
    cuts = [f"CASE WHEN _at IS NOT NULL THEN {cut(name, '_at.x', '_at.y', 'true')} END" for name in ("ea", "eb")]
    found = crossed.select("code", F.expr(f"inline(filter(array({', '.join([*cuts, *touched])}), c -> c IS NOT NULL))"))
    return found.groupBy("code", "e", "x", "y").agg(F.bool_or("proper").alias("proper"))


def noded(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """The pieces (code, x1, y1, x2, y2) of ``edges(code, ring, x1, y1, x2, y2)``, which meet at their ends alone, and (code, crossings) of codes whose edges cross."""
    key = F.xxhash64("code", "ring", *ENDS)
    pieces = settle(edges.groupBy("code", "ring", *ENDS).agg(F.count("*").alias("times")).select("code", key.alias("e"), *ENDS, "times"))
    crossings = None
    for _ in range(ROUNDS):
        cuts = settle(_meetings(pieces, size))
        if crossings is None:
            crossings = settle(cuts.where("proper").select("code", "x", "y").distinct().groupBy("code").agg(F.count("*").alias("crossings")))
        if cuts.isEmpty():
            return pieces.select("code", *ENDS, "times"), crossings
        ends = pieces.select("code", "e", F.expr("inline(array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2)))"))
        line = Window.partitionBy("code", "e").orderBy("_way", "x", "y")
        stops = ends.union(cuts.select("code", "e", "x", "y")).distinct().join(pieces, ["code", "e"]).withColumn("_way", F.expr("(x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)"))
        cut = stops.select("code", "times", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(line).alias("x2"), F.lead("y").over(line).alias("y2")).where("x2 IS NOT NULL")
        ordered = "(x1, y1) > (x2, y2)"
        low = [F.expr(f"CASE WHEN {ordered} THEN {a} ELSE {b} END").alias(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))]
        pieces = settle(cut.select("code", "times", *low).groupBy("code", *ENDS).agg(F.sum("times").alias("times")).select("code", F.xxhash64("code", *ENDS).alias("e"), *ENDS, "times"))
    raise RuntimeError(f"edges still meet after {ROUNDS} rounds of cuts")


def _facing(pieces: DataFrame, size: float) -> DataFrame:
    """``pieces(code, e, x1, y1, x2, y2)`` turned to have what is inside on their left."""
    lat = f"CASE WHEN y1 = y2 THEN y1 ELSE y1 + {PLACE} * (y2 - y1) END"
    lon = f"CASE WHEN y1 = y2 THEN x1 + {PLACE} * (x2 - x1) ELSE x1 + try_divide((x2 - x1) * (lat - y1), y2 - y1) END"
    middles = pieces.withColumn("lat", F.expr(lat)).select("code", F.col("e").alias("id"), F.expr(lon).alias("lon"), "lat")
    celled = middles.withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    near = celled.join(cell_parities(pieces, size).select("code", "cx", "cy", "odd"), ["code", "cx", "cy"])
    own = edge_cells(pieces, size).select("code", "cx", "cy", *ENDS)
    beyond = near.join(own, ["code", "cx", "cy"], "left").groupBy("code", "id").agg((F.bool_or("odd") != (F.coalesce(F.sum(_crossed(size)), F.lit(0)) % 2 == 1)).alias("beyond"))  # to the east, of level pieces to the north
    away = pieces.join(beyond.withColumnRenamed("id", "e"), ["code", "e"]).withColumn("_turn", F.expr("beyond = CASE WHEN y1 = y2 THEN x2 < x1 ELSE y2 > y1 END"))
    return away.select("code", "e", *[F.when(F.col("_turn"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))])


def _following(faced: DataFrame, by: list[str], split: bool) -> DataFrame:
    """(code, e, next): at each node the piece that comes in goes on by the one that leaves beside it, round the inside or, to ``split``, round the outside."""
    kept = [c for c in by if c != "code"]
    ends = faced.select("code", *kept, "e", F.expr("inline(array(named_struct('x', x1, 'y', y1, 'out', true, 'angle', atan2(y2 - y1, x2 - x1)), named_struct('x', x2, 'y', y2, 'out', false, 'angle', atan2(y1 - y2, x1 - x2))))"))
    node = Window.partitionBy(*by, "x", "y")
    turn = node.orderBy(F.col("angle").asc() if not split else F.col("angle").desc())
    beside = F.coalesce(F.lag("e").over(turn), F.last("e").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ends.withColumn("next", beside).where("NOT out").select("code", "e", "next")


def _ringed(following: DataFrame) -> DataFrame:
    """(code, e, ring, left): the least piece of each ring and the steps to it, by doubling the steps that are seen."""
    at = settle(following.select("code", "e", "next", F.struct(F.col("e").alias("ring"), F.lit(0).cast("long").alias("left")).alias("best")))
    step = 1
    while True:
        ahead = at.select("code", F.col("e").alias("next"), F.col("next").alias("_next"), F.col("best").alias("_best"))
        seen = F.least("best", F.struct(F.col("_best.ring").alias("ring"), (F.col("_best.left") + step).alias("left")))
        at = settle(at.join(ahead, ["code", "next"]).select("code", "e", F.col("_next").alias("next"), seen.alias("best"), (seen["ring"] != F.col("best.ring")).alias("_new")))
        if at.where("_new").isEmpty():
            return at.select("code", "e", "best.ring", "best.left")
        at, step = at.drop("_new"), 2 * step


def untangled(edges: DataFrame, size: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Valid rings of polygons, and an audit of what was done.

    ``edges(code, ring, x1, y1, x2, y2)`` are of rings in any direction that
    may cross, touch or overlap themselves and one another. The first table is
    (code, ring, k, x, y, area): corners in order, no node twice in a ring,
    outer rings anticlockwise and holes clockwise, with the ring's signed
    area; rings number from 0 in each code, the largest first. The second is
    (code, crossings, rings, holes, source_area, area, change): source_area is
    that of the rings as given, change its relative difference. Codes of which
    nothing is left have an audit row alone; edges of no length or with nulls
    are left out. Points nearer than NEAR to one another are told apart only
    if both are corners.
    """
    given = edges.where("(x1 <> x2 OR y1 <> y2) AND x1 + x2 + y1 + y2 IS NOT NULL").select("code", "ring", *ENDS)
    pieces, crossings = noded(given, size)
    low = [F.expr(f"CASE WHEN (x1, y1) > (x2, y2) THEN {a} ELSE {b} END").alias(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))]
    odd = pieces.select("code", "times", *low).groupBy("code", *ENDS).agg(F.sum("times").alias("times")).where("times % 2 = 1")
    faced = settle(_facing(settle(odd.select("code", F.xxhash64("code", *ENDS).alias("e"), *ENDS)), size))
    parts = _ringed(_following(faced, ["code"], split=False)).select("code", "e", F.col("ring").alias("part"))
    rings = settle(_ringed(_following(faced.join(parts, ["code", "e"]), ["code", "part"], split=True)).join(faced, ["code", "e"]))
    sums = rings.groupBy("code", "ring").agg((F.sum(F.expr("x1 * y2 - x2 * y1")) / 2).alias("area"), F.count("*").alias("_n"))
    sums = settle(sums.withColumn("_ring", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("area"), "ring")) - 1))
    corners = rings.join(sums, ["code", "ring"]).select("code", F.col("_ring").alias("ring"), F.expr("(_n - left) % _n").cast("int").alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y"), "area")
    source = given.groupBy("code", "ring").agg((F.sum(F.expr("x1 * y2 - x2 * y1")) / 2).alias("_a")).groupBy("code").agg(F.abs(F.sum("_a")).alias("source_area"))
    made = sums.groupBy("code").agg(F.count_if(F.col("area") > 0).alias("rings"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("area").alias("area"))
    audit = source.join(crossings, "code", "left").join(made, "code", "left").fillna(0, ["crossings", "rings", "holes", "area"])
    change = F.abs(F.col("area") - F.col("source_area")) / F.greatest("source_area", F.lit(1e-12))
    return corners, audit.select("code", "crossings", "rings", "holes", "source_area", "area", change.alias("change"))
