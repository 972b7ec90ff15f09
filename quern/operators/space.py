"""Points, distances and spatial joins on a grid of equi-join cells."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import settle

EARTH_KM = 6371.0088


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, theta = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def arc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance from the dot product of unit vectors."""
    dot = sum((a * b for a, b in zip(unit_vector(lat1, lon1), unit_vector(lat2, lon2), strict=True)), F.lit(0.0))
    return EARTH_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


#: Width of the coarsest cells of the unit cube, how many fit one side of the next coarser one, and levels at most: a packed index has 20 bits an axis.
WIDTH, FINER, LEVELS = 0.5, 4, 10
#: Comparisons a point that end the descent.
ENOUGH = 64
#: Squared chords are exact up to this.
SLACK = 1e-12


def _celled(points: DataFrame, level: int) -> DataFrame:
    """``points`` with the cell of a level that their place on the unit sphere lies in, and the cell around it."""
    index = lambda c: f"floor(({c} + 1) / {WIDTH / FINER**level!r}D)"
    packed = lambda axis: " + ".join(f"shiftleft({axis(c)}, {20 * k})" for k, c in enumerate("xyz"))
    return points.withColumns({"cell": F.expr(packed(index)), "parent": F.expr(packed(lambda c: f"({index(c)} div {FINER})"))})


def _extents(points: DataFrame, by: list[str], level: int, side: str) -> DataFrame:
    """Each cell's points: how many, the box around them, the least and the greatest id."""
    ends = [F.expr(f"{f}({c}) AS {side}_{c}{k}") for c in "xyz" for k, f in enumerate(("min", "max"))]
    stats = _celled(points, level).groupBy(*by, "parent", "cell").agg(F.expr(f"count(1) AS {side}_n"), *ends, F.expr(f"min(id) AS {side}_low"), F.expr(f"max(id) AS {side}_high"))
    return stats.withColumnsRenamed({"cell": side, "parent": f"{side}_parent"})


def _promising(pairs: DataFrame, of: list[str], prior: bool) -> DataFrame:
    """The pairs of boxes l and r whose least distance does not exceed the greatest to a box that surely has a neighbour for all of l.

    Distances are squared chords.
    """
    squares = lambda ends: " + ".join(f"pow({ends(c)}, 2)" for c in "xyz")
    near = squares(lambda c: f"greatest(l_{c}0 - r_{c}1, r_{c}0 - l_{c}1, 0D)")
    far = squares(lambda c: f"greatest(l_{c}1 - r_{c}0, r_{c}1 - l_{c}0)")
    bounded = (pairs.where("r_low < l_high") if prior else pairs).selectExpr("*", f"{near} AS _near", f"{far} AS _far")
    reach = F.min(F.expr("CASE WHEN r_low < l_low THEN _far END") if prior else F.col("_far")).over(Window.partitionBy(*of))
    return bounded.withColumn("_reach", reach).where(f"_reach IS NULL OR _near <= _reach + {SLACK}D").drop("_near", "_far", "_reach")


def nearest_candidates(left: DataFrame, right: DataFrame, by: list[str] | None = None, prior: bool = False) -> DataFrame:
    """(*by, a, b, km) of pairs among which is the nearest b of each a: within ``by``, and with ``prior`` of lower ids than a's.

    Both sides descend a pyramid of cells together. Of each pair of cells the
    boxes around their points bound the distance from below and above; a left
    cell keeps the right cells that may be nearer than the farthest point of
    its best one, and hands them on to the cells within it. The descent ends
    when the points of the cells that are left make few comparisons, or no
    cell has been split.
    """
    by = by or []
    placed = []
    for df in (left, right):
        x, y, z = unit_vector(F.col("lat"), F.col("lon"))
        placed.append(settle(df.where("lat is not null and lon is not null").select(*by, "id", "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"))))
    left, right = placed
    kept, before = None, (0, 0)
    for level in range(LEVELS):
        l, r = _extents(left, by, level, "l"), _extents(right, by, level, "r")
        if kept is None:
            pairs = l.withColumn("_all", F.lit(0)).join(r.withColumn("_all", F.lit(0)), [*by, "_all"]).drop("_all")  # of the coarsest cells, some fifty a side
        else:
            parents = kept.select(*by, F.col("l").alias("l_parent"), F.col("r").alias("r_parent"))
            pairs = parents.join(l, [*by, "l_parent"]).join(r, [*by, "r_parent"])
        kept = settle(_promising(pairs, [*by, "l"], prior).select(*by, "l", "r", "l_n", *[c for c in r.columns if c not in (*by, "r", "r_parent")]))
        cost, *cells = kept.agg(F.coalesce(F.sum(F.expr("l_n * r_n")), F.lit(0)), F.count_distinct(*by, "l"), F.count_distinct(*by, "r")).first()
        points = left.count() if level == 0 else points
        if cost <= ENOUGH * points or level and cells == before:
            break
        before = cells
    own = _celled(left, level).select(*by, F.col("cell").alias("l"), F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), *[F.col(c).alias(f"l_{c}{k}") for c in "xyz" for k in (0, 1)], F.col("id").alias("l_low"), F.col("id").alias("l_high"))
    boxes = _promising(own.join(kept.drop("l_n"), [*by, "l"]), [*by, "a"], prior)
    other = _celled(right, level).select(*by, F.col("cell").alias("r"), F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    met = boxes.select(*by, "r", "a", "lat1", "lon1").join(other, [*by, "r"])
    met = met.where("b < a") if prior else met
    return met.select(*by, "a", "b", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def nearest(left: DataFrame, right: DataFrame, by: list[str] | None = None, prior: bool = False) -> DataFrame:
    """(*by, a, b, km): the nearest b of each a however far it is, of those that ``nearest_candidates`` lets it have; the lowest b among equals.

    Ids are distinct on each side.
    """
    by = by or []
    best = nearest_candidates(left, right, by, prior).groupBy(*by, "a").agg(F.min(F.struct("km", "b")).alias("m"))
    return best.select(*by, "a", "m.b", "m.km")


def within_km(left: DataFrame, right: DataFrame, km: float, by: list[str] | None = None) -> DataFrame:
    """(*by, a, b, km) of all pairs (left.id, right.id) that are at most ``km`` apart and agree in ``by``.

    Right points are put into all latitude bands within reach and, where the
    longitude circle is wide enough, into longitude cells of their band.
    """
    band = F.lit(km / 111.0)  # degrees of latitude, a little more than km
    rows = lambda lat: F.floor(lat / band)
    by = by or []
    l = left.select(*by, F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), rows(F.col("lat")).alias("row"))
    r = right.select(*by, F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.sequence(rows(F.col("lat")) - 1, rows(F.col("lat")) + 1)).alias("row"))
    width = F.greatest(F.cos(F.radians(F.least(F.lit(89.0), (F.abs(F.col("row")) + 2) * band))), F.lit(0.02))  # the band's narrowest circle
    cells = F.greatest(F.lit(1), F.floor(F.lit(360.0) * width / band / 2)).cast("int")
    cell = lambda lon: F.pmod(F.floor((lon + 180.0) / 360.0 * F.col("cells")), F.col("cells"))
    l = l.withColumn("cells", cells).withColumn("cell", cell(F.col("lon1"))).drop("cells")
    near = F.array_distinct(F.array(*[F.pmod(cell(F.col("lon2")) + k, F.col("cells")) for k in (-1, 0, 1)]))
    r = r.withColumn("cells", cells).withColumn("cell", F.explode(near)).drop("cells")
    d = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return l.join(r, [*by, "row", "cell"]).withColumn("km", d).where(F.col("km") <= km).select(*by, "a", "b", "km")


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    """Of (a, b, km) the k nearest b of each a, the lowest b first among equals."""
    order = Window.partitionBy("a").orderBy("km", "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Points that share a cube as wide as the first of growing radii, on average over all points.
FEW = 16


def radii(points: DataFrame, km: float, by: list[str] | None = None) -> list[float]:
    """Radii that double up to ``km``, from one on within which points of a group have few others on average, crowds included."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    placed = settle(points.select(*(by or []), x.alias("x"), y.alias("y"), z.alias("z")))
    out = [km]
    while out[0] > km / 2**20:
        cubes = placed.groupBy(*(by or []), *[F.floor(F.col(c) / (out[0] / EARTH_KM)).alias(c) for c in "xyz"]).agg(F.count(F.lit(1)).cast("double").alias("n"))
        met, n = cubes.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
        if (met or 0) <= FEW * (n or 0):
            break
        out.insert(0, out[0] / 2)
    return out


def nearest_k_within(points: DataFrame, k: int, km: float) -> DataFrame:
    """(a, b, km, rank): the k nearest others of each point that are at most ``km`` away, the lowest b first among equals.

    Radii double; a point that has k neighbours within one is done and does
    not look further, so crowded places are never paired with all that is
    within ``km``. Of points at one place only the k + 1 lowest can be
    anyone's neighbours.
    """
    here = Window.partitionBy("lat", "lon").orderBy("id")
    left = settle(points.where("lat is not null and lon is not null").select("id", "lat", "lon"))
    right = settle(left.withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= k + 1).drop("_r"))
    out = None
    for reach in radii(right, km):
        near = settle(nearest_k(within_km(left, right, reach).where("a <> b"), k))
        if reach < km:
            done = near.where(F.col("rank") == k).select("a")
            left = settle(left.join(done, left["id"] == done["a"], "left_anti"))
            near = near.join(done, "a", "left_semi")
        out = near if out is None else out.union(near)
    return out
