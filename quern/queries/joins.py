"""C02-C36."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import joins as J
from quern.operators import polygons as P
from quern.operators import space as S
from quern.plans.registry import query
from quern.plans.salting import spread_join
from quern.sources import files
from quern.sources.relations import DIST, EDGES, GROUPS, OBS, POINTS, TAXA, distribution, edges, observations, points, taxa, unit_groups
from quern.sources.tables import table

PARTS_OF = "keyed AS (SELECT split_part(p_name, ' ', 1) AS name, p_partkey AS part FROM part)"


def _first_word(spark, d):
    return table(spark, d, "part").select(F.split("p_name", " ")[0].alias("name"), F.col("p_partkey").alias("part"))


@query(f"WITH {EDGES}, {TAXA} SELECT DISTINCT consumer, family FROM edges JOIN taxa USING (resource)")
def c02_merge_inner_distinct(spark, d):
    return edges(spark, d).join(taxa(spark, d), "resource").select("consumer", "family").distinct()


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def c03_contracted_left_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return J.checked_join(o, c, ["o_custkey"], "left", "m:1")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def c04_many_to_many_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return spread_join(c, s, ["k"], "c_custkey", "s_suppkey").drop("k")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def c05_semi_join(spark, d):
    wanted = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(wanted, "p_partkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c06_anti_join(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_anti")


@query("SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'elsewhere' END AS place FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def c07_lookup_with_default(spark, d):
    known = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(known, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("elsewhere")).alias("place"))


@query("SELECT a.n_regionkey AS grp, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def c08_unordered_pairs(spark, d):
    return J.unordered_pairs(unit_groups(spark, d), "unit", ["grp"])


@query("""WITH f AS (SELECT DISTINCT s_nationkey AS s, c_nationkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT least(s, c) AS a, greatest(s, c) AS b, count(*)::BIGINT AS directions FROM f WHERE s <> c GROUP BY 1, 2""")
def c09_order_insensitive_pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("s")), "l_suppkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("c"))
    flows = li.join(o, "l_orderkey").select("s", "c").distinct().where("s <> c")
    return flows.groupBy(F.least("s", "c").alias("a"), F.greatest("s", "c").alias("b")).agg(F.count("*").alias("directions"))


#: Directions in which the hulls' corners lie, and a hole's size; hulls stand for units of land.
DIRECTIONS, HOLE = 16, 0.4
SPOTS = {
    "label": ("label * 8 + 2 * floor((lon + 180) / 90) + floor((lat + 90) / 90)", 3),  # hulls of other labels overlap
    "tile": ("floor((lon + 180) / 60) * 10 + floor((lat + 90) / 45)", 3),  # no two overlap
}


def _hulls_sql(spots: str) -> str:
    code, least = SPOTS[spots]
    dirs = ", ".join(f"({k}, {math.cos(2 * math.pi * k / DIRECTIONS)!r}::DOUBLE, {math.sin(2 * math.pi * k / DIRECTIONS)!r}::DOUBLE)" for k in range(DIRECTIONS))
    hole = lambda c: f"(m.{c}0 + m.{c}1) / 2 + {HOLE} * (o.{c} - (m.{c}0 + m.{c}1) / 2)"
    return f"""spots AS (SELECT ({code})::INTEGER AS code, lon AS x, lat AS y FROM points WHERE label IS NOT NULL), dirs AS (SELECT * FROM (VALUES {dirs}) v(k, c, s)),
far AS (SELECT code, k, max([x * c + y * s, x, y]) AS h FROM spots, dirs WHERE code IN (SELECT code FROM spots GROUP BY 1 HAVING count(*) >= {least}) GROUP BY 1, 2), outer_ring AS (SELECT code, k, h[2] AS x, h[3] AS y FROM far),
middle AS (SELECT code, max(x) FILTER (k = 0) AS x0, max(x) FILTER (k = {DIRECTIONS // 2}) AS x1, max(y) FILTER (k = 0) AS y0, max(y) FILTER (k = {DIRECTIONS // 2}) AS y1 FROM outer_ring GROUP BY 1),
corners AS (SELECT code, 0 AS ring, k, x, y FROM outer_ring UNION ALL SELECT code, 1, k, {hole("x")}, {hole("y")} FROM outer_ring o JOIN middle m USING (code)),
sides AS (SELECT * FROM (SELECT code, ring, k, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM corners WINDOW w AS (PARTITION BY code, ring ORDER BY k)) WHERE x1 <> x2 OR y1 <> y2)"""


def _hulls(spark, d, spots):
    code, least = SPOTS[spots]
    p = points(spark, d).where("label is not null").select(F.expr(code).cast("int").alias("code"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    enough = p.groupBy("code").count().where(F.col("count") >= least).select("code")
    return P.polygon_edges(P.support_hulls(p.join(enough, "code"), DIRECTIONS, HOLE), wrap=False)


COVERS = """(count(*) FILTER ((y1 > {y}) <> (y2 > {y}) AND {x} < x1 + (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0)) % 2 = 1
  OR bool_or((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0 AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2) AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2)))"""
COVERED = f"covered AS (SELECT id, code FROM points, sides GROUP BY id, code, lon, lat HAVING {COVERS.format(x='lon', y='lat')})"


@query(f"WITH {POINTS}, {_hulls_sql('label')}, {COVERED} SELECT id, coalesce(min(code), -1) AS code, count(code)::BIGINT AS hits FROM points LEFT JOIN covered USING (id) GROUP BY 1")
def c10_point_in_polygon(spark, d):
    return P.points_in_polygons(points(spark, d), _hulls(spark, d, "label"))


@query(f"WITH {POINTS}, {_hulls_sql('label')}, {COVERED} SELECT id, min(code) AS code FROM covered GROUP BY 1")
def c11_covering_polygon_first(spark, d):
    return P.points_in_polygons(points(spark, d), _hulls(spark, d, "label"), 5.0).where("hits > 0").select("id", "code")


TURN = "sign(({b}.x1 - {a}.x1) * ({a}.y2 - {a}.y1) * -1 + ({a}.x2 - {a}.x1) * ({b}.y1 - {a}.y1)), sign(({b}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) * -1 + ({a}.x2 - {a}.x1) * ({b}.y2 - {a}.y1))"


@query(f"""WITH {POINTS}, {_hulls_sql("label")}, t AS (SELECT a.code AS a, b.code AS b, [{TURN.format(a="a", b="b")}] AS s, [{TURN.format(a="b", b="a")}] AS t,
  a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM sides a JOIN sides b ON a.code < b.code),
meet AS (SELECT DISTINCT a, b FROM t WHERE (s[1] * s[2] < 0 AND t[1] * t[2] < 0)
  OR (s[1] = 0 AND bx1 BETWEEN least(ax1, ax2) AND greatest(ax1, ax2) AND by1 BETWEEN least(ay1, ay2) AND greatest(ay1, ay2)) OR (s[2] = 0 AND bx2 BETWEEN least(ax1, ax2) AND greatest(ax1, ax2) AND by2 BETWEEN least(ay1, ay2) AND greatest(ay1, ay2))
  OR (t[1] = 0 AND ax1 BETWEEN least(bx1, bx2) AND greatest(bx1, bx2) AND ay1 BETWEEN least(by1, by2) AND greatest(by1, by2)) OR (t[2] = 0 AND ax2 BETWEEN least(bx1, bx2) AND greatest(bx1, bx2) AND ay2 BETWEEN least(by1, by2) AND greatest(by1, by2))),
held AS (SELECT c.code AS p, sides.code AS q FROM corners c JOIN sides ON c.code <> sides.code WHERE c.k = 0 GROUP BY c.code, sides.code, c.x, c.y HAVING {COVERS.format(x="c.x", y="c.y")})
SELECT a, b FROM meet UNION SELECT least(p, q), greatest(p, q) FROM held""")
def c12_polygon_intersections(spark, d):
    return P.meeting_polygons(_hulls(spark, d, "label"))


@query(f"WITH {POINTS}, {_hulls_sql('tile')}, {COVERED} SELECT id, code FROM points LEFT JOIN covered USING (id)")
def c13_left_spatial_join(spark, d):
    """Over polygons that do not overlap; a point in two of them fails the query."""
    found = files.expect(P.points_in_polygons(points(spark, d), _hulls(spark, d, "tile")), no_overlap=F.col("hits") <= 1)
    return found.select("id", F.when(F.col("hits") > 0, F.col("code")).alias("code"))


@query(f"WITH {PARTS_OF}, m AS (SELECT name, count(DISTINCT part) AS n, min(part) AS part FROM keyed GROUP BY 1), q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part) SELECT name, CASE WHEN n = 1 THEN part END AS part, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome FROM q LEFT JOIN m USING (name)")
def c14_three_way_match(spark, d):
    asked = table(spark, d, "part").select(F.get(F.split("p_name", " "), 1).alias("name")).select(F.coalesce("name", F.lit("")).alias("name")).distinct()
    return J.unique_match(asked, _first_word(spark, d), "name", "part")


@query("WITH a AS (SELECT c_nationkey AS k, c_custkey AS a FROM customer WHERE c_acctbal > 9500), b AS (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier WHERE s_acctbal > 5000) SELECT k, a, b FROM a JOIN b USING (k) WHERE k IN (SELECT k FROM a GROUP BY k HAVING count(*) = 1) AND k IN (SELECT k FROM b GROUP BY k HAVING count(*) = 1)")
def c15_mutually_unique_join(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("a"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b"))
    return J.mutually_unique(a, b, "k")


KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"


@query(f"WITH {POINTS}, p AS (SELECT a.id AS a, b.id AS b, {KM.format(a='a', b='b')} AS km FROM points a JOIN points b ON b.id % 7 = 0 AND a.id % 7 <> 0) SELECT a, b, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS r FROM p) WHERE r = 1")
def c16_nearest_neighbour(spark, d):
    p = points(spark, d)
    best = S.nearest(p.where("id % 7 <> 0"), p.where("id % 7 = 0"))
    return best.select("a", "b", F.round("km", 4).alias("km"))


@query(f"WITH {POINTS}, p AS (SELECT a.id AS a, b.id AS b, {KM.format(a='a', b='b')} AS km FROM points a JOIN points b ON a.id <> b.id), k AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS r FROM p WHERE km <= 1500) WHERE r <= 8) SELECT a, b FROM k UNION SELECT b, a FROM k")
def c17_symmetric_knn(spark, d):
    p = points(spark, d)
    k = S.nearest_k_within(p, 8, 1500.0)
    return k.select("a", "b").union(k.select("b", "a")).distinct()


@query(f"WITH {POINTS} SELECT a.id AS id, count(b.id)::BIGINT AS n FROM points a LEFT JOIN points b ON {KM.format(a='a', b='b')} <= 1000 GROUP BY 1")
def c18_radius_count(spark, d):
    p = points(spark, d)
    return S.within_km(p, p, 1000.0).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, cells AS (SELECT x, y FROM (SELECT unnest(range(36)) AS x), (SELECT unnest(range(18)) AS y) WHERE (x * 7 + y * 5) % 4 = 0), o AS (SELECT id, floor((lon + 180) / 10)::INTEGER AS cx, floor((lat + 90) / 10)::INTEGER AS cy FROM points),
w AS (SELECT id, (dx * dx + dy * dy)::BIGINT AS d2, y::BIGINT AS y, x::BIGINT AS x FROM o, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) JOIN cells ON x = (cx + dx + 36) % 36 AND y = cy + dy)
SELECT id, x, y, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, y, x) AS r FROM w) WHERE r = 1""")
def c19_nearest_valid_cell(spark, d):
    grid = spark.range(36 * 18).select((F.col("id") % 36).alias("x"), F.floor(F.col("id") / 36).alias("y")).where("(x * 7 + y * 5) % 4 = 0")
    steps = F.explode(F.expr("flatten(transform(sequence(-2, 2), dx -> transform(sequence(-2, 2), dy -> struct(dx, dy))))")).alias("s")
    around = points(spark, d).select("id", F.floor((F.col("lon") + 180) / 10).alias("cx"), F.floor((F.col("lat") + 90) / 10).alias("cy"), steps)
    near = around.select("id", F.pmod(F.col("cx") + F.col("s.dx"), F.lit(36)).alias("x"), (F.col("cy") + F.col("s.dy")).alias("y"), (F.col("s.dx") * F.col("s.dx") + F.col("s.dy") * F.col("s.dy")).cast("long").alias("d2")).join(grid, ["x", "y"])
    return near.groupBy("id").agg(F.min(F.struct("d2", "y", "x")).alias("m")).select("id", "m.x", "m.y", "m.d2")


@query(f"WITH {POINTS} SELECT a.id AS a, count(*)::BIGINT AS n, round(avg({KM.format(a='a', b='b')}), 4) AS mean_km FROM points a JOIN points b ON a.id <> b.id AND {KM.format(a='a', b='b')} <= 500 GROUP BY 1")
def c20_distance_band_join(spark, d):
    p = points(spark, d)
    return S.within_km(p, p, 500.0).where("a <> b").groupBy("a").agg(F.count("*").alias("n"), F.round(F.avg("km"), 4).alias("mean_km"))


PERIODS = "periods AS (SELECT * FROM (VALUES ('early', 1995, 1996), ('middle', 1997, 1999), ('late', 2000, 2002)) AS t(period, lo, hi))"


@query(f"WITH {PERIODS} SELECT period, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS price FROM orders JOIN periods ON year(o_orderdate) BETWEEN lo AND hi GROUP BY 1")
def c21_interval_containment(spark, d):
    periods = spark.createDataFrame([("early", 1995, 1996), ("middle", 1997, 1999), ("late", 2000, 2002)], "period string, lo int, hi int")
    years = periods.select("period", F.explode(F.sequence("lo", "hi")).alias("y"))  # intervals of whole years become an equi-join
    return table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).join(years, "y").groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("""WITH i AS (SELECT l_orderkey AS k, min(year(l_shipdate)) AS lo, max(year(l_shipdate)) AS hi FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS k, year(o_orderdate) AS lo, year(o_orderdate) + (o_orderkey % 2)::INTEGER AS hi FROM orders)
SELECT i.k, (i.lo - p.hi)::BIGINT AS least_lag, (i.hi - p.lo)::BIGINT AS most_lag, CASE WHEN i.lo > p.hi THEN 'after' WHEN i.hi < p.lo THEN 'before' ELSE 'undecided' END AS ordering FROM i JOIN p USING (k)""")
def c22_interval_lag_join(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.year("l_shipdate")).alias("lo_b"), F.max(F.year("l_shipdate")).alias("hi_b"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("lo_a"), (F.year("o_orderdate") + (F.col("o_orderkey") % 2).cast("int")).alias("hi_a"))
    return i.join(p, "k").select("k", (F.col("lo_b") - F.col("hi_a")).cast("long").alias("least_lag"), (F.col("hi_b") - F.col("lo_a")).cast("long").alias("most_lag"), J.lag_class(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")).alias("ordering"))


@query("""SELECT a.event_id, (SELECT max(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts < a.ts)::VARCHAR AS latest FROM events a WHERE a.event_type = 'purchase'""")
def c23_as_of_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("t", F.unix_micros("ts")).withColumn("seen", F.when(F.col("event_type") == "view", F.col("ts")))
    found = J.latest_before(e, "user_id", "t", "seen", "latest", 3_600_000_000)
    return found.where("event_type = 'purchase'").select("event_id", F.col("latest").cast("string").alias("latest"))


@query(f"WITH {OBS}, c AS (SELECT dataset, (day - DATE '2024-01-01')::BIGINT AS t, count(*) AS n FROM obs GROUP BY 1, 2) SELECT a.dataset, a.t, coalesce(sum(b.n), 0)::BIGINT AS trailing FROM c a LEFT JOIN c b ON a.dataset = b.dataset AND b.t >= a.t - 5 AND b.t < a.t GROUP BY 1, 2")
def c24_trailing_window(spark, d):
    c = observations(spark, d).groupBy("dataset", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("dataset").orderBy("t").rangeBetween(-5, -1)
    return c.select("dataset", "t", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("trailing"))


@query(f"WITH {OBS}, f AS (SELECT dataset, min(day) AS first FROM obs WHERE species = 'purchase' GROUP BY 1) SELECT f.dataset, string_agg(DISTINCT species, ';' ORDER BY species) AS follow_up FROM f JOIN obs o ON o.dataset = f.dataset AND o.day > f.first AND o.day <= f.first + 5 GROUP BY 1")
def c25_bounded_follow_up(spark, d):
    o = observations(spark, d)
    f = o.where("species = 'purchase'").groupBy("dataset").agg(F.min("day").alias("first"))
    hit = o.join(f, "dataset").where("day > first and day <= date_add(first, 5)")
    return hit.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("species")), ";").alias("follow_up"))


@query("WITH alias AS (SELECT 'alias-' || r_name AS alias, r_name AS name FROM region UNION ALL SELECT 'shared', r_name FROM region WHERE r_regionkey < 2), asked AS (SELECT r_name AS q FROM region UNION ALL SELECT DISTINCT alias FROM alias UNION ALL SELECT 'nobody'), u AS (SELECT alias, min(name) AS name FROM alias GROUP BY 1 HAVING count(DISTINCT name) = 1) SELECT q, coalesce(r_name, u.name) AS resolved FROM asked LEFT JOIN region ON r_name = q LEFT JOIN u ON alias = q")
def c26_alias_resolution(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    alias = names.select(F.concat(F.lit("alias-"), "name").alias("q"), F.col("name").alias("meant")).union(names.where("r_regionkey < 2").select(F.lit("shared"), "name"))
    asked = names.select(F.col("name").alias("q")).union(alias.select("q").distinct()).union(names.limit(1).select(F.lit("nobody")))
    known = alias.groupBy("q").agg(F.count_distinct("meant").alias("n"), F.min("meant").alias("meant")).where("n = 1").drop("n")
    return asked.join(names.select(F.col("name").alias("q"), "name"), "q", "left").join(known, "q", "left").select("q", F.coalesce("name", "meant").alias("resolved"))


@query(f"WITH {POINTS}, p AS (SELECT a.id AS a, b.id AS b, b.label, round({KM.format(a='a', b='b')}, 3) AS km FROM points a JOIN points b ON b.id < a.id) SELECT a, b, label, km FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b, label) AS r FROM p) WHERE r = 1")
def c27_nearest_prior(spark, d):
    p = points(spark, d)
    best = S.nearest(p, p, prior=True)
    return best.join(p.select(F.col("id").alias("b"), "label"), "b").select("a", "b", "label", F.round("km", 3).alias("km"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS suppliers, a.k IS NOT NULL AND b.k IS NOT NULL AS common FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) b ON a.k = b.k")
def c28_common_support(spark, d):
    a = table(spark, d, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders"))
    b = table(spark, d, "supplier").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").withColumn("common", F.col("orders").isNotNull() & F.col("suppliers").isNotNull())


@query("SELECT n_nationkey AS unit, t AS threshold, count(s_suppkey)::BIGINT AS suppliers FROM nation CROSS JOIN (SELECT unnest([0.0, 2500.0, 5000.0, 9000.0])::DOUBLE AS t) LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= t GROUP BY 1, 2")
def c29_grid_expansion(spark, d):
    grid = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.explode(F.array(*[F.lit(t) for t in (0.0, 2500.0, 5000.0, 9000.0)])).alias("threshold"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), "s_acctbal", "s_suppkey")
    return grid.join(s, "unit", "left").groupBy("unit", "threshold").agg(F.count_if(F.col("s_acctbal") >= F.col("threshold")).alias("suppliers"))


@query(f"WITH {EDGES}, {DIST} SELECT DISTINCT consumer FROM edges WHERE EXISTS (SELECT 1 FROM dist WHERE dist.resource = edges.resource AND unit = 7)")
def c30_overlap_semi_join(spark, d):
    there = distribution(spark, d).where("unit = 7").select("resource")
    return edges(spark, d).join(there, "resource", "left_semi").select("consumer").distinct()


#: The area that an edge adds to a square: the mean of x, held within the square and less its western side, times the height within it.
UNDER = "(power(greatest(0, least({x}, e) - w), 2) / 2 + 15.0 * greatest(0, {x} - e))"


@query(f"""WITH {POINTS}, {_hulls_sql("tile")}, squares AS (SELECT s::INTEGER AS square, -180 + 15.0::DOUBLE * (s % 24) AS w, -165 + 15.0::DOUBLE * (s % 24) AS e, -90 + 15.0::DOUBLE * (s // 24) AS so, -75 + 15.0::DOUBLE * (s // 24) AS no FROM (SELECT unnest(range(288)) AS s)),
cut AS (SELECT square, w, e, code, CASE ring WHEN 0 THEN 1 ELSE -1 END AS sign, x1, y1, x2, y2, greatest(so, least(no, y1)) AS ya, greatest(so, least(no, y2)) AS yb FROM squares, sides WHERE y1 <> y2),
ends AS (SELECT *, x1 + (x2 - x1) * (ya - y1) / (y2 - y1) AS xa, x1 + (x2 - x1) * (yb - y1) / (y2 - y1) AS xb FROM cut),
o AS (SELECT square, code, sum(sign * (yb - ya) * CASE WHEN abs(xb - xa) < 1e-9 THEN greatest(0, least(e, xa) - w) ELSE ({UNDER.format(x="xb")} - {UNDER.format(x="xa")}) / (xb - xa) END) AS area FROM ends GROUP BY 1, 2)
SELECT square, max_by(code, (area, -code)) AS dominant, round(max(area), 4) AS largest, round(sum(area), 4) AS total, max(area) >= 112.5 AS supported FROM o WHERE area > 1e-8 GROUP BY 1""")
def c31_overlay_areas(spark, d):
    """Land units over squares of 15 degrees: the one that covers most of a square, its area, that of all, and whether it covers half."""
    o = P.overlay_areas(_hulls(spark, d, "tile"), 15.0).where("area > 1e-8").withColumn("square", (F.col("cx") + 12 + 24 * (F.col("cy") + 6)).cast("int"))
    return o.groupBy("square").agg(F.max_by("code", F.struct("area", -F.col("code"))).alias("dominant"), F.round(F.max("area"), 4).alias("largest"), F.round(F.sum("area"), 4).alias("total"), (F.max("area") >= 112.5).alias("supported"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.hit, false) AS in_orders, coalesce(b.hit, false) AS in_events FROM (SELECT DISTINCT o_custkey AS k, true AS hit FROM orders) a FULL JOIN (SELECT DISTINCT user_id AS k, true AS hit FROM events) b ON a.k = b.k")
def c32_full_outer_flags(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(True).alias("in_orders")).distinct()
    b = table(spark, d, "events").select(F.col("user_id").alias("k"), F.lit(True).alias("in_events")).distinct()
    return a.join(b, "k", "full").fillna(False)


@query(f"WITH {POINTS}, a AS (SELECT id, lat, lon, label FROM points WHERE id % 2 = 0), b AS (SELECT id - 1 AS id, lat, lon, label FROM points WHERE id % 2 = 1) SELECT a.id, round({KM.format(a='a', b='b')}, 4) AS km, CASE WHEN a.label <> b.label THEN 'name' WHEN {KM.format(a='a', b='b')} > 5000 THEN 'far' ELSE 'matched' END AS status FROM a JOIN b USING (id)")
def c33_registry_match(spark, d):
    p = points(spark, d)
    a = p.where("id % 2 = 0").select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("label").alias("label1"))
    b = p.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), "lat", "lon", "label")
    km = S.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))
    return a.join(b, "id").withColumn("d", km).select("id", F.round("d", 4).alias("km"), F.when(F.col("label1") != F.col("label"), "name").when(F.col("d") > 5000, "far").otherwise("matched").alias("status"))


@query(f"WITH {PARTS_OF}, c AS (SELECT name, count(DISTINCT part % 40) AS n FROM keyed GROUP BY 1) SELECT part, CASE WHEN n = 1 THEN name END AS name, CASE WHEN n > 1 THEN 'claimed by several' END AS reason FROM keyed JOIN c USING (name)")
def c34_reverse_uniqueness(spark, d):
    k = _first_word(spark, d).withColumn("source", F.col("part") % 40)
    kept = J.with_own_key(k, "name", "source", "own")
    return kept.select("part", F.col("own").alias("name"), F.when(F.col("own").isNull(), "claimed by several").alias("reason"))


@query(f"WITH {EDGES}, {DIST}, c AS (SELECT o_orderkey AS consumer, c_nationkey AS unit FROM orders JOIN customer ON o_custkey = c_custkey) SELECT consumer, count(DISTINCT resource) AS shared FROM c JOIN edges USING (consumer) JOIN dist USING (resource, unit) GROUP BY 1")
def c35_event_site_overlap(spark, d):
    home = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("consumer"), F.col("c_nationkey").alias("unit"))
    return home.join(edges(spark, d), "consumer").join(distribution(spark, d), ["resource", "unit"]).groupBy("consumer").agg(F.count_distinct("resource").alias("shared"))


@query(f"WITH {GROUPS}, a AS (SELECT grp, avg(s_acctbal) AS near, count(*) AS n FROM supplier JOIN groups ON unit = s_nationkey GROUP BY 1), b AS (SELECT grp, avg(c_acctbal) AS far, count(*) AS n FROM customer JOIN groups ON unit = c_nationkey GROUP BY 1) SELECT grp, round(near - far, 4) AS difference, a.n::BIGINT AS near_n, b.n::BIGINT AS far_n FROM a JOIN b USING (grp) WHERE a.n >= 3 AND b.n >= 3")
def c36_two_sided_support(spark, d):
    g = unit_groups(spark, d)
    side = lambda t, unit, x, name: table(spark, d, t).join(g, F.col(unit) == F.col("unit")).groupBy("grp").agg(F.avg(x).alias(name), F.count("*").alias(name + "_n")).where(F.col(name + "_n") >= 3)
    return side("supplier", "s_nationkey", "s_acctbal", "near").join(side("customer", "c_nationkey", "c_acctbal", "far"), "grp").select("grp", F.round(F.col("near") - F.col("far"), 4).alias("difference"), "near_n", "far_n")
