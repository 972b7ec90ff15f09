"""Graphs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import models as M
from quern.operators import space
from quern.operators.aggregates import r6
from quern.operators.ranks import whole_quantiles
from quern.plans.components import components
from quern.plans.registry import query
from quern.plans.salting import spread_join
from quern.plans.staging import settle
from quern.sources.relations import DIST, POINTS, incidence, points
from quern.sources.tables import table

LINKS = "links AS (SELECT DISTINCT p_partkey AS u, p_partkey - p_partkey % 10 + p_size % 10 AS v FROM part)"


def _links(spark, d):
    """Each part is linked to one of its ten, so a component has ten parts at most."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.cast("long").alias("u"), (k - k % 10 + F.col("p_size") % 10).cast("long").alias("v")).distinct()


@query(f"WITH RECURSIVE {LINKS}, sym AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v), reach AS (SELECT u AS node, u AS root FROM sym UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node WHERE r.root < s.v) SELECT node, min(root) AS root FROM reach GROUP BY 1")
def l01_connected_components(spark, d):
    return components(_links(spark, d))


#: Cells of 15 degrees by the number n of points in them; those with a multiple of four count as closed.
GRID = f"{POINTS}, cells AS (SELECT floor((lon + 180) / 15)::BIGINT AS x, floor((lat + 90) / 15)::BIGINT AS y, count(*) AS n FROM points GROUP BY 1, 2 HAVING count(*) % 4 <> 0)"


def _cells(spark, d):
    p = points(spark, d).select(F.floor((F.col("lon") + 180) / 15).alias("x"), F.floor((F.col("lat") + 90) / 15).alias("y"))
    return p.groupBy("x", "y").agg(F.count("*").alias("n")).where("n % 4 <> 0")


@query(f"WITH RECURSIVE {GRID}, c AS (SELECT y * 24 + x AS id, x, y FROM cells), near AS (SELECT a.id AS u, b.id AS v, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS yb FROM c a JOIN c b ON ((b.x - a.x + 24) % 24 IN (0, 1, 23) AND abs(a.y - b.y) <= 1 AND a.id <> b.id)), sym AS (SELECT u, v FROM near WHERE ax = bx OR ay = yb OR (EXISTS (SELECT 1 FROM cells WHERE x = bx AND y = ay) AND EXISTS (SELECT 1 FROM cells WHERE x = ax AND y = yb))), reach AS (SELECT id AS node, id AS root FROM c UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node WHERE r.root < s.v) SELECT node, min(root) AS root FROM reach GROUP BY 1")
def l02_grid_components(spark, d):
    """Eight neighbours, but none through a corner that a missing cell closes; columns wrap."""
    return G.grid_components(_cells(spark, d), 24, corners=True)


@query(f"WITH RECURSIVE {GRID}, b AS (SELECT y * 24 + x AS id, x, y, (y // 3) * 8 + x // 3 AS block FROM cells), sym AS (SELECT a.id AS u, c.id AS v FROM b a JOIN b c ON a.block = c.block AND abs(a.x - c.x) + abs(a.y - c.y) = 1), reach AS (SELECT id AS node, id AS root FROM b UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node WHERE r.root < s.v), n AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY 1), p AS (SELECT n1.root AS p, n2.root AS q FROM b a JOIN b c ON a.block <> c.block AND ((a.y = c.y AND c.x = (a.x + 1) % 24) OR (a.x = c.x AND c.y = a.y + 1)) JOIN n n1 ON n1.id = a.id JOIN n n2 ON n2.id = c.id) SELECT least(p, q) AS lo, greatest(p, q) AS hi, count(*)::BIGINT AS contacts FROM p GROUP BY 1, 2")
def l03_coarsened_contacts(spark, d):
    return G.coarsened(_cells(spark, d), 3, 24)[1]


@query()
def l04_minimum_spanning_tree(spark, d):
    """One tree per label over the points within 6000 km of one another."""
    return G.spanning_forest_within(points(spark, d), 6000.0, "label")


KM_OF = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lon) - radians(p.lon)) / 2), 2))))"


@query(f"""WITH RECURSIVE p AS (SELECT n_nationkey AS id, (n_nationkey * 37 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 91 % 340 - 170)::DOUBLE AS lon FROM nation), e AS (SELECT p.id AS a, q.id AS b, {KM_OF} AS d FROM p JOIN p q ON p.id < q.id), o AS (SELECT *, row_number() OVER (ORDER BY d, a, b) AS r FROM e), s AS (SELECT r, a, b FROM o UNION ALL SELECT r, b, a FROM o),
reach AS (SELECT r, a AS node FROM o UNION SELECT x.r, s.b FROM reach x JOIN s ON s.a = x.node AND s.r < x.r), tree AS (SELECT a, b, d FROM o WHERE (r, b) NOT IN (SELECT (r, node) FROM reach)),
k AS (SELECT least(a, b) AS a, greatest(a, b) AS b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM (SELECT a, b, d FROM e UNION ALL SELECT b, a, d FROM e)) WHERE n <= 3), u AS (SELECT a, b, 1 / (d / 1000) AS w FROM (SELECT a, b, d FROM k UNION SELECT a, b, d FROM tree)), t AS (SELECT a, w FROM u UNION ALL SELECT b, w FROM u)
SELECT a AS i, a AS j, round(sum(w), 6) AS value FROM t GROUP BY 1 UNION ALL SELECT a, b, round(-w, 6) FROM u UNION ALL SELECT b, a, round(-w, 6) FROM u""")
def l05_knn_laplacian(spark, d):
    """Three nearest neighbours and the spanning tree of 25 places, one a nation."""
    k = F.col("n_nationkey")
    p = table(spark, d, "nation").select(k.alias("id"), (k * 37 % 120 - 60).cast("double").alias("lat"), (k * 91 % 340 - 170).cast("double").alias("lon"))
    a, b = (p.select(F.col("id").alias(n), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}")) for n in ("a", "b"))
    e = a.join(b, F.col("a") < F.col("b")).select("a", "b", space.haversine_km(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb")).alias("d"))  # all pairs of nations
    return G.nearest_and_tree(settle(e), 3, 1.0).select("i", "j", r6("value").alias("value"))


@query()
def l06_effective_resistance(spark, d):
    """Between all pairs of a group's nodes, in a ring of its nations: all groups in one solve."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("k"))
    w = Window.partitionBy("g").orderBy("k")
    ring = n.select("g", F.col("k").alias("a"), F.coalesce(F.lead("k").over(w), F.first("k").over(w)).alias("b")).where("a <> b").withColumn("w", F.lit(1.0))
    return G.resistances(ring, "g")


@query()
def l07_terminal_resistance(spark, d):
    """Between all labels, whose current enters at the cells of their points, over cells of 30 degrees that conduct by their points."""
    cell = lambda c: (F.floor((F.col("lat") + 90) / 30) * 12 + F.floor((F.col("lon") + 180) / 30)).alias(c)
    p = points(spark, d).where("label is not null").select("label", cell("node"))
    n = p.groupBy("node").agg(F.count("*").alias("n"))
    places = n.select((F.col("node") % 12).alias("x"), F.floor(F.col("node") / 12).alias("y"), "n")
    name = lambda k: F.col(f"y{k}") * 12 + F.col(f"x{k}")
    edges = settle(G.grid_edges(places, ["n"], 12).select(name(1).alias("a"), name(2).alias("b"), (2 / (1 / F.col("n1") + 1 / F.col("n2"))).alias("w")))
    main = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    largest = main.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1)
    ports = p.join(main.join(largest, "root", "left_semi"), "node").groupBy(F.col("label").alias("site"), "node").agg(F.count("*").alias("m"))
    share = F.col("m") / F.sum("m").over(Window.partitionBy("site"))  # of a label's cells
    return G.site_resistances(edges, ports.select("site", "node", share.alias("weight")))


@query(f"""WITH {GRID}, c AS (SELECT x, y, n::DOUBLE AS k, -82.5::DOUBLE + 15 * y AS lat, -172.5::DOUBLE + 15 * x AS lon FROM cells), e AS (SELECT p.y = q.y AS along, p.k AS ka, q.k AS kb, p.lat AS lat, {KM_OF} AS km, 6371.0088 * radians(15) * CASE WHEN p.y = q.y THEN 1.0 ELSE cos(radians((p.lat + q.lat) / 2)) END AS face FROM c p JOIN c q ON (p.y = q.y AND q.x = p.x + 1) OR (p.x = q.x AND q.y = p.y + 1))
SELECT along, lat, count(*)::BIGINT AS edges, round(sum(2 / (1 / ka + 1 / kb) / km * face), 6) AS conductance, round(avg(km), 6) AS km FROM e GROUP BY 1, 2""")
def l08_edge_conductance(spark, d):
    cells = _cells(spark, d).withColumns({"k": F.col("n").cast("double"), "lat": F.lit(-82.5) + 15 * F.col("y"), "lon": F.lit(-172.5) + 15 * F.col("x")})
    e = G.grid_edges(cells, ["k", "lat", "lon"])
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    face = space.EARTH_KM * F.radians(F.lit(15.0)) * F.when(F.col("along"), 1.0).otherwise(F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2)))
    found = e.select("along", F.col("lat1").alias("lat"), (G.edge_conductance(F.col("k1"), F.col("k2"), *ends) * face).alias("g"), space.haversine_km(*ends).alias("km"))
    return found.groupBy("along", "lat").agg(F.count("*").alias("edges"), r6(F.sum("g")).alias("conductance"), r6(F.avg("km")).alias("km"))


@query("WITH p AS (SELECT s_nationkey AS site, s_suppkey % 11 AS node, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT site, node, round(sum(1.0 / n), 6) AS weight FROM p GROUP BY 1, 2")
def l09_terminal_weights(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_nationkey").alias("site"), (F.col("s_suppkey") % 11).alias("node"))
    return p.withColumn("share", 1 / F.count("*").over(Window.partitionBy("site"))).groupBy("site", "node").agg(r6(F.sum("share")).alias("weight"))


@query("WITH r AS (SELECT s_suppkey, abs(s_acctbal) AS r FROM supplier), m AS (SELECT quantile_cont(r, 0.5) AS m FROM r WHERE r > 0) SELECT s_suppkey, round(ln(1 + r / m), 6) AS feature FROM r, m")
def l10_resistance_feature(spark, d):
    r = table(spark, d, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("r"))
    m = F.broadcast(whole_quantiles(r.where("r > 0"), "r", {"m": 0.5}))  # one row
    return r.crossJoin(m).select("s_suppkey", r6(F.log1p(F.col("r") / F.col("m"))).alias("feature"))


@query(f"WITH {LINKS}, d AS (SELECT u AS node FROM links UNION ALL SELECT v FROM links), n AS (SELECT node, count(*) AS n FROM d GROUP BY 1) SELECT n::BIGINT AS degree, count(*)::BIGINT AS nodes FROM n GROUP BY 1")
def l11_degree_classes(spark, d):
    links = _links(spark, d)
    ends = links.select(F.col("u").alias("node")).union(links.select("v"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"WITH {DIST} SELECT x.unit AS a, y.unit AS b, count(*)::BIGINT AS shared FROM dist x JOIN dist y ON x.resource = y.resource AND x.unit < y.unit GROUP BY 1, 2")
def l12_bipartite_projection(spark, d):
    from quern.operators.sets import shared_counts

    return shared_counts(incidence(spark, d), "unit", "resource")


@query("""WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, abs(a.s_acctbal - b.s_acctbal) / 1000 AS x, ((a.s_suppkey * 7 + b.s_suppkey * 3) % 11) + abs(a.s_acctbal - b.s_acctbal) / 2000 AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
n AS (SELECT DISTINCT s_suppkey AS node FROM supplier), f AS (SELECT node, covar_pop(x, y) / var_pop(x) AS s, avg(x) AS mx, avg(y) AS my FROM n JOIN p ON a <> node AND b <> node GROUP BY 1) SELECT node, count(*)::BIGINT AS pairs, round(avg(pow(y - (my + s * (x - mx)), 2)), 5) AS mse FROM f JOIN p ON a = node OR b = node GROUP BY 1""")
def k01_leave_one_node_out(spark, d):
    s = table(spark, d, "supplier")
    side = lambda k: s.select("s_nationkey", F.col("s_suppkey").alias(k), F.col("s_acctbal").alias("x" + k))
    gap = F.abs(F.col("xa") - F.col("xb"))
    p = spread_join(side("a"), side("b"), ["s_nationkey"], "a", "b").where("a < b").select("a", "b", (gap / 1000).alias("x"), ((F.col("a") * 7 + F.col("b") * 3) % 11 + gap / 2000).alias("y"))
    return M.leave_node_out_mse(p.select(F.explode(F.array("a", "b")).alias("node"), "x", "y"), p, "node", "x", "y").select("node", "pairs", F.round("mse", 5).alias("mse"))
