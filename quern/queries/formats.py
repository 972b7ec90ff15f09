"""Rings, grids, remote sources, sinks, the ellipsoid and fold-wise scaling."""

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import ellipsoid
from quern.operators.aggregates import r6
from quern.operators.rings import untangled
from quern.plans.registry import query
from quern.plans.staging import stage_path
from quern.sources import files, remote
from quern.sources.grids import grid_cells
from quern.sources.relations import POINTS, points
from quern.sources.tables import table


@query("SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 2 THEN 1 ELSE 0 END AS removed, n_nationkey % 3 = 0 AS closed, n_nationkey % 3 = 1 AS reversed, 2.0::DOUBLE AS area, 5 AS corners FROM nation")
def a08_ring_repair(spark, d):
    """Rings that are left open, run clockwise or repeat a vertex, by the key's remainder."""
    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.array(k + x, F.lit(float(y)))
    ring = lambda *c: F.array(*[corner(*p) for p in c])
    raw = F.when(k % 3 == 0, ring((0, 0), (2, 0), (2, 1), (0, 1))).when(k % 3 == 1, ring((0, 0), (0, 1), (2, 1), (2, 0), (0, 0))).otherwise(ring((0, 0), (2, 0), (2, 0), (2, 1), (0, 1), (0, 0)))
    fixed = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ellipsoid.ring_in_order(raw).alias("r"))
    return fixed.select("k", "r.removed", "r.closed", "r.reversed", "r.area", F.size("r.ring").alias("corners"))


#: Even-odd and winding areas of a pentagram in the unit circle: its star less, or plus, the pentagon within, whose radius is cos 72 / cos 36.
_STAR, _PENTAGON = "5 * sin(pi() / 5) * cos(2 * pi() / 5) / cos(pi() / 5)", "2.5 * sin(2 * pi() / 5) * (cos(2 * pi() / 5) / cos(pi() / 5)) ** 2"


@query(f"""WITH {POINTS}, s AS (SELECT label AS code, stddev_pop(lon) * stddev_pop(lat) AS sxy FROM points GROUP BY 1), a AS (SELECT code, sxy * ({_STAR} - {_PENTAGON}) AS area, sxy * ({_STAR} + {_PENTAGON}) AS source FROM s WHERE sxy > 0)
SELECT code, 5::BIGINT AS crossings, 5::BIGINT AS rings, 0::BIGINT AS holes, round(source, 6) AS source_area, round(area, 6) AS area, round(abs(area - source) / source, 6) AS change FROM a""")
def a08_ring_untangling(spark, d):
    """Each label's pentagram about the middle of its points, as wide and high as they spread: five triangles and no pentagon."""
    spread = points(spark, d).groupBy(F.col("label").alias("code")).agg(*[f(c).alias(f"{n}{c}") for c in ("lon", "lat") for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    spread = spread.where("slon > 0 AND slat > 0")
    corner = lambda k: f"mlon + slon * cos({k} * 4 * pi() / 5) AS x{{0}}, mlat + slat * sin({k} * 4 * pi() / 5) AS y{{0}}"
    sides = ", ".join(f"struct({corner(k).format(1)}, {corner((k + 1) % 5).format(2)})" for k in range(5))
    edges = spread.selectExpr("code", "0 AS ring", f"inline(array({sides}))")
    audit = untangled(edges)[1]
    return audit.select("code", "crossings", "rings", "holes", *[r6(c).alias(c) for c in ("source_area", "area", "change")])


@F.pandas_udf(T.BinaryType())
def _archive(key: pd.Series) -> pd.Series:
    def packed(k: int) -> bytes:
        y, x = np.indices((3, 4))
        out = io.BytesIO()
        np.savez(out, depth=k + 10 * x + y, flow=np.where((x + y) % 3 == 0, np.nan, k * x))
        return out.getvalue()

    return key.map(packed)


@query("SELECT n_nationkey::VARCHAR AS file, y::BIGINT AS y, x::BIGINT AS x, (n_nationkey + 10 * x + y)::DOUBLE AS depth, CASE WHEN (x + y) % 3 <> 0 THEN (n_nationkey * x)::DOUBLE END AS flow FROM nation, (SELECT unnest(range(4)) AS x), (SELECT unnest(range(3)) AS y)")
def a13_grid_archives(spark, d):
    archives = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file"), _archive("n_nationkey").alias("content"))
    return grid_cells(archives, ["depth", "flow"])


@query("SELECT c_custkey AS k, (c_custkey * c_custkey % 97)::BIGINT AS v FROM customer WHERE c_custkey < (SELECT count(*) FROM customer)")
def a18_paged_source(spark, d):
    """What an index with an entry for each customer holds under the customers' keys."""
    spark.dataSource.register(remote.PagedIndex)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    options = {"fetch": "quern.sources.remote:squares", "total": customers.count(), "page": 1000}
    return customers.join(spark.read.format("pagedindex").schema("k long, v long").options(**options).load(), "k")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders")
def a24_sorted_csv_sink(spark, d):
    path = stage_path(spark)
    files.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, ["o_orderkey"])
    return files.read_csv(spark, path, ["o_orderkey", "o_orderpriority"])


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def a25_gzip_csv_sink(spark, d):
    path = stage_path(spark)
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, ["c_custkey"], compression="gzip")
    return files.read_csv(spark, path, ["c_custkey", "c_mktsegment"])


def name_code(name: str) -> int:
    """A lookup that needs no network, for tests."""
    return 1000 * len(name) + 128 * ord(name[0]) + ord(name[-1])


@query("WITH f AS (SELECT DISTINCT c_name AS name, 1000 * length(c_name) + 128 * ascii(c_name) + ascii(right(c_name, 1)) + 0 AS key FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY key) AS claims FROM f) SELECT name, CASE WHEN claims = 1 THEN key END::BIGINT AS key FROM n")
def a30_lookups(spark, d):
    return remote.looked_up(table(spark, d, "customer").select(F.col("c_name").alias("name")), "name", name_code)


def _zone_sql(lat: str) -> str:
    s, e = f"sin(radians({lat}))", f"{ellipsoid.ECCENTRICITY!r}::DOUBLE"
    return f"({s} / (1 - {e} * {e} * {s} * {s}) + ln((1 + {e} * {s}) / (1 - {e} * {s})) / (2 * {e}))"


@query(f"WITH {POINTS}, c AS (SELECT id, floor(lat / 5) * 5 AS south FROM points) SELECT id, round({ellipsoid.POLAR * ellipsoid.POLAR / 2e6!r}::DOUBLE * radians(5) * ({_zone_sql('(south + 5)')} - {_zone_sql('south')}), 3) AS area FROM c")
def h21_ellipsoid_cell_area(spark, d):
    p = points(spark, d).select("id", (F.floor(F.col("lat") / 5) * 5).alias("south"))
    return p.select("id", F.round(ellipsoid.cell_area(F.col("south"), F.col("south") + 5, F.lit(5.0)), 3).alias("area"))


@query()
def h21_geodesic_distance(spark, d):
    """Metres from each point to the one with the next id; the solution is iterative."""
    p = points(spark, d).select("id", "lat", "lon")
    q = p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, "id").select("id", F.round(ellipsoid.geodesic("lat", "lon", "lat2", "lon2"), 3).alias("metres"))


@query("WITH o AS (SELECT o_orderkey, o_totalprice AS v, o_orderkey % 5 AS fold FROM orders), t AS (SELECT f.fold, avg(o.v) AS m, stddev_pop(o.v) AS s FROM (SELECT unnest(range(5)) AS fold) f JOIN o ON o.fold <> f.fold GROUP BY 1) SELECT o_orderkey, o.fold AS fold, round((v - m) / s, 6) AS scaled FROM o JOIN t USING (fold)")
def k10_fold_scaler(spark, d):
    """Each fold is scaled by the mean and spread of the other folds."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 5).alias("fold"))
    others = F.explode(F.expr("filter(sequence(0L, 4L), f -> f <> fold)"))
    trained = o.withColumn("fold", others).groupBy("fold").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return o.join(F.broadcast(trained), "fold").select("o_orderkey", "fold", F.round((F.col("v") - F.col("m")) / F.col("s"), 6).alias("scaled"))  # a row for each of five folds
