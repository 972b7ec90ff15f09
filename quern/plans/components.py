"""Connected components of a graph that lives in a DataFrame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.salting import per_salt, salt_bits, salt_of
from quern.plans.staging import settle


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m, salts): the smallest v of each u, found per salt of v first, and the salts that u's edges have."""
    by_salt = edges.groupBy("u", "salt").agg(F.min("v").alias("m"))
    return by_salt.groupBy("u").agg(F.min("m").alias("m"), salt_bits("salt").alias("salts"))


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", salt_of("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _salted(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = _minima(both).select("u", F.least("u", "m").alias("m"), "salts")
    return both.where("v > u").join(per_salt(least, "salts"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _salted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = _minima(down)
    others = down.join(per_salt(least, "salts"), ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(u, v)``; root is the smallest node that it reaches.

    Alternating large-star and small-star steps: the edges shrink towards one
    star for each component in a number of rounds that grows with the
    logarithm of the size. Each round is a stage table. Self-loops and edges
    with a null end are left out. A hub's edges are dealt over salts of their
    other ends, so no task has to take all of them.
    """
    edges = settle(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        edges = settle(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
