"""The relations that the queries run on, derived from the driver's tables.

Orders are consumers, parts resources, supplier nations units. A part belongs
to a unit natively if first shipped from it before NATIVE, and at all if
before CONTEMPORARY.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table

NATIVE, CONTEMPORARY = "1995-07-01", "1996-01-01"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(consumer, resource), distinct."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("consumer"), F.col("l_partkey").alias("resource")).distinct()


def distribution(spark: SparkSession, d: str) -> DataFrame:
    """(resource, unit, native), one row per pair."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    shipped = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    first = shipped.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("resource"), F.col("s_nationkey").alias("unit")).agg(F.min("l_shipdate").alias("first"))
    return first.where(F.col("first") < F.lit(CONTEMPORARY).cast("timestamp")).select("resource", "unit", (F.col("first") < F.lit(NATIVE).cast("timestamp")).alias("native"))


def taxa(spark: SparkSession, d: str) -> DataFrame:
    """(resource, family, genus)."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("resource"), F.col("p_brand").alias("family"), F.col("p_type").alias("genus"))


def unit_groups(spark: SparkSession, d: str) -> DataFrame:
    """(unit, grp): a nation's region."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("grp"))


def incidence(spark: SparkSession, d: str) -> DataFrame:
    """(unit, resource), distinct: the community of each nation."""
    return distribution(spark, d).select("unit", "resource")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """(species, dataset, day, week, value, event_id, ts) of the event stream."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("species"), F.col("user_id").alias("dataset"), F.to_date("ts").alias("day"), F.weekofyear("ts").alias("week"), "value", "event_id", "ts")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, lat, lon, label): pseudo-coordinates from the first two components of an embedding."""
    e = table(spark, d, "embeddings")
    squash = lambda i, half: F.round(F.lit(half) * F.sin(F.col("embedding")[i].cast("double") * 3), 6)
    return e.select(F.col("vec_id").alias("id"), squash(0, 80.0).alias("lat"), squash(1, 170.0).alias("lon"), "label")


#: The same relations as DuckDB CTEs.
EDGES = "edges AS (SELECT DISTINCT l_orderkey AS consumer, l_partkey AS resource FROM lineitem)"
DIST = f"""dist AS (SELECT l_partkey AS resource, s_nationkey AS unit, min(l_shipdate) < TIMESTAMP '{NATIVE}' AS native
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING min(l_shipdate) < TIMESTAMP '{CONTEMPORARY}')"""
FOOT = "foot AS (SELECT consumer, unit, bool_or(native) AS native FROM edges JOIN dist USING (resource) GROUP BY 1, 2)"
TAXA = "taxa AS (SELECT p_partkey AS resource, p_brand AS family, p_type AS genus FROM part)"
GROUPS = "groups AS (SELECT n_nationkey AS unit, n_regionkey AS grp FROM nation)"
OBS = "obs AS (SELECT event_type AS species, user_id AS dataset, CAST(ts AS DATE) AS day, CAST(weekofyear(ts) AS INTEGER) AS week, value, event_id, ts FROM events)"
POINTS = "points AS (SELECT vec_id AS id, round(80.0 * sin(embedding[1]::DOUBLE * 3), 6) AS lat, round(170.0 * sin(embedding[2]::DOUBLE * 3), 6) AS lon, label FROM embeddings)"
