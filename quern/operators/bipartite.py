"""Footprints of consumers over a resource-unit relation, and who is to be credited for their growth."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import value_counts
from quern.plans.staging import settle


def _held(dist: DataFrame) -> DataFrame:
    """(resource, held): a resource's units, as an array, so that a join copies none of its rows."""
    return dist.groupBy("resource").agg(F.collect_list(F.struct("unit", "native")).alias("held"))


def footprints(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(consumer, unit, native): the units of all of a consumer's resources; native if some resource is native there."""
    reach = edges.join(_held(dist), "resource").select("consumer", F.inline("held"))
    return reach.groupBy("consumer", "unit").agg(F.bool_or("native").alias("native"))


def union_footprints(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(consumer, units, resources, mapped_resources): how many different ones each consumer has; mapped are those with a unit.

    The edges are distinct, so an edge is counted at the first of its units
    and no set of resources is needed.
    """
    reach = edges.join(_held(dist.where("unit is not null")), "resource", "left").select("consumer", "resource", F.posexplode_outer("held").alias("_at", "_unit"))
    first = F.coalesce("_at", F.lit(0)) == 0
    cells = reach.groupBy("consumer", F.col("_unit.unit").alias("unit")).agg(F.count_if(first & F.col("resource").isNotNull()).alias("resources"), F.count_if(first & F.col("_at").isNotNull()).alias("mapped"))
    return cells.groupBy("consumer").agg(F.count("unit").alias("units"), F.sum("resources").alias("resources"), F.sum("mapped").alias("mapped_resources"))


def footprint_counts(foot: DataFrame) -> DataFrame:
    """Native, contemporary and added units of each consumer, and the logarithm of its growth; NULL where none is native."""
    counts = foot.groupBy("consumer").agg(F.count_if("native").alias("native_units"), F.count(F.lit(1)).alias("units"))
    grown = F.when(F.col("native_units") > 0, F.round(F.log1p("units") - F.log1p("native_units"), 6))
    return counts.withColumn("added_units", F.col("units") - F.col("native_units")).withColumn("log_growth", grown)


def added_sources(edges: DataFrame, dist: DataFrame, level: str = "resource") -> DataFrame:
    """(consumer, unit, level) of each resource, or each group of resources, behind a unit that is not native to the consumer."""
    reach = edges.join(dist, "resource").withColumn("had", F.bool_or("native").over(Window.partitionBy("consumer", "unit")))
    return reach.where(~F.col("had")).select("consumer", "unit", level).distinct()


def fractional_credit(sources: DataFrame, level: str = "resource") -> DataFrame:
    """Each added unit is split evenly over its sources: (consumer, level, credit), summing to the added units."""
    share = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("consumer", "unit"))
    return sources.withColumn("share", share).groupBy("consumer", level).agg(F.sum("share").alias("credit"))


def concentration(credit: DataFrame, by: list[str], value: str = "credit") -> DataFrame:
    """Total, largest and two largest shares, effective number and Herfindahl index of ``value`` within ``by``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value)))
    total = F.sum(value)
    ranked = credit.withColumn("_r", rank)
    return ranked.groupBy(*by).agg(
        F.round(total, 6).alias("total"),
        F.round(F.max(value) / total, 6).alias("max_share"),
        F.round(F.sum(F.when(F.col("_r") <= 2, F.col(value))) / total, 6).alias("top2_share"),
        F.round(F.sum(F.col(value) * F.col(value)) / (total * total), 6).alias("hhi"),
        F.round(total * total / F.sum(F.col(value) * F.col(value)), 6).alias("effective_number"),
    )


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini index of the positive values within ``by``, from how often each value occurs: equal ones share their places."""
    counts = value_counts(df.where(F.col(value) > 0), by, value)
    n, total = F.sum("n"), F.sum(F.col("n") * F.col(value))
    places = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    return counts.groupBy(*by).agg(F.round(2 * F.sum(places * F.col(value)) / (n * total) - (n + 1) / n, 6).alias("gini"))


def half_count(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """How many of the largest values, which are not negative, reach half of the total.

    Sums of the smaller values tell at which value the half is reached; the
    larger ones are counted, and of that one as many as it takes. The values
    are settled first: sums of doubles differ in their last digits each time
    they are computed, and a value would not be found among others of its own.
    """
    df = settle(df.select(*by, value))
    held = settle(value_counts(df, by, value, value))
    totals = held.groupBy(*by).agg(F.sum("n").alias("_all"))
    half = 0.5 * F.col("_all") - F.lit(1e-9)
    reached = held.join(totals, by).where(F.col("_all") - F.col("before") >= half)
    last = reached.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), "n", "before", "_all")).alias("_at")).select(*by, F.col("_at.v").alias("_v"), (F.col("_at._all") - F.col("_at.before") - F.col("_at.n")).alias("_above"), F.col("_at._all").alias("_all"))
    larger = df.join(last, by).groupBy(*by, "_v", "_above", "_all").agg(F.count_if(F.col(value) > F.col("_v")).alias("_larger"))
    needed = F.greatest(F.lit(1), F.ceil(F.try_divide(half - F.col("_above"), F.col("_v"))))
    return larger.select(*by, (F.col("_larger") + needed).cast("long").alias("half_count"))


def top_share(df: DataFrame, value: str, key: str, tops: list[int]) -> DataFrame:
    """(k, share): what part of the total the k largest values hold."""
    largest = df.orderBy(F.desc(value), key).limit(max(tops))
    ranked = largest.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(value), key)))  # of max(tops) rows
    total = df.agg(F.sum(value).alias("_all"))
    wide = ranked.crossJoin(F.broadcast(total)).agg(*[F.round(F.sum(F.when(F.col("_r") <= k, F.col(value))) / F.max("_all"), 6).alias(str(k)) for k in tops])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(str(k)).alias("share")) for k in tops])).alias("x")).select("x.*")


def mode(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """The commonest key, the smallest of equal ones, and its share."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*by).orderBy(F.desc("n"), key)
    ranked = counts.withColumn("_r", F.row_number().over(best)).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))
    return ranked.where("_r = 1").drop("_r")


def banded(breadth: Column) -> Column:
    """1, 2, 3-5 or 6+; fails on anything less than 1."""
    return F.when(breadth == 1, "1").when(breadth == 2, "2").when(breadth.between(3, 5), "3-5").when(breadth >= 6, "6+").otherwise(F.raise_error(F.lit("breadth must be at least 1")))
