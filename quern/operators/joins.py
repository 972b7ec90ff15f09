"""Joins with contracts on their cardinality, and joins on names, intervals and time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", contract: str = "m:1") -> DataFrame:
    """An equi-join that fails while it runs if a side that the contract holds to one row per key has more.

    The check is a count over the key's partition, so it needs no pass of its own.
    """

    def single(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*on))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} side of a {contract} join repeats a key")).cast("boolean")).otherwise(True)).drop("_n")

    ones = contract.split(":")
    return (single(left, "left") if ones[0] == "1" else left).join(single(right, "right") if ones[1] == "1" else right, on, how)


def unordered_pairs(df: DataFrame, key: str, within: list[str]) -> DataFrame:
    """(within, a, b) with a < b of keys that share ``within``."""
    a, b = df.select(*within, F.col(key).alias("a")), df.select(*within, F.col(key).alias("b"))
    return a.join(b, within).where("a < b")


def unique_match(left: DataFrame, right: DataFrame, key: str, ident: str) -> DataFrame:
    """``left`` with outcome matched, ambiguous or unmatched, and the ident if there is exactly one."""
    ids = right.groupBy(key).agg(F.count_distinct(ident).alias("_n"), F.min(ident).alias(ident))
    joined = left.join(ids, key, "left")
    outcome = F.when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched")
    return joined.withColumn("outcome", outcome).withColumn(ident, F.when(F.col("_n") == 1, F.col(ident))).drop("_n")


def mutually_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of keys that occur once on either side."""
    once = lambda df: df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key), key, "left_semi")
    return once(left).join(once(right), key)


def with_own_key(df: DataFrame, key: str, source: str, new: str) -> DataFrame:
    """``df`` with the key as ``new``, or NULL where more than one source claims it."""
    claims = df.groupBy(key).agg(F.min(source).alias("_least"), F.max(source).alias("_most"))
    return df.join(claims, key, "left").withColumn(new, F.when(F.col("_least") == F.col("_most"), F.col(key))).drop("_least", "_most")


def latest_before(df: DataFrame, key: str, ticks: str, value: str, new: str, width: int) -> DataFrame:
    """``df`` with the largest ``value`` among the key's rows of smaller ``ticks``, a whole number; NULL if there is none or the key is NULL.

    Time is cut into spans of ``width`` ticks. A window looks back within a
    span, and what came before it is carried over from the spans' maxima, so
    a key's history is sorted span by span and not in one task.
    """
    cut = df.withColumn("_span", F.floor(F.col(ticks) / width))
    spans = cut.groupBy(key, "_span").agg(F.max(value).alias("_most"))
    earlier = F.max("_most").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(key, "_span", earlier.alias("_carried"))
    within = F.max(value).over(Window.partitionBy(key, "_span").orderBy(ticks).rangeBetween(Window.unboundedPreceding, -1))
    found = cut.withColumn("_within", within).join(carried, [key, "_span"], "left")
    return found.withColumn(new, F.when(F.col(key).isNotNull(), F.greatest("_within", "_carried"))).drop("_span", "_within", "_carried")


def lag_class(lower_a: Column, upper_a: Column, lower_b: Column, upper_b: Column) -> Column:
    """Whether interval b surely follows a, surely precedes it, or may do either."""
    return F.when(lower_b > upper_a, "after").when(upper_b < lower_a, "before").otherwise("undecided")
