"""Aggregates: counts, quantiles, contrasts and weighted moments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import exact_quantiles, value_counts
from quern.plans.staging import settle


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def quantiles(x: str, qs: dict[str, float]) -> list[Column]:
    """Exact quantiles with linear interpolation."""
    return [r6(F.percentile(F.col(x), F.lit(q))).alias(name) for name, q in qs.items()]


def summarised(df: DataFrame, by: list[str], aggregates: list[Column], of: dict[str, dict[str, float]]) -> DataFrame:
    """The aggregates of each group and, for each column x of ``of``, its exact quantiles, which no task gathers a group for.

    Rows with a NULL in ``by`` are left out.
    """
    df = df.dropna(subset=by)
    out = df.groupBy(*by).agg(*aggregates)
    for x, qs in of.items():
        found = exact_quantiles(df, by, x, qs)
        out = out.join(found.select(*by, *[r6(F.col(name)).alias(name) for name in qs]), by, "left")
    return out


def described(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Smallest, quartile-like, largest and mean value of each group."""
    return summarised(df, by, [r6(F.min(x)).alias("least"), r6(F.max(x)).alias("largest"), r6(F.avg(x)).alias("mean")], {x: {"q025": 0.025, "median": 0.5, "q975": 0.975}})


def lower_quantile(df: DataFrame, by: list[str], x: str, q: float) -> DataFrame:
    """The value at place floor(q * (n - 1)) of the sorted values; NULLs are left out."""
    counts = settle(value_counts(df, by, x))
    placed = counts.join(counts.groupBy(*by).agg(F.sum("n").alias("_all")), by)
    place = F.floor(F.lit(q) * (F.col("_all") - 1))
    return placed.where((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select(*by, F.col(x).alias("lower_quantile"))


def weighted_mean(x: Column, w: Column) -> Column:
    return ratio(F.sum(x * w), F.sum(w))


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Weighted correlation from sums; NULL where one side does not vary."""
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov, vx, vy = F.sum(w * x * y) / n - mx * my, F.sum(w * x * x) / n - mx * mx, F.sum(w * y * y) / n - my * my
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.when(vx > 1e-12, vx) * F.when(vy > 1e-12, vy)))


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], x: str) -> DataFrame:
    """Each inner group counts once in its outer group's mean."""
    return df.groupBy(*outer, *inner).agg(F.avg(x).alias("_m")).groupBy(*outer).agg(r6(F.avg("_m")).alias("mean_of_means"))


def with_others(df: DataFrame, by: list[str], x: str, new: str) -> DataFrame:
    """``df`` with the sum of x over the rest of the row's group; rows with a NULL in ``by`` are left out."""
    return df.join(df.groupBy(*by).agg(F.sum(x).alias("_all")), by).withColumn(new, F.col("_all") - F.col(x)).drop("_all")


def block_contrast(df: DataFrame, block: str, arm: Column, x: str) -> DataFrame:
    """Over blocks that have both arms: the mean difference, weighted by the smaller arm, and the signs of the blocks' differences."""
    sides = df.groupBy(block).agg(F.avg(F.when(arm, F.col(x))).alias("a"), F.avg(F.when(~arm, F.col(x))).alias("b"), F.count_if(arm).alias("na"), F.count_if(~arm).alias("nb"))
    both = sides.where("na > 0 and nb > 0").select((F.col("a") - F.col("b")).alias("d"), F.least("na", "nb").alias("w"))
    return both.agg(F.count(F.lit(1)).alias("blocks"), r6(F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("weighted"), r6(F.avg("d")).alias("plain"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("level"))
