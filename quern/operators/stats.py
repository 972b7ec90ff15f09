"""Correlations, regressions and exact tests in closed form."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.aggregates import ratio
from quern.operators.ranks import with_average_ranks


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """(n, lf): the natural logarithms of 0! to n!, as prefix sums; n is a parameter of a test, so small."""
    terms = spark.range(n + 1).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.log(F.greatest(F.col("id"), F.lit(1)).cast("double"))).otherwise(0.0).alias("t"))
    return terms.select("n", F.sum("t").over(Window.orderBy("n")).alias("lf"))


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation as an aggregate; NULL below ``least`` rows or where a side does not vary."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count("*") >= least) & (sx > 1.5e-8) & (sy > 1.5e-8), F.try_divide(F.covar_pop(x, y), sx * sy))


def weighted_pearson(x: str, y: str, weight: str) -> Column:
    """Correlation as an aggregate of rows that count ``weight`` times; NULL where a side does not vary."""
    mean = lambda e: F.sum(F.col(weight) * e) / F.sum(weight)
    part = lambda a, b: mean(F.col(a) * F.col(b)) - mean(F.col(a)) * mean(F.col(b))
    varies = (part(x, x) > 1e-9) & (part(y, y) > 1e-9)
    return F.when(varies, F.try_divide(part(x, y), F.sqrt(part(x, x) * part(y, y))))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = with_average_ranks(df.select(*by, x, y), by, {"_x": x, "_y": y})
    return ranked.groupBy(*by).agg(pearson("_x", "_y").alias("rho"))


def partial_spearman(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """Correlation of the ranks of x and y with the ranks of z taken out of both."""
    ranked = with_average_ranks(df.select(*by, x, y, z), by, {"_x": x, "_y": y, "_z": z})
    r = ranked.groupBy(*by).agg(pearson("_x", "_y").alias("xy"), pearson("_x", "_z").alias("xz"), pearson("_y", "_z").alias("yz"))
    left = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return r.select(*by, F.when(left > 1e-12, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(F.when(left > 1e-12, left))).alias("rho"))


def two_control_slope(y: str, x: str, z: str) -> Column:
    """Coefficient of x in the least-squares fit of y on x, z and a constant, as an aggregate."""
    vx, vz, xz, xy, zy = F.var_pop(x), F.var_pop(z), F.covar_pop(x, z), F.covar_pop(x, y), F.covar_pop(z, y)
    return ratio(xy * vz - zy * xz, vx * vz - xz * xz)


def superiority(df: DataFrame, by: list[str], arm: str, x: str) -> DataFrame:
    """P(a > b) + P(a = b) / 2 between rows with and without ``arm``, and the Mann-Whitney U, both from rank sums."""
    ranked = with_average_ranks(df.select(*by, arm, x), by, {"_r": x})
    n1, n0 = F.count_if(arm), F.count_if(~F.col(arm))
    u = F.sum(F.when(F.col(arm), F.col("_r"))) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by).agg(u.alias("u"), ratio(u, n1 * n0).alias("superiority"), (2 * ratio(u, n1 * n0) - 1).alias("rank_biserial"))


def upper_tail(spark: SparkSession, cases: DataFrame, most: int) -> DataFrame:
    """``cases(id, total, marked, drawn, seen)`` with p: the chance that a draw without replacement shows at least ``seen`` marked ones.

    ``most`` bounds total; the table of log factorials up to it is joined.
    """
    lf = log_factorials(spark, most)
    terms = cases.withColumn("i", F.explode(F.when(F.col("seen") <= F.least("marked", "drawn"), F.sequence(F.col("seen"), F.least("marked", "drawn"))).otherwise(F.array().cast("array<bigint>"))))
    needed = {"a": "marked", "b": "i", "c": "marked - i", "e": "total - marked", "f": "drawn - i", "g": "total - marked - drawn + i", "h": "total", "k": "drawn", "m": "total - drawn"}
    terms = terms.where("drawn - i >= 0 and total - marked - drawn + i >= 0")
    for name, expr in needed.items():
        terms = terms.join(lf.select(F.col("n").alias(f"_{name}"), F.col("lf").alias(name)), F.expr(expr) == F.col(f"_{name}")).drop(f"_{name}")
    log_p = F.expr("a - b - c + e - f - g - (h - k - m)")
    p = terms.groupBy("id").agg(F.sum(F.exp(log_p)).alias("p"))
    return cases.join(p, "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact p of a sign test, as a sum over the smaller tail; for at most 1000 rows in all."""
    n, k = wins + losses, F.least(wins, losses)
    logs = F.transform(F.sequence(F.lit(0), k), lambda i: F.exp(F.aggregate(F.when(i > 0, F.sequence(F.lit(1), i)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, j: a + F.log((n - j + 1) / j)) - n * F.log(F.lit(2.0))))
    return F.least(F.lit(1.0), 2 * F.aggregate(logs, F.lit(0.0), lambda a, x: a + x))
