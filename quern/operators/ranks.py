"""Ranks, standard scores, blocks and splits by order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import settle


def value_counts(df: DataFrame, by: list[str], x: str, weight: str | None = None) -> DataFrame:
    """(*by, x, n, before): how often each value occurs in its group and how many rows have smaller ones; NULL values are left out.

    A row counts ``weight`` times, a whole number, if that is given.

    Rows are counted on the map side first. The different values are then
    dealt by ranges, and sums run within a range and over the ranges' totals,
    so no task takes a whole group however few groups there are.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    ranged = settle(counts.repartitionByRange(*by, x).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("t"))
    earlier = F.sum("t").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*by, "_range", F.coalesce(earlier, F.lit(0)).alias("_start"))
    within = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    summed = ranged.withColumn("_within", F.coalesce(within, F.lit(0)))
    return summed.join(starts, [*by, "_range"]).select(*by, x, "n", (F.col("_start") + F.col("_within")).alias("before"))


def value_count_vectors(df: DataFrame, by: list[str], x: str, weights: str, width: int) -> DataFrame:
    """(*by, x, n, before) as of ``value_counts``, for ``width`` weightings at once: n and before are arrays.

    ``weights`` is an array of whole numbers, one for each weighting; beyond a
    shorter one counts are NULL. There is one order of the values whatever the
    weights, so one sort and one shuffle serve all of them: equal values are
    added up on the map side, and prefix sums run over the columns of a row.
    """
    ns = [f"_n{i}" for i in range(width)]
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(*[F.sum(F.get(weights, F.lit(i))).alias(n) for i, n in enumerate(ns)])
    ranged = settle(counts.repartitionByRange(*by, x).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in ns])
    upto = lambda w: F.array(*[F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in ns])
    starts = totals.select(*by, "_range", upto(Window.partitionBy(*by).orderBy("_range")).alias("_start"))
    summed = ranged.select(*by, x, "_range", F.array(*ns).alias("n"), upto(Window.partitionBy(*by, "_range").orderBy(x)).alias("_within"))
    return summed.join(starts, [*by, "_range"]).select(*by, x, "n", F.zip_with("_start", "_within", lambda s, w: s + w).alias("before"))


def with_places(df: DataFrame, by: list[str], order: list[str], new: str, size: str | None = None) -> DataFrame:
    """``df`` with each row's place within ``by``, from 1, in the ascending order of the columns ``order``, and the group's size.

    Rows are dealt by ranges, numbered within them and moved on by the rows of
    the ranges before, so no task takes a whole group. NULLs come first, and
    NULL is a group like others. Rows that ``order`` cannot tell apart get
    their places in any order.
    """
    ranged = settle(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_t"))
    group = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_from"), earlier.alias("_start"), F.sum("_t").over(group).alias("_all"))
    same = F.col("_range") == F.col("_from")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    placed = ranged.withColumn("_within", within).join(starts, same).withColumn(new, F.col("_start") + F.col("_within"))
    return placed.select(*df.columns, new, *([F.col("_all").alias(size)] if size else []))


def with_average_ranks(df: DataFrame, by: list[str], ranks: dict[str, str], weight: str | None = None) -> DataFrame:
    """``df`` with, for each ``new: x`` of ``ranks``, the rank of x within ``by``; equal values share the mean of their ranks, NULL has none.

    Columns of one type are counted together, and their ranks are one stage
    table, by whose size Spark decides how to join them. A row stands for
    ``weight`` equal ones, if that is given.
    """
    alike = {}
    for new, x in ranks.items():
        alike.setdefault(df.schema[x].dataType, {})[new] = x
    for group in alike.values():
        values = df.select(*by, *([weight] if weight else []), F.inline(F.array(*[F.struct(F.lit(new).alias("_of"), F.col(x).alias("_v")) for new, x in group.items()])))
        ranked = settle(value_counts(values, [*by, "_of"], "_v", weight).select(*by, "_of", "_v", (F.col("before") + (F.col("n") + 1) / 2).alias("_rank")))
        for new, x in group.items():
            df = df.join(ranked.where(F.col("_of") == new).select(*by, F.col("_v").alias(x), F.col("_rank").alias(new)), [*by, x], "left")
    return df


def with_rank_vectors(df: DataFrame, by: list[str], ranks: dict[str, str], weights: str, width: int) -> DataFrame:
    """``df`` with, for each ``new: x`` of ``ranks``, an array: the rank of x within ``by`` by each of the array ``weights``; equal values share the mean of their ranks.

    There are up to as many arrays of ranks as rows, but Spark estimates an
    array at one element and counts at their compressed size, so it would
    broadcast them through the driver: the joins are told to merge.
    """
    source = df
    for new, x in ranks.items():
        rank = F.zip_with("before", "n", lambda b, n: b + (n + 1) / 2).alias(new)
        df = df.join(value_count_vectors(source, by, x, weights, width).select(*by, x, rank).hint("merge"), [*by, x], "left")
    return df


def exact_quantiles(df: DataFrame, by: list[str], x: str, qs: dict[str, float], weight: str | None = None) -> DataFrame:
    """(*by, *qs) with linear interpolation between the two order statistics around q * (n - 1); a row stands for ``weight`` equal ones."""
    counts = settle(value_counts(df, by, x, weight))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    placed = counts.join(sizes, by)
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    ends = [F.max(F.when(holds(f(place(q))), F.col(x))).alias(f"_{side}_{name}") for name, q in qs.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *ends)
    value = lambda name, q: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(q) - F.floor(place(q)))
    return found.select(*by, *[value(name, q).alias(name) for name, q in qs.items()])


def whole_quantiles(df: DataFrame, x: str, qs: dict[str, float]) -> DataFrame:
    """One row (*qs): the exact quantiles of x over all rows."""
    return exact_quantiles(df.select(x, F.lit(0).alias("_one")), ["_one"], x, qs).drop("_one")


def quantile_vectors(df: DataFrame, by: list[str], x: str, qs: dict[str, float], weights: str, width: int) -> DataFrame:
    """(*by, at, *qs): ``exact_quantiles`` by each of the array ``weights``, ``at`` being the place in it; groups that a weighting leaves empty are left out."""
    counts = settle(value_count_vectors(df, by, x, weights, width))
    sizes = counts.groupBy(*by).agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(width)]).alias("_all"))
    each = counts.join(sizes, by).select(*by, x, F.posexplode(F.arrays_zip("n", "before", "_all")).alias("at", "_of")).where("_of.n > 0")
    one = each.select(*by, "at", x, "_of.n", "_of.before", "_of._all")
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    ends = [F.max(F.when(holds(f(place(q))), F.col(x))).alias(f"_{side}_{name}") for name, q in qs.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = one.groupBy(*by, "at").agg(F.max("_all").alias("_all"), *ends)
    value = lambda name, q: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(q) - F.floor(place(q)))
    return found.select(*by, "at", *[value(name, q).alias(name) for name, q in qs.items()])


def with_zscore(df: DataFrame, by: list[str], x: str, new: str) -> DataFrame:
    """``df`` with the standard score by the population deviation; 0 where nothing varies."""
    moments = df.groupBy(*by).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    score = F.when(F.col("_sd") > 1.5e-8, (F.col(x) - F.col("_mean")) / F.when(F.col("_sd") > 1.5e-8, F.col("_sd"))).otherwise(0.0)
    return df.join(moments, by).withColumn(new, score).drop("_mean", "_sd")


def with_centred(df: DataFrame, by: list[str], x: str, new: str) -> DataFrame:
    """``df`` with x less its group's mean."""
    return df.join(df.groupBy(*by).agg(F.avg(x).alias("_mean")), by).withColumn(new, F.col(x) - F.col("_mean")).drop("_mean")


def with_tertile(df: DataFrame, by: list[str], count: str, key: str, new: str) -> DataFrame:
    """``df`` with low, middle or high, cut at n // 3 and 2 * n // 3 of the order by (count, key) within ``by``."""
    r, n = F.col("_place"), F.col("_size")
    third = F.when(r <= F.floor(n / 3), "low").when(r <= F.floor(2 * n / 3), "middle").otherwise("high")
    return with_places(df, by, [count, key], "_place", "_size").withColumn(new, third).drop("_place", "_size")


def with_ordered_block(df: DataFrame, by: list[str], order: list[str], sizes: list[int], new: str) -> DataFrame:
    """``df`` with the number of the contiguous block, of the given sizes, that a row's place in the order falls into; NULL beyond them."""
    upto, out = 0, None
    for k, n in enumerate(sizes):
        upto += n
        out = F.when(F.col("_place") <= upto, k) if out is None else out.when(F.col("_place") <= upto, k)
    return with_places(df, by, order, "_place").withColumn(new, out).drop("_place")


def hash_fold(key: Column, folds: int, digits: int = 8) -> Column:
    """The first hex digits of the key's SHA-256, as a number, modulo ``folds``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("long") % folds).cast("int")


def hash_split(df: DataFrame, by: list[str], key: str, share: float) -> DataFrame:
    """train or eval by the order of a hash within ``by``; the cut rounds half to even and leaves both sides a row."""
    hashed = df.withColumn("_h", F.sha2(F.concat_ws("|", *by, key), 256))
    n = F.col("_size")
    cut = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(share), 0).cast("long")))
    return with_places(hashed, by, ["_h", key], "_place", "_size").withColumn("part", F.when(F.col("_place") <= cut, "train").otherwise("eval")).drop("_h", "_place", "_size")


def radical_inverse(i: Column, base: int) -> Column:
    """The digits of i in ``base``, mirrored behind the point."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.floor(i / F.pow(F.lit(float(base)), k)) % base * F.pow(F.lit(float(base)), -(k + 1)))
    return F.aggregate(digits, F.lit(0.0), lambda a, x: a + x)
