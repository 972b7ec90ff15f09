"""Similarity of sets that live in an incidence table (group, item)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.aggregates import r6, ratio
from quern.plans.staging import settle


def shared_counts(incidence: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, shared) for all pairs of groups a < b that share an item: the off-diagonal of the incidence times its transpose.

    The self-join is on items, so its size is the sum of the squares of the
    items' degrees; its result is aggregated on the map side.
    """
    x = incidence.select(F.col(group).alias("a"), item)
    y = incidence.select(F.col(group).alias("b"), item)
    return x.join(y, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def set_sizes(incidence: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, n) of all ``groups``, those without an item included."""
    counts = incidence.groupBy(group).agg(F.count("*").alias("n"))
    return groups.select(group).join(counts, group, "left").select(group, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def sharing_pairs(incidence: DataFrame, sizes: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, na, nb, shared, union) of the pairs a < b that share an item, found by the items, never by pairing groups."""
    na, nb = (sizes.select(F.col(group).alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    pairs = shared_counts(incidence, group, item).join(na, "a").join(nb, "b")
    return pairs.select("a", "b", "na", "nb", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("union"))


def pair_overlaps(incidence: DataFrame, groups: DataFrame, group: str, item: str) -> DataFrame:
    """All pairs of ``groups``: (a, b, na, nb, shared, union, partners).

    Pairs a < b that share an item are rows of their own with partners = 1.
    The others are counted, not listed, as their number grows with the square
    of the groups: for each group a, a row with b NULL and the number of
    partners that hold items but none of a's (nb = 1 stands for any size, on
    which no measure of sets that share nothing depends), and one for the
    partners that are empty (nb = 0). So each such pair is counted at both its
    ends, and two empty sets have a union of 0.
    """
    incidence = settle(incidence.select(group, item))
    sizes = set_sizes(incidence, groups, group)
    pairs = settle(sharing_pairs(incidence, sizes, group, item))
    met = pairs.select(F.col("a").alias(group)).union(pairs.select(F.col("b").alias(group))).groupBy(group).agg(F.count("*").alias("_met"))
    totals = sizes.agg(F.count_if(F.col("n") > 0).alias("_held"), F.count_if(F.col("n") == 0).alias("_empty"))
    rest = sizes.join(met, group, "left").crossJoin(F.broadcast(totals))  # of a single row
    itself, none = F.when(F.col("n") > 0, 1).otherwise(0), F.lit(0).cast("long")
    rest = rest.select(
        F.col(group).alias("a"),
        F.col("n").alias("na"),
        F.inline(F.array(F.struct(F.lit(1).cast("long").alias("nb"), (F.col("_held") - itself - F.coalesce("_met", none)).alias("partners")), F.struct(none.alias("nb"), (F.col("_empty") - (1 - itself)).alias("partners")))),
    )
    b = F.lit(None).cast(pairs.schema["b"].dataType)
    rest = rest.where("partners > 0").select("a", b.alias("b"), "na", "nb", none.alias("shared"), (F.col("na") + F.col("nb")).alias("union"), "partners")
    return pairs.withColumn("partners", F.lit(1).cast("long")).union(rest)


def listed_overlaps(incidence: DataFrame, groups: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, na, nb, shared, union) of all pairs a < b of ``groups``, those that share nothing and those of empty sets included.

    The result has a row a pair, so its size is the square of the groups'
    number; what the pairs share is found by the items.
    """
    incidence = settle(incidence.select(group, item))
    sizes = settle(set_sizes(incidence, groups, group))
    na, nb = (sizes.select(F.col(group).alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    pairs = na.join(nb, F.col("a") < F.col("b")).join(shared_counts(incidence, group, item), ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0).cast("long"))
    return pairs.select("a", "b", "na", "nb", shared.alias("shared"), (F.col("na") + F.col("nb") - shared).alias("union"))


def mean_overlaps(incidence: DataFrame, groups: DataFrame, group: str, item: str, label: str) -> DataFrame:
    """(same, defined, zero_filled, n): mean Jaccard of the pairs within a label and of those between labels, undefined pairs left out or as 0.

    Only sharing pairs add to the sums; the numbers of pairs, and of pairs of
    empty sets, follow from the labels' counts.
    """
    incidence = settle(incidence.select(group, item))
    sizes = set_sizes(incidence, groups, group).join(groups.select(group, label), group)
    labels = [sizes.select(F.col(group).alias(c), F.col(label).alias(f"_{c}")) for c in ("a", "b")]
    pairs = sharing_pairs(incidence, sizes, group, item).join(labels[0], "a").join(labels[1], "b")
    sums = pairs.groupBy((F.col("_a") == F.col("_b")).alias("same")).agg(F.sum(F.col("shared") / F.col("union")).alias("_sum"))
    two = lambda c: c * (c - 1) / 2
    each = sizes.groupBy(label).agg(F.count("*").alias("all"), F.count_if(F.col("n") == 0).alias("empty"))
    every = each.agg(*[F.sum(c).alias(c) for c in ("all", "empty")], *[F.sum(two(F.col(c))).alias(f"{c}_within") for c in ("all", "empty")])
    kinds = every.select(F.inline(F.array(*[F.struct(F.lit(same).alias("same"), *[(F.col(f"{c}_within") if same else two(F.col(c)) - F.col(f"{c}_within")).cast("long").alias(c) for c in ("all", "empty")]) for same in (True, False)])))
    total = F.coalesce("_sum", F.lit(0.0))
    return kinds.where("`all` > 0").join(sums, "same", "left").select("same", r6(ratio(total, F.col("all") - F.col("empty"))).alias("defined"), r6(ratio(total, F.col("all"))).alias("zero_filled"), F.col("all").alias("n"))


def jaccard(strict: bool = False):
    """shared / union; two empty sets give NULL, or an error if ``strict``."""
    value = ratio(F.col("shared"), F.col("union"))
    return F.when(F.col("union") > 0, r6(value)).otherwise(F.raise_error(F.lit("two empty sets")).cast("double")) if strict else r6(value)


def single_status(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Rows of keys that have but one status, NULLs not counted."""
    one = df.groupBy(*keys).agg(F.min(status).alias("_least"), F.max(status).alias("_most")).where("_least = _most")
    one = one.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)])
    same = F.lit(True)
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{k}"))
    return df.join(one, same, "left_semi")
