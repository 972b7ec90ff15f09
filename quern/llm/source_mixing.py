"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domain, language and source. A node's
children share its budget by weight; a child that cannot hold its share is
filled and the rest goes to its siblings, and only what no sibling can take
passes to the ancestors' siblings. That is a water level for each set of
siblings, found with window functions over the tree's nodes, where a node's
capacity is that of all leaves below it. Each leaf's allowance is then taken
as whole seeded epochs and a token prefix of the next one. All of it is
DataFrame functions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import settle

UNKNOWN = "unknown"
LEVELS = ["domain", "lang", "source"]
#: Whole-number weights; a name that is not listed has weight OTHER.
WEIGHTS = {"domain": {"web": 50, "books": 30, "code": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {"src0": 20}}
OTHER = 10
#: Leading hex digits of the seeded order that name a bucket: a leaf's prefix sums run over buckets, then within each.
BUCKET_DIGITS = 3
WORD = r"[^\\x20\\x09-\\x0D]+"


def domain_of(source: Column) -> Column:
    """web, books or code by the number that ends a source's name: below 10, below 15, or above."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n < 10, "web").when(n < 15, "books").when(n >= 15, "code").otherwise(UNKNOWN)


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    found = F.lit(OTHER)
    for name, w in weights.get(level, {}).items():
        found = F.when(F.col(level) == name, F.lit(w)).otherwise(found)
    return found


def leaf_of(lang_col: str, source_col: str) -> dict[str, Column]:
    """A row's domain, language and source."""
    name = lambda c: F.coalesce(F.col(c), F.lit(UNKNOWN))
    return {"domain": domain_of(F.col(source_col)), "lang": name(lang_col), "source": name(source_col)}


def shared_out(nodes: DataFrame, parents: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``nodes(*parents, level, capacity, budget)``, budget being the parent's, with the node's own ``allowance``.

    With siblings in the order of capacity per weight, the water level is the
    first at which the siblings from there on take all that is left and none
    of them overflows; levels that fit only fall from there on, so it is the
    largest. Allowances are whole: less than a token a node is lost.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity") / F.col("weight"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    left = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = nodes.withColumn("weight", _weight(level, weights)).where("weight > 0").withColumn("water", (F.col("budget") - filled) / left)
    fits = F.when(F.col("water") <= F.col("capacity") / F.col("weight"), F.col("water"))
    line = levels.withColumn("line", F.max(fits).over(family))
    share = F.least(F.col("capacity"), F.floor(F.col("line") * F.col("weight")).cast("long"))
    return line.withColumn("allowance", F.greatest(F.lit(0).cast("long"), F.coalesce(share, F.col("capacity")))).drop("weight", "water", "line")


def allowances(supply: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``supply(*LEVELS, tokens)`` with each leaf's ``allowance`` in tokens."""
    leaves = supply.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(budget_share)).cast("long").alias("budget"))
    given = None
    for depth, level in enumerate(LEVELS):
        parents, path = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(given, parents) if parents else nodes.crossJoin(F.broadcast(total))  # one row
        given = shared_out(nodes, parents, level, weights).select(*path, F.col("allowance").alias("budget"))
    return supply.join(given.withColumnRenamed("budget", "allowance"), LEVELS)


def mixed(docs: DataFrame, budget_share: float = 0.5, max_epochs: int = 2, seed: int = 11, weights: dict[str, dict[str, int]] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document and epoch in which it is taken: the id, domain, lang, source, n_tokens and epoch.

    Tokens are words between ASCII white space; the budget is ``budget_share``
    of all tokens, no leaf gives more than ``max_epochs`` times its own. An
    epoch's order is the MD5 of seed, epoch and id; documents with equal
    orders, such as repeated ids, are taken or left together. A null text has
    no tokens, a null lang or source is ``unknown``, a null id counts as an
    empty one. Documents without tokens are taken where the prefix reaches
    them. An empty table gives an empty result; other columns are ignored.
    """
    tokens = F.expr(f"cast(regexp_count(coalesce(`{text_col}`, ''), '{WORD}') as bigint)")
    counted = settle(docs.select(F.col(id_col).alias("id"), *(value.alias(c) for c, value in leaf_of(lang_col, source_col).items()), tokens.alias("tokens")))
    supply = settle(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    plan = allowances(supply, budget_share, max_epochs, weights).withColumnRenamed("tokens", "supply")
    plan = plan.withColumn("full", F.when(F.col("supply") > 0, F.floor(F.col("allowance") / F.col("supply"))).otherwise(0).cast("long"))
    plan = settle(plan.select(*LEVELS, "full", (F.col("allowance") - F.col("full") * F.col("supply")).alias("rest")))
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    ordered = counted.join(plan, LEVELS).withColumn("place", seeded).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*LEVELS, "bucket", F.coalesce(so_far, F.lit(0)).alias("start"))
    within = F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("place"))
    taken = ordered.join(starts, [*LEVELS, "bucket"]).withColumn("copies", F.col("full") + F.when((F.col("start") + within) <= F.col("rest"), 1).otherwise(0))
    epochs = F.explode(F.expr("sequence(0L, copies - 1L)")).alias("epoch")
    return taken.where("copies > 0").select(F.col("id").alias(id_col), *LEVELS, F.col("tokens").alias("n_tokens"), epochs)


def mix(docs: DataFrame, budget_share: float = 0.9, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", **params) -> DataFrame:
    """The rows of ``docs`` that a single epoch takes, with all their columns.

    A row is taken with its leaf and id, which together decide its place;
    rows of one leaf that share an id, or have none, are taken or left together.
    """
    leaf = leaf_of(lang_col, source_col)
    taken = mixed(docs, budget_share, max_epochs=1, id_col=id_col, lang_col=lang_col, source_col=source_col, **params)
    taken = taken.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{c}") for c in LEVELS)).distinct()
    same = [docs[id_col].eqNullSafe(taken["__id"]), *(value == taken[f"__{c}"] for c, value in leaf.items())]
    return docs.join(taken, same, "left_semi")
