"""Salted grouping: a key that holds a third of all rows is spread over SALTS tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import settle

#: Salts fit the bits of one long.
SALTS = 32

#: Rows of a key that ``spread_join`` puts into a block of its left and right side, about, and pairs that it gives to a task.
LEFT, RIGHT, PAIRS = 1 << 14, 1 << 9, 1 << 24


def salt_of(*cols) -> Column:
    """A salt from 0 to SALTS - 1 that a row keeps however often it is computed."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salt_bits(salt: str) -> Column:
    return F.expr(f"bit_or(shiftleft(1L, {salt}))")


def per_salt(df: DataFrame, mask: str, salt: str = "salt") -> DataFrame:
    """One row for each salt that ``mask`` names, to be joined on (key, salt)."""
    bits = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright({mask}, s) & 1L) = 1L)")
    return df.withColumn(salt, F.explode(bits)).drop(mask)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, blocks: int = 8) -> DataFrame:
    """The inner join of all rows that agree in ``on``, where few keys hold nearly all of them.

    Each side of a key is dealt into blocks by a hash of its own key, the left
    one into ``blocks`` at least, and each pair of blocks is a group of its
    own. Blocks and tasks grow in number with the rows, not in size, so that a
    key's product is dealt out however large it is, and a row is copied once
    for each block of the other side.

    A task goes through its groups one after the other: a left row stands
    beside all rows of a right block, the next one beside the same in the same
    order. Columns of such pairs are runs and repeats, which Parquet writes in
    a fraction of a byte a row.
    """
    size = lambda side, c: side.groupBy(*on).agg(F.count(F.lit(1)).alias(c))
    sizes = settle(size(left, "_ls").join(size(right, "_rs"), on))
    ls, rs = F.greatest(F.lit(blocks), F.ceil(F.col("_ls") / LEFT)), F.ceil(F.col("_rs") / RIGHT)
    pairs, groups = sizes.agg(F.sum(F.col("_ls").cast("double") * F.col("_rs")), F.sum(ls * rs)).first()
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(groups or 0, int((pairs or 0) / PAIRS)))
    sizes = sizes.select(*on, ls.cast("int").alias("_ls"), rs.cast("int").alias("_rs"))
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    block = lambda k, n, c: F.pmod(F.xxhash64(k), F.col(n)).cast("int").alias(c)
    keys = [*on, "_l", "_r"]
    l = left.join(sizes, on).select(*left.columns, block(left_key, "_ls", "_l"), every("_rs", "_r")).repartition(tasks, *keys)
    r = right.join(sizes, on).select(*right.columns, block(right_key, "_rs", "_r"), every("_ls", "_l")).repartition(tasks, *keys)
    return l.join(r.hint("merge"), keys).drop("_l", "_r")
