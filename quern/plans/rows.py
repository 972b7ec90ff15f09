"""Rows told apart by a number, and choices of rows as bits, so that a choice moves without the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import settle

#: The column of a row's number.
ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """A settled copy of ``df`` with a number for each row, which stays what it is however often the copy is read."""
    return settle(df.withColumn(ROW, F.monotonically_increasing_id()))


def _marks(numbers: DataFrame) -> DataFrame:
    """The settled bits of a choice of rows: 64 neighbours' bits are one row."""
    return settle(numbers.groupBy(F.expr(f"shiftright({ROW}, 6)").alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({ROW} & 63 as int)))").alias("__bits")))


def _met(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    marks = _marks(numbers)
    return rows.join(marks, F.expr(f"shiftright({ROW}, 6)") == marks["__word"], how).withColumn("__chosen", F.expr(f"coalesce(shiftrightunsigned(__bits, cast({ROW} & 63 as int)) & 1 = 1, false)")).drop("__word", "__bits")


def chosen(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of a ``numbered`` table whose numbers ``kept`` has, without the number.

    64 neighbours' bits are one row of the settled choice: two bits a row of
    the table, 0.25 MB for a million rows. While that is below Spark's
    threshold the table is filtered where it lies; beyond it Spark sorts both
    sides, which moves each row once.
    """
    return _met(rows, kept, "inner").where("__chosen").drop(ROW, "__chosen")


def others(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of a ``numbered`` table whose numbers ``known`` lacks, with the number; they move as those of ``chosen`` do."""
    return _met(rows, known, "left").where("not __chosen").drop("__chosen")
