"""Exact deduplication by skew-safe combining.

Copies are combined three times, each time as a grouping on digest and full
content: within the task that reads them (the map side of the first
aggregate), within a salt of their digest, and over the salts. No task sees
more of a digest's rows than a salt holds after map-side combining. The filter
combines so only rows whose digest another row has too.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.texts import ascii_lower, whole
from quern.plans.rows import ROW, chosen, numbered, others
from quern.plans.salting import per_salt, salt_bits, salt_of
from quern.plans.staging import settle


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256)) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept and digest.

    Texts are equal if identical after lower-casing A-Z. A null text counts as
    empty, and empty texts are copies of each other. Of equal texts the
    largest id stays; null ids never win unless a group has no other, in which
    case keep_id is null and all its rows are kept. Rows that repeat an id
    along with its text are one document: they share its verdict. An empty
    table gives an empty result; other columns are ignored.

    Rows find their group by digest and salt. Should one digest stand for
    several contents, its rows are matched by content instead.
    """
    text = ascii_lower(whole(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("content")).select("id", "content", digest(F.col("content")).alias("digest"), salt_of("id").alias("salt"))
    salted = keyed.groupBy("digest", "salt", "content").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), salt_bits("salt").alias("salts"))
    by_digest = settle(merged.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.expr("bit_or(salts)").alias("salts")))
    groups = per_salt(by_digest.where("contents = 1").drop("contents"), "salts")
    found = keyed.select("id", "digest", "salt").join(groups, ["digest", "salt"]).select("id", "keep_id", "group_size", "digest")
    shared = by_digest.where("contents > 1").select("digest")
    if not shared.isEmpty():
        contents = per_salt(settle(merged.join(shared, "digest", "left_semi")), "salts")
        found = found.union(keyed.join(shared, "digest", "left_semi").join(contents, ["digest", "salt", "content"]).select("id", "keep_id", "group_size", "digest"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns: of the rows with the largest id any one; null ids go last.

    Rows are told apart by a key of their own on a settled copy, as ids may be
    null or repeat. A text whose digest no other row has is equal to none and
    stays; all others are compared by their full content, so that a digest
    decides nothing alone and only the texts of rows that share one move.
    Salts are those of the tasks that wrote the copy: a task's copies of a
    text leave it as one.
    """
    rows = numbered(docs)
    digest = F.sha2("content", 256).alias("digest")
    digests = rows.select(F.col(ROW), ascii_lower(whole(text_col)).alias("content")).select(ROW, digest)
    alone = settle(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(ROW).alias(ROW)).where("n = 1").select(ROW))
    shared = others(rows, alone).select(F.col(id_col).alias("id"), F.col(ROW).alias("row"), ascii_lower(whole(text_col)).alias("content"))
    keyed = shared.select("id", "row", "content", digest, salt_of(F.shiftright("row", 33)).alias("salt"))
    salted = keyed.groupBy("digest", "salt", "content").agg(F.max("id").alias("largest"), F.max_by("row", "id").alias("named"), F.max("row").alias("last"))
    merged = salted.groupBy("digest", "content").agg(F.max_by("named", "largest").alias("named"), F.max("last").alias("last"))
    return chosen(rows, alone.union(merged.select(F.coalesce("named", "last").alias(ROW))))
