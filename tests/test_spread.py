"""Products of few keys: whole, in bounded memory, and small where they are written."""

import os

from pyspark.sql import functions as F

from quern.plans.salting import spread_join


def sides(spark, lefts, rights, keys=25):
    # numbers like those of a table, in no order that the join could profit from
    l = spark.range(lefts).select((F.col("id") % keys).cast("int").alias("k"), F.col("id").alias("a"))
    r = spark.range(rights).select((F.xxhash64("id") % keys).cast("int").alias("k"), F.col("id").alias("b"))
    return l.repartition(3, "a"), r.repartition(3, "b")


def test_written_pairs_take_a_fraction_of_a_byte_each(spark, tmp_path):
    l, r = sides(spark, 5000, 15000)
    pairs = spread_join(l, r, ["k"], "a", "b").drop("k")
    pairs.write.parquet(str(tmp_path / "pairs"))
    size = sum(os.path.getsize(tmp_path / "pairs" / f) for f in os.listdir(tmp_path / "pairs") if f.endswith(".parquet"))
    want = l.join(r, "k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    got = spark.read.parquet(str(tmp_path / "pairs")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    assert got == want and size < 0.8 * got.n


def test_blocks_grow_in_number_and_no_side_is_held_in_memory(spark):
    l, r = sides(spark, 40, 4000, 1)
    joined = spread_join(l, r, ["k"], "a", "b")
    assert joined.count() == 160000
    assert "ShuffledHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_null_keys_single_sides_and_empty_tables(spark):
    l = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (2, 4), (3, None), (3, 5)], "k int, a long")
    r = spark.createDataFrame([(1, 7), (1, 7), (None, 8), (3, None), (4, 9)], "k int, b long")
    got = sorted(map(str, (tuple(x) for x in spread_join(l, r, ["k"], "a", "b").select("k", "a", "b").collect())))
    assert got == sorted(map(str, [(1, 1, 7), (1, 1, 7), (1, 2, 7), (1, 2, 7), (3, None, None), (3, 5, None)]))
    assert spread_join(l.limit(0), r, ["k"], "a", "b").count() == 0
