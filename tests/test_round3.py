"""What the findings of the third round named, each on small tables."""

import os
import shutil

import pandas as pd
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_block_bootstrap_of_large_keys(spark, tmp_path):
    from quern import catalogue

    shutil.copy(f"{SF}/nation.parquet", tmp_path / "nation.parquet")
    customers = pd.read_parquet(f"{SF}/customer.parquet")
    customers["c_custkey"] += 10**9
    customers.to_parquet(tmp_path / "customer.parquet", coerce_timestamps="us")
    rows = catalogue.queries()["j21_block_bootstrap"](spark, str(tmp_path)).collect()
    assert len(rows) == 5 and all(-1 <= r.low <= r.high <= 1 for r in rows)


def test_half_count_of_values_that_differ_in_their_last_digits(spark):
    """Sums of doubles come out a little different each time; a value has to be counted as what it was when it was ranked."""
    from quern.operators.bipartite import half_count

    shaken = F.udf(lambda k: 16 / 3 + 1e-15 * (os.urandom(1)[0] % 8), "double").asNondeterministic()
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), shaken("id").alias("v"))
    assert {(r.g, r.half_count) for r in half_count(df, ["g"], "v").collect()} == {(0, 250), (1, 250)}


def test_rank_vectors_do_not_pass_the_driver(spark):
    from quern.operators import nulls as N
    from quern.operators.ranks import with_rank_vectors

    rows = N.poisson_blocks(spark.range(40).select(F.lit("a").alias("g"), F.col("id").alias("k"), F.col("id").cast("double").alias("x")), F.col("k"), 30, "t")
    plan = with_rank_vectors(rows, ["g", "block"], {"_x": "x", "_k": "k"}, "weights", N.BLOCK)._jdf.queryExecution().executedPlan().toString()
    outer = [line for line in plan.splitlines() if "LeftOuter" in line]
    assert len(outer) == 2 and all("SortMergeJoin" in line for line in outer)


def test_every_pair_of_communities_is_a_row(spark):
    """Ten suppliers leave most nations without a part: pairs that share nothing, and pairs of empty ones, are rows too."""
    from quern import catalogue

    run = lambda q: catalogue.queries()[q](spark, SF).collect()
    pairs = {(a, b) for b in range(25) for a in range(b)}
    null, filled, both = (run(q) for q in ("g04_jaccard_null_on_empty", "g05_jaccard_zero_filled", "g06_sorensen_simpson"))
    for rows in (null, filled, both):
        assert len(rows) == 300 and {(r.a, r.b) for r in rows} == pairs
    undefined = {(r.a, r.b) for r in null if r.jaccard is None}
    assert undefined == {(r.a, r.b) for r in filled if r.missing} and {r.undefined for r in filled} == {len(undefined)}
    assert {(r.a, r.b) for r in run("g03_jaccard_strict")} == pairs - undefined


def test_products_of_hot_keys_are_dealt_over_tasks(spark):
    from quern import catalogue
    from quern.plans.salting import spread_join

    a = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    b = spark.range(30).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    got = spread_join(a, b, ["k"], "a", "b").select("a", "b").collect()
    assert len(got) == 3000 and len(set(got)) == 3000
    for q in ("b17_pair_features", "c04_many_to_many_join", "k01_leave_one_node_out"):
        plan = catalogue.queries()[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "_l#" in plan and "_r#" in plan, q


def test_errors_without_a_node_follow_from_sums(spark):
    import numpy as np

    from quern.operators.models import leave_node_out_mse

    pairs = [(i, j, float((i * 7 + j * 3) % 11), float((i * j) % 13)) for j in range(9) for i in range(j)]
    p = spark.createDataFrame(pairs, "a long, b long, x double, y double")
    for r in leave_node_out_mse(p.select(F.explode(F.array("a", "b")).alias("node"), "x", "y"), p, "node", "x", "y").collect():
        rest = np.array([q[2:] for q in pairs if r.node not in q[:2]])
        own = np.array([q[2:] for q in pairs if r.node in q[:2]])
        slope, start = np.polyfit(rest[:, 0], rest[:, 1], 1)
        assert r.pairs == 8 and abs(r.mse - np.mean((own[:, 1] - start - slope * own[:, 0]) ** 2)) < 1e-9


def test_hashes_of_a_small_file_are_dealt_to_all_tasks(spark):
    from quern import catalogue

    assert "REPARTITION_BY_NUM" in catalogue.queries()["j08_stratified_bootstrap"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_footprint_joins_a_row_for_each_edge(spark):
    from quern import catalogue

    plan = lambda q: catalogue.queries()[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan("d01_union_footprint_counts")
    for q in ("footprint_expansion", "d02_native_contemporary_added", "d03_portfolio_metrics"):
        assert "collect_list" in plan(q), q


def test_union_footprints_with_nulls_and_unmapped_resources(spark):
    from quern.operators.bipartite import union_footprints

    edges = spark.createDataFrame([(1, 10), (1, 11), (1, None), (2, 12), (3, None), (None, 10)], "consumer int, resource int")
    dist = spark.createDataFrame([(10, 5, True), (10, 6, False), (11, 5, True), (11, None, True), (13, 7, True)], "resource int, unit int, native boolean")
    assert {tuple(r) for r in union_footprints(edges, dist).collect()} == {(1, 2, 2, 2), (2, 0, 1, 0), (3, 0, 0, 0), (None, 2, 1, 1)}


def test_hash_ordered_samples_with_and_without_doubt(spark):
    """With no doubt at all nearly every cut is missed and found by the whole order; with the usual one few hashes are ordered."""
    import hashlib

    from quern.operators.nulls import hash_samples

    rows = [(k, "ab"[k % 3 == 0], float(k % 17)) for k in range(900)]
    wanted = [(u, f, w, sum(r[1] == f for r in rows)) for u, f, w in [(1, "a", 40), (1, "b", 300), (2, "a", 599), (2, "b", 1), (3, "b", 1000)]]
    frame, asked = spark.createDataFrame(rows, "k int, f string, v double"), spark.createDataFrame(wanted, "u int, f string, want long, size long")
    want = set()
    for u, f, w, _ in wanted:
        for draw in range(3):
            picked = sorted((r for r in rows if r[1] == f), key=lambda r: hashlib.sha256(f"{u}|{draw}|{r[0]}".encode()).hexdigest())[:w]
            want.add((u, f, draw, len(picked), sum(r[2] for r in picked)))
    for doubt in (0.0, 1.0, 6.0):
        got = hash_samples(frame, asked, ["f"], ["u", "f"], 3, F.concat_ws("|", "u", "draw", "k"), "v", doubt)
        assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan  # what is ordered has been hashed and cut before
