"""Similarities of sets against all pairs, with empty sets and sets that share nothing."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from quern.operators import sets as S


def given():
    rng = random.Random(3)
    sets = {g: {rng.randrange(10 * (g % 3), 10 * (g % 3) + 12) for _ in range(rng.randrange(1, 7))} for g in range(14)}
    return sets | {14: set(), 15: set(), 16: set()}


def test_all_pairs_are_listed_or_counted(spark):
    sets = given()
    incidence = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "g int, i int")
    groups = spark.createDataFrame([(g, g % 2) for g in sets], "g int, label int")
    got = Counter()
    for r in S.pair_overlaps(incidence, groups, "g", "i").withColumn("j", S.jaccard()).collect():
        got[r.a, r.b, r.na, r.nb, r.shared, r.j] += r.partners
    want = Counter()
    for a, b in combinations(sets, 2):
        shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if shared:
            want[a, b, len(sets[a]), len(sets[b]), shared, round(shared / union, 6)] += 1
        else:
            for x, y in ((a, b), (b, a)):
                want[x, None, len(sets[x]), min(len(sets[y]), 1), 0, 0.0 if union else None] += 1
    assert got == want

    mean = {r.same: (r.defined, r.zero_filled, r.n) for r in S.mean_overlaps(incidence, groups, "g", "i", "label").collect()}
    for same in (True, False):
        pairs = [(sets[a], sets[b]) for a, b in combinations(sets, 2) if (a % 2 == b % 2) is same]
        defined = [len(a & b) / len(a | b) for a, b in pairs if a | b]
        assert mean[same] == (round(sum(defined) / len(defined), 6), round(sum(defined) / len(pairs), 6), len(pairs))


def test_no_pairs_of_groups_are_made(spark):
    sets = given()
    incidence = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "g int, i int")
    groups = incidence.select("g").distinct()
    plan = S.sharing_pairs(incidence, S.set_sizes(incidence, groups, "g"), "g", "i")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    incidence, groups = spark.createDataFrame([], "g int, i int"), spark.createDataFrame([], "g int, label int")
    assert S.pair_overlaps(incidence, groups, "g", "i").count() == 0 and S.mean_overlaps(incidence, groups, "g", "i", "label").count() == 0
    none = spark.createDataFrame([(1, 0), (2, 0)], "g int, label int")
    assert [tuple(r) for r in S.pair_overlaps(incidence, none, "g", "i").select("a", "b", "union", "partners").orderBy("a").collect()] == [(1, None, 0, 1), (2, None, 0, 1)]
    assert [tuple(r) for r in S.mean_overlaps(incidence, none, "g", "i", "label").select("same", F.col("defined"), "zero_filled", "n").collect()] == [(True, None, 0.0, 1)]
