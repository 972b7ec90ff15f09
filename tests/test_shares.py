"""Gini, half counts and sums of others against brute force, with ties, zeros and negative-free groups."""

import math
import random

from quern.operators.aggregates import with_others
from quern.operators.bipartite import gini, half_count


def groups():
    rng = random.Random(3)
    out = {"ties": [1.0] * 5, "one": [4.0], "zeros": [0.0, 0.0], "first": [100.0, 1.0, 1.0]}
    return out | {f"r{i}": [float(rng.randrange(6)) for _ in range(30)] for i in range(6)}


def test_shares_of_groups(spark):
    of = groups()
    df = spark.createDataFrame([(g, v) for g, vs in of.items() for v in vs], "g string, v double")
    got = {r.g: r.half_count for r in half_count(df, ["g"], "v").collect()}
    for g, vs in of.items():
        upto, k = 0.0, 0
        while k == 0 or upto < sum(vs) / 2 - 1e-9:
            upto, k = upto + sorted(vs, reverse=True)[k], k + 1
        assert got[g] == k, g
    got = {r.g: r.gini for r in gini(df, ["g"], "v").collect()}
    for g, vs in of.items():
        up = [v for v in vs if v > 0]
        if up:
            apart = sum(abs(a - b) for a in up for b in up) / (2 * len(up) * sum(up))
            assert math.isclose(got[g], apart, abs_tol=2e-6), g
    assert "zeros" not in got
    rest = {(r.g, r.v): r.rest for r in with_others(df, ["g"], "v", "rest").collect()}
    assert all(rest[g, v] == sum(vs) - v for g, vs in of.items() for v in vs)
