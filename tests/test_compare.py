import random

import pytest

from quern.operators import compare as C

ROWS = "k long, v double, s string, n long"


def brute(old, new, tolerance):
    a, b = ({r[0]: r for r in t} for t in (old, new))
    out = set()
    for k in {*a, *b}:
        if k not in b or k not in a:
            out.add((k, "missing" if k in a else "extra", ""))
            continue
        same = lambda x, y: x is None and y is None or x == y or None not in (x, y) and not isinstance(x, str) and (abs(x - y) <= tolerance or x != x and y != y)
        columns = [c for c, x, y in zip("vsn", a[k][1:], b[k][1:]) if not same(x, y)]
        if columns:
            out.add((k, "changed", ",".join(sorted(columns))))
    return out


def test_diff_matches_brute_force_and_reads_few_rows(spark):
    rng = random.Random(1)
    old = [(k * 7 - 900, rng.random(), f"s{k % 5}", k) for k in range(3000)] + [(None, float("nan"), None, None)]
    new = [list(r) for r in old]
    for k in (4, 900, 2500):
        new[k][1] += 0.5
    new[700][2], new[701][3], new[1500][2], new[1501][1] = "other", None, None, float("nan")
    new[10][1] += 1e-9
    new = [tuple(r) for k, r in enumerate(new) if k not in (33, 2222)] + [(10**6, 1.0, "x", 1), (-5000, None, None, None)]
    report = {}
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    got = C.table_diff(frame(old), frame(new).repartition(3), "k", 1e-6, leaves=512, report=report)
    assert {tuple(r) for r in got.collect()} == brute(old, new, 1e-6)
    assert report["rows"] == [3001, 3001] and report["ranges"] <= 13
    same = C.table_diff(frame(old), frame(old[::-1]), "k", leaves=64, report=report)
    assert same.count() == 0 and report["compared"] == [0, 0]
    assert C.table_diff(frame(old), frame([]), "k").count() == 3001 and C.table_diff(frame([]), frame([]), "k").count() == 0


def test_a_narrow_difference_is_compared_in_its_range_only(spark):
    old = [(k, float(k), "a", k) for k in range(20_000)]
    new = [(k, v + (k == 7777), s, n) for k, v, s, n in old]
    report = {}
    got = C.table_diff(spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS), "k", report=report)
    assert [tuple(r) for r in got.collect()] == [(7777, "changed", "v")]
    assert report["ranges"] == 1 and max(report["compared"]) <= 5


def test_rows_that_cannot_be_compared_fail(spark):
    rows = spark.createDataFrame([(1, 1.0, "a", 1), (1, 2.0, "a", 1)], ROWS)
    with pytest.raises(ValueError):
        C.table_diff(rows, rows.limit(1), "k")
    with pytest.raises(ValueError):
        C.table_diff(rows, rows.drop("n"), "k")
