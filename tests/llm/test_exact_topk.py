import math
import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import exact_topk as T

TABLE = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(usable):
        if q is None or q % every:
            continue
        found = [(-sum(x * y for x, y in zip(u, v)), i is None, i or 0) for b, (i, v) in enumerate(usable) if b != a and len(v) == len(u)]
        out += [(q, r, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(n, dims=8, seed=1, low=-1.0):
    rng = random.Random(seed)
    return [(i, [rng.uniform(low, 1) if rng.random() < 0.8 else 0.0 for _ in range(dims)], 0) for i in range(n)]


def test_results_match_brute_force(spark):
    rows = table(300)
    rows += [(400 + i, list(rows[i % 7][1]), 0) for i in range(30)]  # ties
    rows += [(500, [0.0] * 8, 0), (550, [0.01] * 8, 0)]
    frame = spark.createDataFrame(rows, TABLE)
    for name in ("row", "id", "vec", "dims", "block", "part", "rank", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert got(T.nearest(frame, every=10)) == brute(rows, every=10)


def test_many_blocks_of_lists_and_queries(spark):
    rows = table(700, dims=3, seed=2, low=0.2)
    assert got(T.nearest(spark.createDataFrame(rows, TABLE), k=3, every=7, rows=90, queries=20)) == brute(rows, 3, 7)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = table(6, dims=2) + [(50, None, 0), (100, [1.0, None], 0), (150, [nan, 1.0], 0), (200, [inf, 1.0], 0), (250, [], 0), (251, [], 0), (300, [0.5], 0), (None, [0.25, 0.5], 0), (None, [0.25, 0.5], 0), (0, [0.25, 0.5], 0), (350, [0.25, 0.5], 0), (350, [0.25, 0.5], 0)]
    frame = spark.createDataFrame(rows, TABLE)
    assert got(T.nearest(frame)) == brute(rows)
    assert T.nearest(frame.limit(0)).count() == 0
    assert T.nearest(frame.where("vec_id = 1")).count() == 0


def test_components_that_doubles_cannot_sum(spark):
    rows = [(0, [3e6, 1 / 256], 0), (1, [3e6, 7 / 256], 0), (2, [3e6, 8 / 256], 0), (3, [-3e6, 1e6], 0)]
    assert got(T.nearest(spark.createDataFrame(rows, TABLE), every=2)) == brute(rows, every=2)
    huge = [(0, [1e300], 0), (1, [1e300], 0), (2, [-1e300], 0)]
    assert got(T.nearest(spark.createDataFrame(huge, TABLE))) == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63))]


def test_a_search_stops_before_the_lists_end():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-20, 20, (4000, 6)).astype("<i8")
    vectors[17] = 200
    met = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            met.extend([key[1]] * (len(key[0]) > 0))
            return np.asarray(self)[key]

    order = np.argsort(vectors, axis=0).T.astype("<i4").view(Counted)
    lists = T.Lists(np.arange(4000), list(range(4000)), vectors, order)
    assert [r[2] for r in lists.search(-1, np.full(6, 5), 1)] == [17]
    assert min(s.start for s in met if isinstance(s, slice)) >= 4000 - T.DEPTH
