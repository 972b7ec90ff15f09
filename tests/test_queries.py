"""Every query with SQL against DuckDB on the smallest tables; every other query gives rows."""

import json
import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from quern import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"l04_minimum_spanning_tree", "l07_terminal_resistance"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql := catalogue.oracle_sql().get(name):
        cursor = duck.execute(sql)
        names, want = table([c[0] for c in cursor.description], cursor.fetchall())
        assert got[0] == names
        assert len(got[1]) == len(want)
        for a, b in zip(got[1], want):
            assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)
    else:
        assert got[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_spanning_trees_weigh_what_kruskal_finds(spark):
    from quern.operators.graph import spanning_forest

    rng = random.Random(1)
    edges = [("g", a, b, round(rng.random(), 3)) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.5]
    root = list(range(14))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0.0
    for _, a, b, w in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    tree = spanning_forest(spark.createDataFrame(edges, "g string, a long, b long, w double"), "g").collect()
    assert math.isclose(sum(r.w for r in tree), total) and len(tree) == 13


def test_resistances_of_known_circuits(spark):
    from quern.operators.graph import pair_resistance, resistances

    ring = spark.createDataFrame([("r", 0, 1, 1.0), ("r", 1, 2, 1.0), ("r", 2, 3, 1.0), ("r", 3, 0, 1.0), ("s", 7, 8, 1.0), ("s", 8, 9, 1.0)], "g string, a long, b long, w double")
    got = {(r.g, r.a, r.b): r.resistance for r in resistances(ring, "g").collect()}
    assert got["r", 0, 2] == 1.0 and got["r", 0, 1] == 0.75 and got["s", 7, 9] == 2.0
    flat = ring.select("a", "b", "w")
    assert pair_resistance(flat, 0, 2).first().resistance == 1.0
    with pytest.raises(ValueError):
        pair_resistance(flat, 0, 9)
    with pytest.raises(RuntimeError):
        pair_resistance(flat, 0, 1, rounds=1)


def test_distributed_terminals_match_a_pseudo_inverse(spark):
    import numpy as np

    from quern.operators.graph import terminal_resistance

    rng = np.random.default_rng(3)
    edges = [(i, i + 1, float(rng.uniform(0.5, 3))) for i in range(11)] + [(int(a), int(b), float(rng.uniform(0.5, 3))) for a, b in rng.integers(0, 12, (14, 2)) if a != b]
    lap = np.zeros((12, 12))
    for a, b, w in edges:
        lap[[a, b], [a, b]] += w
        lap[[a, b], [b, a]] -= w
    ends = [(7, 0, 0.25), (7, 0, 0.25), (7, 4, 0.5), (8, 11, 1.0)]
    w = np.zeros(12)
    for site, node, share in ends:
        w[node] += share if site == 7 else -share
    got = terminal_resistance(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame(ends, "site long, node long, weight double"), [(7, 8)]).first()
    assert abs(got.resistance - w @ np.linalg.pinv(lap) @ w) < 1e-6
    with pytest.raises(ValueError):
        terminal_resistance(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame(ends[1:], "site long, node long, weight double"), [(7, 8)])


def test_points_that_lie_far_apart_find_their_nearest(spark):
    from quern.operators.space import nearest

    a = spark.createDataFrame([(1, 0.0, 0.0), (2, -60.0, -170.0), (3, 10.0, 179.5)], "id long, lat double, lon double")
    b = spark.createDataFrame([(8, 0.5, 0.5), (9, 10.0, -179.5)], "id long, lat double, lon double")
    assert {(r.a, r.b) for r in nearest(a, b).collect()} == {(1, 8), (2, 9), (3, 9)}


def test_overlaps_and_empty_sets_fail(spark):
    from pyspark.errors import PySparkException

    from quern.operators import polygons, sets
    from quern.sources import files

    square = lambda code, x: (code, [[(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]])
    shapes = spark.createDataFrame([square(1, 0.0), square(2, 1.0)], "code int, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 2.0, 3.0), (4, 2.5, 1.0)], "id long, lat double, lon double")
    found = polygons.points_in_polygons(points, polygons.polygon_edges(polygons.ring_corners(shapes)))
    assert {(r.id, r.code, r.hits) for r in found.collect()} == {(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, -1, 0)}
    with pytest.raises(PySparkException):
        files.expect(found, no_overlap=found["hits"] <= 1).collect()
    empty = spark.createDataFrame([], "unit int, resource int")
    with pytest.raises(PySparkException):
        sets.pair_overlaps(empty, spark.range(2).select(found.sparkSession.range(1).columns[0]).withColumnRenamed("id", "unit"), "unit", "resource").select(sets.jaccard(strict=True)).collect()


def test_features_of_both_kinds(spark, tmp_path):
    from pyspark.errors import PySparkException

    from quern.sources import files

    ring = [[[0, 0], [2, 0], [2, 2], [0, 0]]]
    feature = lambda code, kind, c: {"type": "Feature", "properties": {"c": code, "n": code}, "geometry": {"type": kind, "coordinates": c}}
    write = lambda name, *f: (tmp_path / name).write_text(json.dumps({"features": f}))
    write("a.json", feature("x", "Polygon", ring), feature("y", "MultiPolygon", [ring, [ring[0], ring[0]]]))
    got = {r.code: (r.kind, len(r.rings)) for r in files.read_features(spark, str(tmp_path / "a.json"), "c", "n").collect()}
    assert got == {"x": ("Polygon", 1), "y": ("MultiPolygon", 3)}
    write("b.json", feature("x", "Point", [1, 2]))
    with pytest.raises(PySparkException):
        files.read_features(spark, str(tmp_path / "b.json"), "c", "n").collect()


def test_page_plan_of_a_known_index(spark):
    from pyspark.sql import functions as F

    from quern.sources import files

    plan = lambda total, most=8: spark.range(1).select(files.page_offsets(F.lit(total), 300, most).alias("p")).first().p
    assert plan(4999) == [0, 600, 1200, 2100, 2700, 3300, 3900, 4699]
    assert plan(0) == [] and plan(299) == [0] and plan(2400) == [300 * k for k in range(8)]
    assert plan(4999, 1) == [0] and max(plan(10**7)) == 99_600 and len(plan(2500)) == 8


def test_stage_tables_go(spark, tmp_path):
    import os

    from quern.plans import staging

    staging.settle(spark.range(3))
    root = staging._run_root(spark).removeprefix("file:")
    assert os.listdir(root)
    staging.release(spark)
    assert not os.path.exists(root)


def test_credit_adds_up_and_contracts_hold(spark):
    from pyspark.errors import PySparkException

    from quern.operators import bipartite, joins

    edges = spark.createDataFrame([("c", 1), ("c", 2), ("d", 2)], "consumer string, resource long")
    dist = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 11, False), (2, 12, False)], "resource long, unit long, native boolean")
    credit = {(r.consumer, r.resource): r.credit for r in bipartite.fractional_credit(bipartite.added_sources(edges, dist)).collect()}
    assert credit == {("c", 1): 0.5, ("c", 2): 1.5, ("d", 2): 2.0}
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(PySparkException):
        joins.checked_join(spark.createDataFrame([(1,)], "k long"), twice, ["k"]).collect()


def test_streams_agree_with_batches(spark):
    from quern.streaming import events as E

    batch = spark.read.parquet(f"{DIR}/events.parquet")
    stream = E.event_stream(spark, DIR)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(E.drained(E.cell_counts(stream), "complete")) == key(E.cell_counts(batch))
    assert key(E.drained(E.tumbling(E.event_stream(spark, DIR), "1 day"), "complete")) == key(E.tumbling(batch, "1 day"))


def test_source_digests_are_those_of_the_files(spark):
    import hashlib

    content = open(f"{DIR}/region.parquet", "rb").read()
    rows = [tuple(r) for r in catalogue.queries()["a28_source_digests"](spark, DIR).collect()]
    assert rows == [("region.parquet", len(content), hashlib.sha256(content).hexdigest())]


def test_swaps_reach_all_graphs_alike(spark):
    """Of all 3 x 3 graphs with two edges a row and a column, in 600 chains, each comes up about as often as the others."""
    from collections import Counter

    from quern.operators import nulls as N

    edges = [(c, r, (r + k) % 3, 0) for c in range(600) for r in range(3) for k in (0, 1)]
    frame = spark.createDataFrame(edges, "chain int, row int, col int, stratum int")
    graphs = {}
    for s in N.swapped(frame, "chain", 8.0, 1, 1.0).collect():
        graphs.setdefault(s["chain"], set()).add((s["row"], s["col"]))
    times = Counter(frozenset(g) for g in graphs.values())
    assert len(times) == 6 and all(65 < n < 140 for n in times.values()), times


def test_swaps_keep_margins_and_protected_cells(spark):
    from collections import Counter

    from quern.operators import nulls as N

    rng = random.Random(2)
    cells = sorted({(rng.randrange(30), rng.randrange(12)) for _ in range(150)})
    edges = [(0, r, c, c % 2, r % 5 == 0) for r, c in cells]
    frame = spark.createDataFrame(edges, "chain int, row int, col int, stratum int, fixed boolean")
    for forbidden in (False, True):
        moving = [(r, c) for _, r, c, _, f in edges if not (forbidden and f)]
        held = {(r, c) for _, r, c, _, f in edges if forbidden and f}
        samples = {}
        for s in N.swapped(frame, "chain", 2.0, 3, 1.0, forbidden=forbidden).collect():
            samples.setdefault(s["sample"], []).append((s["row"], s["col"]))
        assert sorted(samples) == [0, 1, 2]
        for found in samples.values():
            assert len(set(found)) == len(found) == len(moving) and not held & set(found)
            assert Counter(r for r, _ in found) == Counter(r for r, _ in moving) and Counter(c for _, c in found) == Counter(c for _, c in moving)
            assert Counter((r, c % 2) for r, c in found) == Counter((r, c % 2) for r, c in moving)
        assert set(samples[2]) != set(moving)


def test_greedy_pairs_are_those_of_a_sorted_scan(spark):
    from quern.operators import nulls as N

    rng = random.Random(5)
    rows = {(g, a, b): float(rng.randrange(6)) for g in "xy" for a in range(25) for b in range(25) if rng.random() < 0.3}
    rows |= {("chain", k, k + step): float(2 * k + step) for k in range(12) for step in (0, 1)}
    want, used = set(), set()
    for (g, a, b), d in sorted(rows.items(), key=lambda r: (r[0][0], r[1], r[0][1:])):
        if not {(g, "a", a), (g, "b", b)} & used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b, d))
    schema = "g string, a long, b long, d double"
    frame = spark.createDataFrame([(*k, d) for k, d in rows.items()] + [("x", None, 1, 0.0), ("x", 1, 1, None)], schema)
    assert {tuple(r) for r in N.greedy_pairs(frame, "g").collect()} == want
    assert N.greedy_pairs(spark.createDataFrame([], schema), "g").columns == ["g", "a", "b", "d"]


def test_short_strata_fail(spark):
    from pyspark.errors import PySparkException

    from quern.operators import nulls as N

    frame = spark.createDataFrame([("g", k, float(k % 2), 1.0) for k in range(4)], "g string, k long, x double, y double")
    assert sorted(r.pick for r in N.farthest_points(frame, ["g"], ["x", "y"], "k", 4).collect()) == [0, 1, 2, 3]
    with pytest.raises(PySparkException):
        N.farthest_points(frame, ["g"], ["x", "y"], "k", 5).collect()


def test_weights_stand_for_copies(spark):
    from pyspark.sql import functions as F

    from quern.operators import ranks
    from quern.operators.stats import pearson, weighted_pearson

    rng = random.Random(7)
    frame = spark.createDataFrame([(k % 2, rng.randrange(9), rng.randrange(9), rng.randrange(1, 4)) for k in range(80)], "g int, x int, y int, w int")
    copies = frame.withColumn("copy", F.explode(F.sequence(F.lit(1), "w")))
    rho = lambda df, weight, how: {r.g: round(r.r, 9) for r in ranks.with_average_ranks(df, ["g"], {"_x": "x", "_y": "y"}, weight).groupBy("g").agg(how.alias("r")).collect()}
    assert rho(frame, "w", weighted_pearson("_x", "_y", "w")) == rho(copies, None, pearson("_x", "_y"))
    middle = lambda df, weight: {tuple(r) for r in ranks.exact_quantiles(df, ["g"], "x", {"low": 0.1, "half": 0.5}, weight).collect()}
    assert middle(frame, "w") == middle(copies, None)


def test_latest_value_before_crosses_spans(spark):
    from quern.operators.joins import latest_before

    rng = random.Random(9)
    rows = [(k, rng.choice([1, 1, 1, 2, None]), rng.randrange(-40, 40), rng.choice([None, rng.randrange(99)])) for k in range(150)]
    want = {k: None if u is None else max((v for _, o, s, v in rows if o == u and s < t and v is not None), default=None) for k, u, t, _ in rows}
    frame = spark.createDataFrame(rows, "k int, u int, t long, v int")
    assert {r.k: r.latest for r in latest_before(frame, "u", "t", "v", "latest", 7).collect()} == want


def test_places_are_those_of_a_sorted_list(spark):
    from quern.operators.ranks import with_places

    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(9)]), k) for k in range(200)]
    got = {r.k: (r.place, r.n) for r in with_places(spark.createDataFrame(rows, "g int, x int, k int"), ["g"], ["x", "k"], "place", "n").collect()}
    for g in (None, 1, 2):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[k] for _, _, k in order] == [(i + 1, len(order)) for i in range(len(order))]
    assert with_places(spark.createDataFrame([], "g int, x int"), ["g"], ["x"], "place").count() == 0
    assert [r.place for r in with_places(spark.range(5), [], ["id"], "place").orderBy("id").collect()] == [1, 2, 3, 4, 5]
