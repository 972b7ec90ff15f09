"""Nearest neighbours on the cell pyramid against all pairs."""

import math
import random

from quern.operators import space

SPOTS = "id long, lat double, lon double, label int"


def km(a, b):
    half = lambda x, y: math.sin((math.radians(y) - math.radians(x)) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, half(a[1], b[1]) + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * half(a[2], b[2]))))


def cap(rng, n, lat, first):
    return [(first + i, lat + rng.uniform(-9, 9) * (abs(lat) < 80) - math.copysign(rng.uniform(0, 9), lat) * (abs(lat) >= 80), rng.uniform(-180, 180), i % 3) for i in range(n)]


def test_neighbours_near_opposite_poles_take_few_comparisons(spark):
    rng = random.Random(1)
    a, b = cap(rng, 2000, 89.9, 0), cap(rng, 2000, -89.9, 5000)
    left, right = (spark.createDataFrame(x, SPOTS) for x in (a, b))
    met = space.nearest_candidates(left, right)
    assert met.count() < 0.01 * len(a) * len(b)
    got = {r.a: r.km for r in space.nearest(left, right).collect()}
    assert all(abs(got[p[0]] - min(km(p, q) for q in b)) < 1e-6 for p in a[:150]) and len(got) == len(a)


def test_neighbours_match_all_pairs_by_label_and_order(spark):
    rng = random.Random(2)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), i % 4) for i in range(150)] + [(150 + i, 12.0, 179.9 if i % 2 else -179.95, i % 4) for i in range(60)]
    spots += [(300 + i, rng.choice([-90.0, 90.0]), rng.uniform(-180, 180), 1) for i in range(8)] + [(400, None, 3.0, 1), (401, 3.0, None, 1)]
    known = [s for s in spots if s[1] is not None and s[2] is not None]
    frame = spark.createDataFrame(spots, SPOTS)
    got = {r.a: round(r.km, 6) for r in space.nearest(frame, frame, prior=True).collect()}
    assert got == {p[0]: round(min(km(p, q) for q in known if q[0] < p[0]), 6) for p in known if p[0]}
    other = frame.where("id % 2 = 0")
    got = {r.a: (r.label, round(r.km, 6)) for r in space.nearest(frame.where("id % 2 = 1"), other, ["label"]).collect()}
    want = {p[0]: [round(km(p, q), 6) for q in known if q[0] % 2 == 0 and q[3] == p[3]] for p in known if p[0] % 2}
    assert got == {i: ({p[0]: p[3] for p in known}[i], min(d)) for i, d in want.items() if d}
    assert space.nearest(frame, frame.limit(0)).count() == 0


def test_pairs_within_reach_agree_in_their_keys(spark):
    rng = random.Random(3)
    spots = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180), i % 3) for i in range(120)]
    frame = spark.createDataFrame(spots, SPOTS)
    got = {(r.label, r.a, r.b) for r in space.within_km(frame, frame, 3000.0, ["label"]).collect()}
    assert got == {(p[3], p[0], q[0]) for p in spots for q in spots if p[3] == q[3] and km(p, q) <= 3000}


def test_nearest_of_crowded_and_lonely_points(spark, monkeypatch):
    """Crowds, copies and lonely points have the neighbours that all pairs give, and crowds are not paired with all that is near."""
    rng = random.Random(4)
    spots = [(i, 40 + rng.gauss(0, 0.5), 10 + rng.gauss(0, 0.5), 0) for i in range(300)] + [(300 + i, 5.0, 5.0, 0) for i in range(30)]
    spots += [(400 + i, rng.uniform(-89, 89), rng.uniform(-180, 180), 0) for i in range(40)] + [(500, None, 1.0, 0)]
    known = [s for s in spots if s[1] is not None]
    met, within = [], space.within_km
    monkeypatch.setattr(space, "within_km", lambda *args: met.append(within(*args)) or met[-1])
    got = space.nearest_k_within(spark.createDataFrame(spots, SPOTS), 3, 2000.0).collect()
    want = {(p[0], q) for p in known for _, q in sorted((round(km(p, q), 9), q[0]) for q in known if q[0] != p[0] and km(p, q) <= 2000)[:3]}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert len(met) > 1 and sum(m.count() for m in met) < 0.6 * sum(km(p, q) <= 2000 for p in known for q in known)


def test_forest_by_growing_radii_is_that_of_all_pairs(spark):
    from pyspark.sql import functions as F

    from quern.operators import graph

    rng = random.Random(5)
    spots = [(i, 40 + rng.gauss(0, 3), 10 + rng.gauss(0, 3), i % 2) for i in range(160)] + [(200 + i, 5.0, 5.0, i % 2) for i in range(12)]
    spots += [(300 + i, rng.uniform(-89, 89), rng.uniform(-180, 180), i % 2) for i in range(30)] + [(400, None, 1.0, 0), (401, 0.0, 0.0, 7)]
    frame = spark.createDataFrame(spots, SPOTS)
    for reach in (900.0, 6000.0):
        pairs = space.within_km(frame, frame, reach, ["label"]).where("a < b").select("label", "a", "b", F.round("km", 6).alias("w"))
        want = sorted(map(tuple, graph.spanning_forest(pairs, "label").collect()))
        assert sorted(map(tuple, graph.spanning_forest_within(frame, reach, "label").collect())) == want and want
