"""Untangled rings: known shapes, and random ones against even-odd ray casts."""

import random
from collections import defaultdict

import pytest

from quern.operators import polygons as P
from quern.operators import rings as R


def frame(spark, shapes):
    rows = [(code, n, k, *map(float, (*p, *q))) for code, rings in shapes.items() for n, r in enumerate(rings) for k, (p, q) in enumerate(zip(r, r[1:] + r[:1]))]
    return spark.createDataFrame([(r[0], r[1], *r[3:]) for r in rows], "code int, ring int, x1 double, y1 double, x2 double, y2 double")


def done(spark, shapes, size):
    corners, audit = R.untangled(frame(spark, shapes), size)
    rings = defaultdict(dict)
    for r in corners.collect():
        rings[r.code, r.ring, r.area][r.k] = (r.x, r.y)
    for (_, _, area), ring in rings.items():
        at = [ring[k] for k in range(len(ring))]  # places are gapless
        assert len(set(at)) == len(at) and area == pytest.approx(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(at, at[1:] + at[:1])) / 2)
    return rings, {r.code: r for r in audit.collect()}


def sides(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def odd(rings, x, y):
    return sum((p[1] > y) != (q[1] > y) and x < p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) for r in rings for p, q in sides(r)) % 2 == 1


KNOWN = {
    1: [[(0, 0), (2, 2), (2, 0), (0, 2)]],  # a bow-tie
    2: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]],  # a hole that runs as its ring does
    3: [[(0, 0), (4, 0), (4, 4), (2, 4), (1, 2), (2, 1), (3, 2), (2, 4), (0, 4)]],  # a hole that its ring touches
    4: [[(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 0), (4, 0), (4, 2), (2, 2)]],  # neighbours on one side
    5: [[(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 0), (2, 0), (2, 3), (1, 3)]],  # cut in two
    6: [[(0, 0), (1, 1)]],  # there and back
    7: [[(0, 0), (5, 0), (5, 2), (2, 2), (7, 2), (7, 5), (0, 5)]],  # a way that is gone twice
    8: [[(0, 0), (3, 0), (3, 3), (0, 3)], [(0, 0), (3, 0), (3, 3), (0, 3)]],  # twice the same
}


@pytest.mark.parametrize("size", [10.0, 0.7])
def test_known_shapes(spark, size):
    rings, audit = done(spark, KNOWN, size)
    want = {1: (1, 2, 0, 2.0), 2: (0, 1, 1, 12.0), 3: (0, 1, 1, 13.0), 4: (0, 1, 0, 8.0), 5: (0, 2, 0, 6.0), 6: (0, 0, 0, 0.0), 7: (0, 1, 0, 31.0), 8: (0, 0, 0, 0.0)}
    assert {c: (a.crossings, a.rings, a.holes, pytest.approx(a.area)) for c, a in audit.items()} == want
    assert audit[1].source_area == 0 and audit[2].source_area == 20 and audit[2].change == pytest.approx(0.4)
    assert {area for code, _, area in rings if code == 1} == {1.0}


def test_random_tangles_hold_what_ray_casts_say(spark):
    rng = random.Random(5)
    shapes = {c: [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.choice([5, 12, 25]))] for _ in range(1 + c % 2)] for c in range(6)}
    shapes |= {c: [[(rng.randrange(-4, 5), rng.randrange(-4, 5)) for _ in range(14)]] for c in range(6, 12)}  # many corners on edges, overlaps and repeats
    rings, audit = done(spark, shapes, 1.5)
    for code, given in shapes.items():
        own = [(area, [r[k] for k in range(len(r))]) for (c, _, area), r in rings.items() if c == code]
        assert audit[code].area == pytest.approx(sum(a for a, _ in own)) and audit[code].rings + audit[code].holes == len(own)
        hits = 0
        for _ in range(4000):
            x, y = rng.uniform(-9, 9), rng.uniform(-9, 9)
            inside = odd(given, x, y)
            hits += inside
            assert odd([r for _, r in own], x, y) == inside
            assert sum((1 if a > 0 else -1) * odd([r], x, y) for a, r in own) == inside  # directions say the same
        assert audit[code].area == pytest.approx(hits / 4000 * 324, abs=16)


def test_nothing_meets_any_more(spark):
    rng = random.Random(6)
    shapes = {1: [[(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(20)]]}
    corners, _ = R.untangled(frame(spark, shapes), 2.0)
    edges = P.polygon_edges(corners.select("code", "ring", "k", "x", "y"), wrap=False, oriented=True)
    _, again = R.noded(edges, 2.0)
    assert again.count() == 0
    assert R.untangled(frame(spark, shapes).limit(0), 2.0)[0].count() == 0
