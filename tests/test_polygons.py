"""Polygons over grid cells against ray casts, all pairs and clipping by hand."""

import math
import random

import pytest

from quern.operators import polygons as P

CORNERS = "code int, ring int, k int, x double, y double"


def star(rng, cx, cy, n, reach):
    """A ring that does not cross itself: corners at growing angles."""
    return [(round(cx + r * math.cos(a), 3), round(cy + r * math.sin(a), 3)) for k in range(n) for a, r in [(2 * math.pi * k / n, reach * rng.uniform(0.4, 1.0))]]


def shapes(seed=1):
    """Stars with holes, squares whose corners and sides lie on grid lines, and combs of many corners."""
    rng = random.Random(seed)
    out = []
    for code in range(12):
        cx, cy = rng.uniform(-100, 100), rng.uniform(-50, 50)
        outer = star(rng, cx, cy, rng.choice([5, 9, 40]), rng.uniform(3, 35))
        hole = [(cx + 0.3 * (x - cx), cy + 0.3 * (y - cy)) for x, y in outer]
        out.append((code, [outer if code % 2 else outer[::-1], hole]))
    out.append((20, [[(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)], [(5.0, 5.0), (10.0, 5.0), (10.0, 10.0), (5.0, 10.0)]]))
    out.append((21, [[(-30.0, -30.0), (-10.0, -30.0), (-20.0, -20.0), (-10.0, -10.0), (-30.0, -10.0)]]))
    comb = [(-40 + k / 4, 30.0 if k % 2 else 5.0 + k % 7) for k in range(320)]
    out.append((22, [[*comb, (40.0, 35.0), (-40.0, 35.0)]]))
    return out


def frame(spark, polygons):
    return spark.createDataFrame([(code, ring, k, float(x), float(y)) for code, rings in polygons for ring, r in enumerate(rings) for k, (x, y) in enumerate(r)], CORNERS)


def sides(ring):
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1]) if a != b]


def on(px, py, e):
    x1, y1, x2, y2 = e
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2)


def holds(rings, px, py):
    every = [e for r in rings for e in sides(r)]
    odd = sum((y1 > py) != (y2 > py) and px < x1 + (x2 - x1) * (py - y1) / (y2 - y1) for x1, y1, x2, y2 in every) % 2
    return bool(odd) or any(on(px, py, e) for e in every)


@pytest.mark.parametrize("size", [10.0, 3.0])
def test_points_match_a_ray_cast(spark, size):
    rng = random.Random(3)
    every = shapes()
    spots = [(rng.uniform(-130, 130), rng.uniform(-85, 85)) for _ in range(400)]
    spots += [(float(x), float(y)) for x in range(-40, 41, 5) for y in range(-40, 41, 5)]  # on grid lines, corners and sides
    spots += [p for _, rings in every for r in rings for p in r[:30]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lon double, lat double")
    got = {(r.id, r.code) for r in P.covering(points, P.polygon_edges(frame(spark, every)), size).collect()}
    assert got == {(i, code) for i, p in enumerate(spots) for code, rings in every if holds(rings, *p)}


def test_rings_over_the_antimeridian(spark):
    ring, hole = [(170.0, -10.0), (-170.0, -10.0), (-170.0, 10.0), (170.0, 10.0)], [(-178.0, -2.0), (-174.0, -2.0), (-174.0, 2.0), (-178.0, 2.0)]
    spots = [(175.0, 0.0), (-171.0, 0.0), (180.0, 5.0), (-180.0, 5.0), (-176.0, 0.0), (0.0, 0.0), (169.0, 0.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lon double, lat double")
    found = P.points_in_polygons(points, P.polygon_edges(frame(spark, [(7, [ring, hole])])))
    assert [r.hits for r in found.orderBy("id").collect()] == [1, 1, 1, 1, 0, 0, 0]


def cross(e, f):
    turn = lambda a, b, c, d, x, y: (c - a) * (y - b) - (d - b) * (x - a)
    s = [turn(*e, *f[:2]), turn(*e, *f[2:]), turn(*f, *e[:2]), turn(*f, *e[2:])]
    return (s[0] > 0) != (s[1] > 0) and s[0] * s[1] != 0 and (s[2] > 0) != (s[3] > 0) and s[2] * s[3] != 0 or on(*f[:2], e) or on(*f[2:], e) or on(*e[:2], f) or on(*e[2:], f)


def test_meeting_polygons_match_all_pairs(spark):
    every = [*shapes(), (30, [[(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)]]), (31, [[(6.0, 6.0), (9.0, 6.0), (9.0, 9.0)]]), (32, [[(20.0, 20.0), (25.0, 20.0), (25.0, 25.0)]])]
    want = set()
    for a, ra in every:
        for b, rb in every:
            ea, eb = ([e for r in rings for e in sides(r)] for rings in (ra, rb))
            if a < b and (any(cross(e, f) for e in ea for f in eb) or any(holds(ra, *r[0]) for r in rb) or any(holds(rb, *r[0]) for r in ra)):
                want.add((a, b))
    edges = P.polygon_edges(frame(spark, every))
    assert {(r.a, r.b) for r in P.meeting_polygons(edges).collect()} == want
    assert (20, 30) in want and (20, 31) not in want and (20, 32) in want


def clipped(ring, west, south, size):
    """Area of a ring within a square, by Sutherland and Hodgman's clipping; right for areas of rings that do not cross themselves."""
    for axis, bound, sign in ((0, west, 1), (0, west + size, -1), (1, south, 1), (1, south + size, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            inside = [sign * (v[axis] - bound) >= 0 for v in (p, q)]
            if inside[0]:
                out.append(p)
            if inside[0] != inside[1]:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(a + t * (b - a) for a, b in zip(p, q)))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in sides(ring))) / 2


@pytest.mark.parametrize("size", [15.0, 4.0])
def test_overlay_areas_match_clipping_and_sum_to_the_polygon(spark, size):
    every = shapes()
    got = {(r.code, r.cx, r.cy): r.area for r in P.overlay_areas(P.polygon_edges(frame(spark, every), wrap=False), size).collect()}
    want = {}
    for code, rings in every:
        xs, ys = zip(*rings[0])
        for cx in range(math.floor(min(xs) / size), math.floor(max(xs) / size) + 1):
            for cy in range(math.floor(min(ys) / size), math.floor(max(ys) / size) + 1):
                outer, *holes = (clipped(r, cx * size, cy * size, size) for r in rings)
                want[code, cx, cy] = outer - sum(holes)
    assert all(abs(want[k] - got.get(k, 0.0)) < 1e-8 for k in want) and set(got) <= set(want)
    for code, rings in every:
        whole = [abs(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in sides(r))) / 2 for r in rings]
        assert abs(sum(v for k, v in got.items() if k[0] == code) - (whole[0] - sum(whole[1:]))) < 1e-7


def test_no_polygons_and_no_points(spark):
    none = P.polygon_edges(frame(spark, []))
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lon double, lat double")
    assert [tuple(r) for r in P.points_in_polygons(points, none).collect()] == [(1, -1, 0)]
    assert P.points_in_polygons(points.limit(0), none).count() == 0 and P.overlay_areas(none, 5.0).count() == 0 and P.meeting_polygons(none).count() == 0
