"""Grids, remote sources, sinks, the ellipsoid and rings on small fixtures with known answers."""

import glob
import io
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import ellipsoid
from quern.sources import files, remote
from quern.sources.grids import read_grids


def test_geodesics_of_known_length(spark):
    """A degree of the equator, a quarter meridian, equal points, a null, antipodes, and a line over the date line."""
    rows = [(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 90.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0), (4, None, 0.0, 1.0, 1.0), (5, 0.0, 0.0, 0.0, 180.0), (6, 10.0, 179.5, 10.0, -179.5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {r.id: r.m for r in df.select("id", ellipsoid.geodesic("a", "b", "c", "d").alias("m")).collect()}
    assert math.isclose(got[1], math.radians(1) * ellipsoid.RADIUS, rel_tol=1e-9)
    assert math.isclose(got[2], 10_001_965.729, abs_tol=0.01)
    assert got[3] == 0.0 and got[4] is None and math.isclose(got[5], 20_003_931.4586, abs_tol=0.001)
    assert 109_000 < got[6] < 110_000


def test_geodesics_near_antipodes():
    """Published lengths, exact antipodes, symmetry, the triangle inequality, and agreement of both solutions where both settle."""
    one = lambda *p: float(ellipsoid._inverse(*(np.array([float(x)]) for x in p))[0])
    assert math.isclose(one(0, 0, 0.5, 179.5), 19_936_288.579, abs_tol=0.001)
    assert math.isclose(one(0, 0, 0.5, 179.7), 19_944_127.421, abs_tol=0.001)
    for lat in (-90.0, -61.5, -0.25, 0.0, 12.0, 89.9):
        assert math.isclose(one(lat, 10, -lat, -170), 20_003_931.4586, abs_tol=0.001)
    rng = np.random.default_rng(5)
    lat, lon = rng.uniform(-90, 90, 4000), rng.uniform(-180, 180, 4000)
    lat2, lon2 = np.clip(-lat + rng.normal(0, 0.5, 4000), -90, 90), lon + 180 + rng.normal(0, 0.5, 4000)
    d = ellipsoid._inverse(lat, lon, lat2, lon2)
    assert np.isfinite(d).all() and (d <= 20_003_931.459).all()
    assert np.allclose(d, ellipsoid._inverse(-lat2, lon2, -lat, lon), atol=0.001)
    mid = rng.uniform(-80, 80, 4000), rng.uniform(-180, 180, 4000)
    assert (d <= ellipsoid._inverse(lat, lon, *mid) + ellipsoid._inverse(*mid, lat2, lon2) + 0.001).all()
    lat2, lon2 = rng.uniform(-90, 90, 4000), lon + rng.uniform(-150, 150, 4000)
    reduced = lambda x: np.arctan((1 - ellipsoid.FLATTENING) * np.tan(np.radians(x)))
    assert np.allclose(ellipsoid._inverse(lat, lon, lat2, lon2), ellipsoid._by_azimuth(reduced(lat), reduced(lat2), np.radians(np.abs(lon2 - lon))), atol=0.001)


def test_cells_make_the_whole_ellipsoid(spark):
    cells = spark.range(-18, 18).select((F.col("id") * 5).alias("south"))
    total = cells.select(F.sum(ellipsoid.cell_area(F.col("south"), F.col("south") + 5, F.lit(360.0))).alias("a")).first().a
    assert math.isclose(total, 510_065_621.7, abs_tol=1)


def test_rings_without_area_are_null(spark):
    rings = [(1, [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]), (2, []), (3, None), (4, [[0.0, 0.0], [0.0, 2.0], [2.0, 2.0]])]
    got = {r.id: r.r for r in spark.createDataFrame(rings, "id long, ring array<array<double>>").select("id", ellipsoid.ring_in_order(F.col("ring")).alias("r")).collect()}
    assert got[1] is got[2] is got[3] is None
    assert got[4].reversed and got[4].closed and got[4].area == 2.0 and got[4].ring[0] == got[4].ring[-1]


def test_grids_that_do_not_align_fail(spark, tmp_path):
    for name, grids in {"good": {"a": np.eye(2), "b": np.full((2, 2), np.nan)}, "bad": {"a": np.eye(2), "b": np.eye(3)}, "short": {"a": np.eye(2)}}.items():
        (tmp_path / name).mkdir()
        out = io.BytesIO()
        np.savez(out, **grids)
        (tmp_path / name / "g.npz").write_bytes(out.getvalue())
    got = sorted(map(tuple, read_grids(spark, str(tmp_path / "good"), ["a", "b"]).collect()))
    assert got == [("g.npz", y, x, float(x == y), None) for y in range(2) for x in range(2)]
    for name in ("bad", "short"):
        with pytest.raises(PySparkException):
            read_grids(spark, str(tmp_path / name), ["a", "b"]).collect()


def test_fetches_are_tried_again_and_then_fail():
    calls = []

    def flaky(k):
        calls.append(k)
        if len(calls) < 3:
            raise OSError("busy")
        return k + 1

    assert remote.persistent(flaky, 5, 10, pause=0.001)(1) == 2 and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        remote.persistent(flaky, 2, 10, pause=0.001)(1)


def test_sinks_keep_order_and_gzip_has_no_time(spark, tmp_path):
    files.write_csv(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")), str(tmp_path / "z"), ["k"], compression="gzip")
    parts = sorted(glob.glob(str(tmp_path / "z" / "*.gz")))
    import gzip

    keys = [int(line) for p in parts for line in gzip.open(p, "rt").read().split()[1:]]
    assert keys == list(range(1000))
    assert all(open(p, "rb").read(8)[4:] == b"\0\0\0\0" for p in parts)
