"""Areas and distances on the WGS84 ellipsoid, and rings put in order."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of WGS84: the equatorial radius in metres and the flattening.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
POLAR = RADIUS * (1 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def _zone(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    e = ECCENTRICITY
    return s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)


def cell_area(south: Column, north: Column, width: Column) -> Column:
    """Square kilometres between two parallels over ``width`` degrees of longitude, in closed form."""
    return F.lit(POLAR * POLAR / 2e6) * F.radians(width) * (_zone(north) - _zone(south))


def _arc(integrand, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Integral of a smooth function of the arc's squared sine, by Gauss-Legendre nodes."""
    nodes, weights = np.polynomial.legendre.leggauss(16)
    half = (end - start) / 2
    at = (start + end)[:, None] / 2 + half[:, None] * nodes
    return half * (integrand(np.sin(at) ** 2) @ weights)


def _by_azimuth(u1: np.ndarray, u2: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Metres between two reduced latitudes, ``apart`` radians of longitude: the azimuth at the first is found by halving.

    Turned so that the first point lies in the south and no nearer to the
    equator than the second, a line's longitude grows through the wanted one
    just once as its azimuth runs from north to south, so this always settles.
    Equal latitudes on the equator less than (1 - f) * pi apart have no such
    line and are not given here.
    """
    f = FLATTENING
    first = np.abs(u1) >= np.abs(u2)
    b1, b2 = np.where(first, u1, u2), np.where(first, u2, u1)
    b2 = np.where(b1 > 0, -b2, b2)
    b1 = np.minimum(-np.abs(b1), -1e-200)
    s1, c1, s2, c2 = np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2)

    def line(azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longitude and length of the line that leaves the first point so, at the second's latitude."""
        across, along = np.sin(azimuth), np.cos(azimuth)
        node = across * c1
        arrival = np.sqrt(np.maximum(0.0, (along * c1) ** 2 + (c2 - c1) * (c2 + c1)))
        from_, to = np.arctan2(s1, along * c1), np.arctan2(s2, arrival)
        turned = np.arctan2(node * np.sin(to), np.cos(to)) - np.arctan2(node * np.sin(from_), np.cos(from_))
        k = ((RADIUS / POLAR) ** 2 - 1) * (1 - node**2)[:, None]
        lag = _arc(lambda q: (2 - f) / (1 + (1 - f) * np.sqrt(1 + k * q)), from_, to)
        return turned - f * node * lag, POLAR * _arc(lambda q: np.sqrt(1 + k * q), from_, to)

    north, south = np.zeros(len(b1)), np.full(len(b1), np.pi)
    for _ in range(60):
        middle = (north + south) / 2
        short = line(middle)[0] < apart
        north, south = np.where(short, middle, north), np.where(short, south, middle)
    return line(south)[1]


def _inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Vincenty's inverse solution in metres; where it does not settle, near antipodes, that of ``_by_azimuth``. NaN only for NaN."""
    f = FLATTENING
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    apart = np.radians(lon2 - lon1)
    apart = (apart + np.pi) % (2 * np.pi) - np.pi
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = apart.copy(), np.zeros(len(apart), bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sin_sigma = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_sigma = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_alpha = np.where(sin_sigma > 0, c1 * c2 * np.sin(lam) / sin_sigma, 0.0)
            cos2_alpha = 1 - sin_alpha**2
            middle = np.where(cos2_alpha > 1e-15, cos_sigma - 2 * s1 * s2 / cos2_alpha, 0.0)
            c = f / 16 * cos2_alpha * (4 + f * (4 - 3 * cos2_alpha))
            after = apart + (1 - c) * f * sin_alpha * (sigma + c * sin_sigma * (middle + c * cos_sigma * (2 * middle**2 - 1)))
            settled = np.abs(after - lam) < 1e-12
            lam = after
            if settled.all():
                break
        k = cos2_alpha * (RADIUS**2 - POLAR**2) / POLAR**2
        a = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        b = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        turn = b * sin_sigma * (middle + b / 4 * (cos_sigma * (2 * middle**2 - 1) - b / 6 * middle * (4 * sin_sigma**2 - 3) * (4 * middle**2 - 3)))
        metres = np.where(settled & (np.abs(lam) <= np.pi), POLAR * a * (sigma - turn), np.nan)
    far = np.isnan(metres) & np.isfinite(u1) & np.isfinite(u2) & np.isfinite(apart)
    if far.any():
        metres[far] = _by_azimuth(u1[far], u2[far], np.abs(apart[far]))
    return metres


@F.pandas_udf(T.DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres along the shortest line on the ellipsoid; null for null points only."""
    return pd.Series(_inverse(*(x.to_numpy(np.float64) for x in (lat1, lon1, lat2, lon2))))


def _turned(ring: Column) -> Column:
    """Twice the signed area of a closed ring of [x, y]: positive if it runs anticlockwise."""
    steps = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def ring_in_order(ring: Column) -> Column:
    """struct(ring, removed, closed, reversed, area) of an array of [x, y].

    Vertices that repeat the one before go, an open ring is closed, a
    clockwise one is reversed; the struct tells what was done. Rings with
    fewer than three different vertices have no area and are null. Rings that
    cross themselves are not untangled.
    """
    at = F.sequence(F.lit(1), F.size(ring))
    kept = F.transform(F.filter(at, lambda i: (i == 1) | (F.element_at(ring, i) != F.element_at(ring, F.greatest(i - 1, F.lit(1))))), lambda i: F.element_at(ring, i))
    is_open = F.element_at(kept, 1) != F.element_at(kept, -1)
    closed = F.when(is_open, F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept)
    twice = _turned(closed)
    fixed = F.struct(F.when(twice < 0, F.reverse(closed)).otherwise(closed).alias("ring"), (F.size(ring) - F.size(kept)).alias("removed"), is_open.alias("closed"), (twice < 0).alias("reversed"), (F.abs(twice) / 2).alias("area"))
    return F.when((F.size(ring) > 2) & (F.size(F.array_distinct(ring)) > 2), fixed)
