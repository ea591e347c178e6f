"""Map projections and datum shifts as column expressions: transverse Mercator, Albers equal-area, seven parameters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of a series of sines; each is about 1/600 of the one before, so eight are far below the last bit.
TERMS = 8


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)


# Equatorial radius in metres and inverse flattening of the reference ellipsoids.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
CLARKE66 = Ellipsoid(6378206.4, 294.978698214)


@dataclass(frozen=True)
class TransverseMercator:
    """By the series in the conformal and the rectifying latitude; better than a millimetre within 30 degrees of the meridian."""

    lon0: float
    scale: float = 0.9996
    false_east: float = 500_000.0
    false_north: float = 0.0
    ellipsoid: Ellipsoid = WGS84


@dataclass(frozen=True)
class Albers:
    """Conic equal-area with two standard parallels."""

    lat0: float
    lon0: float
    parallel1: float
    parallel2: float
    false_east: float = 0.0
    false_north: float = 0.0
    ellipsoid: Ellipsoid = GRS80


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(6.0 * zone - 183, false_north=10_000_000.0 if south else 0.0)


def _conformal(e2: float) -> Callable[[np.ndarray], np.ndarray]:
    e = math.sqrt(e2)
    return lambda lat: np.arctan(np.sinh(np.arcsinh(np.tan(lat)) - e * np.arctanh(e * np.sin(lat))))


def _meridian(ell: Ellipsoid, lat: np.ndarray) -> np.ndarray:
    """Length of the meridian from the equator, by quadrature."""
    at, weight = np.polynomial.legendre.leggauss(64)
    x = np.multiply.outer(np.asarray(lat), (at + 1) / 2)
    return ell.a * (1 - ell.e2) * ((1 - ell.e2 * np.sin(x) ** 2) ** -1.5 * weight).sum(-1) * np.asarray(lat) / 2


def _authalic_q(e2: float) -> Callable[[np.ndarray], np.ndarray]:
    e = math.sqrt(e2)
    return lambda lat: (1 - e2) * (np.sin(lat) / (1 - e2 * np.sin(lat) ** 2) + np.arctanh(e * np.sin(lat)) / e)


def _inverse(f: Callable[[np.ndarray], np.ndarray], value: np.ndarray) -> np.ndarray:
    """Where a latitude-like f, close to the identity, takes a value."""
    x = value.copy()
    for _ in range(40):
        x = x + (value - f(x))
    return x


def _sines(g: Callable[[np.ndarray], np.ndarray]) -> list[float]:
    """c with g(x) = c[0] sin 2x + c[1] sin 4x + ..., for an odd g of period pi."""
    n = 64
    x = (np.arange(n) + 0.5) * np.pi / n - np.pi / 2
    return [float(2 / n * (g(x) * np.sin(2 * (j + 1) * x)).sum()) for j in range(TERMS)]


def _latitudes(ell: Ellipsoid) -> dict[str, list[float]]:
    """Series between the geographic, conformal, rectifying and authalic latitudes."""
    conformal = _conformal(ell.e2)
    quarter = float(_meridian(ell, np.array(np.pi / 2)))
    rectifying = lambda lat: np.pi / 2 * _meridian(ell, lat) / quarter
    q = _authalic_q(ell.e2)
    pole = float(q(np.array(np.pi / 2)))
    authalic = lambda lat: np.arcsin(np.clip(q(lat) / pole, -1, 1))
    return {
        "rectifying_of_conformal": _sines(lambda x: rectifying(_inverse(conformal, x)) - x),
        "conformal_of_rectifying": _sines(lambda x: conformal(_inverse(rectifying, x)) - x),
        "geographic_of_conformal": _sines(lambda x: _inverse(conformal, x) - x),
        "geographic_of_authalic": _sines(lambda x: _inverse(authalic, x) - x),
        "radius": [2 * quarter / math.pi],
        "pole": [pole],
    }


def _summed(x: Column, c: list[float]) -> Column:
    return x + sum((F.lit(k) * F.sin(2 * (j + 1) * x) for j, k in enumerate(c)), F.lit(0.0))


def _complex(x: Column, y: Column, c: list[float]) -> tuple[Column, Column]:
    """The same series at the complex number x + iy."""
    real = x + sum((F.lit(k) * F.sin(2 * (j + 1) * x) * F.cosh(2 * (j + 1) * y) for j, k in enumerate(c)), F.lit(0.0))
    return real, y + sum((F.lit(k) * F.cos(2 * (j + 1) * x) * F.sinh(2 * (j + 1) * y) for j, k in enumerate(c)), F.lit(0.0))


def project(df: DataFrame, to: TransverseMercator | Albers, lon: str, lat: str, east: str = "east", north: str = "north") -> DataFrame:
    """df with east and north (metres) of longitudes and latitudes in degrees; null where either is null."""
    ell = to.ellipsoid
    s, e = _latitudes(ell), math.sqrt(ell.e2)
    turn = F.radians(F.col(lon) - F.lit(to.lon0))
    phi = F.radians(F.col(lat))
    if isinstance(to, TransverseMercator):
        df = df.withColumns({"__t": F.sinh(F.asinh(F.tan(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi))), "__l": turn})
        df = df.withColumns({"__x": F.atan2("__t", F.cos("__l")), "__y": F.asinh(F.sin("__l") / F.sqrt(F.col("__t") * F.col("__t") + F.cos("__l") * F.cos("__l")))})
        xi, eta = _complex(F.col("__x"), F.col("__y"), s["rectifying_of_conformal"])
        size = to.scale * s["radius"][0]
        return df.withColumns({east: F.lit(to.false_east) + size * eta, north: F.lit(to.false_north) + size * xi}).drop("__t", "__l", "__x", "__y")
    n, c, rho0 = _cone(to)
    q = F.lit(1 - ell.e2) * (F.sin(phi) / (1 - ell.e2 * F.sin(phi) * F.sin(phi)) + F.atanh(F.lit(e) * F.sin(phi)) / e)
    df = df.withColumns({"__rho": ell.a * F.sqrt(F.lit(c) - n * q) / n, "__l": n * turn})
    return df.withColumns({east: F.lit(to.false_east) + F.col("__rho") * F.sin("__l"), north: F.lit(to.false_north) + rho0 - F.col("__rho") * F.cos("__l")}).drop("__rho", "__l")


def _cone(to: Albers) -> tuple[float, float, float]:
    """Snyder's n, C and rho at the origin."""
    e2, q = to.ellipsoid.e2, _authalic_q(to.ellipsoid.e2)
    one, two, zero = (math.radians(x) for x in (to.parallel1, to.parallel2, to.lat0))
    m2 = lambda x: math.cos(x) ** 2 / (1 - e2 * math.sin(x) ** 2)
    n = (m2(one) - m2(two)) / float(q(np.array(two)) - q(np.array(one))) if to.parallel1 != to.parallel2 else math.sin(one)
    c = m2(one) + n * float(q(np.array(one)))
    return n, c, to.ellipsoid.a * math.sqrt(c - n * float(q(np.array(zero)))) / n


def unproject(df: DataFrame, of: TransverseMercator | Albers, east: str, north: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with longitudes and latitudes in degrees of eastings and northings in metres; null where either is null."""
    ell = of.ellipsoid
    s = _latitudes(ell)
    if isinstance(of, TransverseMercator):
        size = of.scale * s["radius"][0]
        df = df.withColumns({"__x": (F.col(north) - of.false_north) / size, "__y": (F.col(east) - of.false_east) / size})
        xi, eta = _complex(F.col("__x"), F.col("__y"), s["conformal_of_rectifying"])
        df = df.withColumns({"__xi": xi, "__eta": eta})
        df = df.withColumn("__chi", F.asin(F.sin("__xi") / F.cosh("__eta")))
        return df.withColumns({lon: F.lit(of.lon0) + F.degrees(F.atan2(F.sinh("__eta"), F.cos("__xi"))), lat: F.degrees(_summed(F.col("__chi"), s["geographic_of_conformal"]))}).drop("__x", "__y", "__xi", "__eta", "__chi")
    n, c, rho0 = _cone(of)
    df = df.withColumns({"__x": F.col(east) - of.false_east, "__y": F.lit(rho0 + of.false_north) - F.col(north)})
    rho2 = F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")
    q = (F.lit(c) - rho2 * (n * n / ell.a**2)) / n
    df = df.withColumn("__beta", F.asin(F.least(F.greatest(q / s["pole"][0], F.lit(-1.0)), F.lit(1.0))))
    sign = math.copysign(1.0, n)
    return df.withColumns({lon: F.lit(of.lon0) + F.degrees(F.atan2(sign * F.col("__x"), sign * F.col("__y"))) / n, lat: F.degrees(_summed(F.col("__beta"), s["geographic_of_authalic"]))}).drop("__x", "__y", "__beta")


def shift_datum(df: DataFrame, lon: str, lat: str, source: Ellipsoid, target: Ellipsoid, moves: tuple[float, float, float], turns: tuple[float, float, float] = (0.0, 0.0, 0.0), ppm: float = 0.0) -> DataFrame:
    """df with lon and lat on another datum: seven parameters (metres, seconds of arc in the position-vector sense, parts in a million), heights 0."""
    rx, ry, rz = (math.radians(t / 3600) for t in turns)
    m = 1 + ppm * 1e-6
    df = df.withColumns({"__f": F.radians(F.col(lat)), "__g": F.radians(F.col(lon))})
    df = df.withColumn("__n", F.lit(source.a) / F.sqrt(1 - source.e2 * F.sin("__f") * F.sin("__f")))
    df = df.withColumns({"__x": F.col("__n") * F.cos("__f") * F.cos("__g"), "__y": F.col("__n") * F.cos("__f") * F.sin("__g"), "__z": F.col("__n") * (1 - source.e2) * F.sin("__f")})
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    df = df.withColumns({"__u": moves[0] + m * (x - rz * y + ry * z), "__v": moves[1] + m * (rz * x + y - rx * z), "__w": moves[2] + m * (-ry * x + rx * y + z)})
    b = target.a * math.sqrt(1 - target.e2)
    df = df.withColumn("__p", F.sqrt(F.col("__u") * F.col("__u") + F.col("__v") * F.col("__v")))
    df = df.withColumn("__o", F.atan2(F.col("__w") * target.a, F.col("__p") * b))
    up = F.col("__w") + target.e2 / (1 - target.e2) * b * F.pow(F.sin("__o"), F.lit(3.0))
    out = F.col("__p") - target.e2 * target.a * F.pow(F.cos("__o"), F.lit(3.0))
    return df.withColumns({lon: F.degrees(F.atan2("__v", "__u")), lat: F.degrees(F.atan2(up, out))}).drop(*(f"__{k}" for k in "fgnxyzuvwpo"))
