"""Queries on places: map projections of all cells, nearest neighbours without a radius, emission over a grid of settings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import projections as P
from .base import d, query, r6, sql, view

_ZONE, _CONE = P.utm(11), P.Albers(37.5, -117.0, 29.5, 45.5)


def _at(spark, sf_dir):
    """Every cell with a longitude and a latitude: rows go south from 42 degrees, columns east from -120."""
    return view(spark, sf_dir).select("r", "c", (F.col("c") * 0.1 - 120).alias("lon"), (42 - F.col("r") * 0.02).alias("lat"))


def _sum(x: str, c: list[float], first: str = "sin", second: str = "", y: str = "") -> str:
    return " + ".join(f"{d(k)} * {first}({2 * (j + 1)} * {x})" + (f" * {second}({2 * (j + 1)} * {y})" if second else "") for j, k in enumerate(c))


def _forward(to: P.TransverseMercator) -> str:
    s, e = P._latitudes(to.ellipsoid), d(math.sqrt(to.ellipsoid.e2))
    size, c = d(to.scale * s["radius"][0]), s["rectifying_of_conformal"]
    return f"""p0 AS (SELECT r, c, sinh(asinh(tan(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t, radians(lon - {d(to.lon0)}) AS l FROM (SELECT r, c, c * 0.1::DOUBLE - 120 AS lon, 42 - r * 0.02::DOUBLE AS lat FROM lat)),
p1 AS (SELECT r, c, atan2(t, cos(l)) AS x, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS y FROM p0),
p2 AS (SELECT r, c, {d(to.false_east)} + {size} * (y + {_sum('x', c, 'cos', 'sinh', 'y')}) AS east, {d(to.false_north)} + {size} * (x + {_sum('x', c, 'sin', 'cosh', 'y')}) AS north FROM p1)"""


@query(sql("SELECT r, c, round(east, 3) AS east, round(north, 3) AS north FROM p2", _forward(_ZONE)))
def project_cells(spark, sf_dir):
    """Transverse Mercator coordinates of every cell, to the millimetre."""
    return P.project(_at(spark, sf_dir), _ZONE, "lon", "lat").select("r", "c", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


def _backward(of: P.Albers) -> str:
    s, (n, c, rho0) = P._latitudes(of.ellipsoid), P._cone(of)
    return f"""q0 AS (SELECT r, c, c * 5000.0::DOUBLE - 120000 AS x, {d(rho0 + of.false_north)} - (400000 - r * 2000.0::DOUBLE) AS y FROM lat),
q1 AS (SELECT r, c, x, y, asin(least(greatest(({d(c)} - (x * x + y * y) * {d(n * n / of.ellipsoid.a**2)}) / {d(n)} / {d(s['pole'][0])}, -1), 1)) AS b FROM q0),
q2 AS (SELECT r, c, {d(of.lon0)} + degrees(atan2(x, y)) / {d(n)} AS lon, degrees(b + {_sum('b', s['geographic_of_authalic'])}) AS lat FROM q1)"""


@query(sql("SELECT r, c, round(lon, 8) AS lon, round(lat, 8) AS lat FROM q2", _backward(_CONE)))
def unproject_cells(spark, sf_dir):
    """Longitude and latitude of every cell of a lattice in Albers metres."""
    df = view(spark, sf_dir).select("r", "c", (F.col("c") * 5000.0 - 120_000).alias("x"), (400_000 - F.col("r") * 2000.0).alias("y"))
    return P.unproject(df, _CONE, "x", "y").select("r", "c", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(sql("""SELECT r, c, place, d2 FROM (SELECT a.r, a.c, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c)::INT AS place, ((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))::BIGINT AS d2
  FROM e a JOIN e b ON a.r <> b.r OR a.c <> b.c) WHERE place <= 3""", "e AS (SELECT r, c FROM lat WHERE truth AND (r < 100 OR okey % 5 = 0))"))
def nearest_three(spark, sf_dir):
    """The three nearest others of each cell of a set that is dense at one end and sparse at the other."""
    from ..operators.neighbours import nearest

    cells = view(spark, sf_dir).filter("truth AND (r < 100 OR okey % 5 = 0)").select("r", "c")
    return nearest(cells, 3).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "place", "d2")


@query()
def emission_grid(spark, sf_dir):
    """Budgeted emissions of all settings of spacing, buffer and budget, with their index."""
    from ..operators.evaluate import emission_grid as grid

    cells = view(spark, sf_dir).filter("foot")
    out = grid(cells, "score", F.col("cat"), F.col("truth"), [2.6, 3.0, 3.4], [2.0, 3.0], [100, 300, 600, 1000])
    return out.select("spacing", "buffer", "budget", "n", n6_("tp"), n6_("fp"), "n_truth", n6_("dti"))


def n6_(x: str):
    return r6(x).alias(x)


@query(sql("SELECT r, c, px::FLOAT::DOUBLE AS px, tax::FLOAT::DOUBLE AS tax FROM lat WHERE r BETWEEN 100 AND 180 AND c < 30"))
def tiff_box(spark, sf_dir):
    """Three bands written as TIFF bytes; two of them read back in a box of cells."""
    import uuid

    from ..session import shared_dir
    from ..sources.lattice import HEIGHT, WIDTH
    from ..sources.tiff import read_tiff, write_tiff

    at = f"{shared_dir(spark)}/gridloom/tiff-{uuid.uuid4().hex}"
    write_tiff(view(spark, sf_dir), ["px", "disc", "tax"], HEIGHT, WIDTH, at, rows=64)
    return read_tiff(spark, at, ["px", "tax"]).filter("r BETWEEN 100 AND 180 AND c < 30")
