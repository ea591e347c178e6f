"""Lattice analytics as Spark jobs: rasters as cell tables, stencils as windows and joins."""

from .session import ship

__all__ = ["ship"]
