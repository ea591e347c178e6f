"""What all lattice queries share: registration, the standard views, and the text of the same views in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_taps
from ..sources import lattice

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def r6(x: str | Column) -> Column:
    """Six decimals; no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard lattice; score is a pseudo-random band in [0, 1), dot and truth are masks for metrics."""
    df = lattice.dense(spark, sf_dir)
    key = F.coalesce("okey", F.lit(0))
    return df.withColumns({"score": (key % 997) / F.lit(997.0), "dot": F.coalesce((F.col("okey") % 7 == 0) & F.col("foot"), F.lit(False)), "truth": F.col("off") & F.col("foot")})


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view with 0 where a band has no facts, all bands double."""
    return view(spark, sf_dir).withColumns({b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in ("n", "px", "disc", "tax")})


VIEW = """
cells AS (
  SELECT (datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7)::INT AS r, (floor(l_quantity) - 1)::INT AS c,
    count(*) AS n, sum(l_orderkey)::BIGINT AS okey, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS px,
    sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) AS disc, sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*) AS tax
  FROM lineitem GROUP BY 1, 2),
grid AS (SELECT (i // 50)::INT AS r, (i % 50)::INT AS c FROM range(17900) t(i)),
lat AS (
  SELECT r, c, coalesce(n, 0) AS n, okey, px, disc, tax, r BETWEEN 2 AND 355 AND c BETWEEN 2 AND 47 AS foot,
    r % 37 = 5 AND c BETWEEN 5 AND 44 AS cat, coalesce(okey % 29 = 0, FALSE) AS off, (coalesce(okey, 0) % 997) / 997::DOUBLE AS score,
    coalesce(okey % 7 = 0, FALSE) AND r BETWEEN 2 AND 355 AND c BETWEEN 2 AND 47 AS dot,
    coalesce(okey % 29 = 0, FALSE) AND r BETWEEN 2 AND 355 AND c BETWEEN 2 AND 47 AS truth
  FROM grid LEFT JOIN cells USING (r, c)),
full_ AS (SELECT * REPLACE (n::DOUBLE AS n, coalesce(px, 0) AS px, coalesce(disc, 0) AS disc, coalesce(tax, 0) AS tax) FROM lat)
"""


def sql(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([VIEW.strip(), *(c.strip() for c in ctes)]) + "\n" + select.strip()


def d(x: float) -> str:
    """A literal that is read as a double."""
    return f"{x:.17e}"


def n6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def taps_sql(column: str, taps: dict[int, float], part: str, order: str) -> str:
    terms = []
    for k, t in sorted(taps.items()):
        value = column if k == 0 else f"coalesce({'lead' if k > 0 else 'lag'}({column}, {abs(k)}) OVER ({part} {order}), {'last' if k > 0 else 'first'}_value({column}) OVER ({part} {order} {ALL}))"
        terms.append(f"{d(t)} * {value}")
    return " + ".join(terms)


def smooth_sql(name: str, source: str, jobs: dict[str, tuple[str, float, int, int]]) -> str:
    """CTEs for stencil.smooth: name(all columns of source, results)."""
    down = ", ".join(f"{taps_sql(b, gaussian_taps(s, o), 'PARTITION BY c', 'ORDER BY r')} AS v_{k}" for k, (b, s, o, _) in jobs.items())
    across = ", ".join(f"{taps_sql(f'v_{k}', gaussian_taps(s, o), 'PARTITION BY r', 'ORDER BY c')} AS {k}" for k, (_, s, _, o) in jobs.items())
    drop = ", ".join(f"v_{k}" for k in jobs)
    return f"{name}_v AS (SELECT *, {down} FROM {source}),\n{name} AS (SELECT * EXCLUDE ({drop}), {across} FROM {name}_v)"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(d(x) if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def robust_sql(name: str, source: str, band: str, out: str, lo: float = 0.02, hi: float = 0.995) -> str:
    return f"""{name}_q AS (SELECT quantile_cont({band}, {lo}) AS q0, quantile_cont({band}, {hi}) AS q1 FROM {source} WHERE foot AND {band} IS NOT NULL),
{name} AS (SELECT s.*, CASE WHEN foot AND {band} IS NOT NULL THEN CASE WHEN q1 > q0 THEN least(greatest(({band} - q0) / (q1 - q0), 0), 1) ELSE 0 END ELSE 0 END::DOUBLE AS {out} FROM {source} s, {name}_q)"""
