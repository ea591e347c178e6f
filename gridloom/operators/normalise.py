"""Scaling, ranks and fusion of bands: one global statistic, then column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered, ordered


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]], where: Column | None = None) -> DataFrame:
    """One row with a column per name: the exact quantile (linear interpolation) of a band over the finite values of the domain.

    Two passes for all bands at once, each with partial aggregation. Sketches
    bracket every quantile between two values; then the values below a bracket
    and at its ends are counted, and those strictly inside, one in a thousand
    at most, are gathered and sorted: a band that is mostly one value has that
    value at an end. Tables of 20,000 values and less are their own bracket.
    Null where there is no value.
    """
    bands = list(dict.fromkeys(b for b, _ in wanted.values()))
    value = {b: F.when(finite(b) if where is None else finite(b) & where, F.col(b).cast("double")) for b in bands}
    slack = 5e-4  # five times the error of a sketch of 10,000
    cuts = {name: [q for q in (at - slack, at + slack) if 0 < q < 1] for name, (_, at) in wanted.items()}
    sketch = [F.percentile_approx(value[wanted[k][0]], qs, 10_000).alias(f"cut_{k}") for k, qs in cuts.items() if qs]
    first = df.agg(*(F.count(v).alias(f"n_{b}") for b, v in value.items()), *sketch)

    def bracket(name: str) -> tuple[Column, Column]:
        band, at = wanted[name]
        small = F.col(f"n_{band}") <= 20_000
        lo = F.lit(float("-inf")) if at - slack <= 0 else F.when(small, float("-inf")).otherwise(F.col(f"cut_{name}")[0])
        hi = F.lit(float("inf")) if at + slack >= 1 else F.when(small, float("inf")).otherwise(F.col(f"cut_{name}")[len(cuts[name]) - 1])
        return lo, hi

    found = []
    for name, (band, _) in wanted.items():
        lo, hi = bracket(name)
        found += [F.count(F.when(value[band] < lo, 1)).alias(f"below_{name}"), F.count(F.when(value[band] == lo, 1)).alias(f"low_{name}"), F.max(F.when(value[band] == lo, lo)).alias(f"lo_{name}"), F.max(F.when(value[band] == hi, hi)).alias(f"hi_{name}")]
        found.append(F.sort_array(F.collect_list(F.when((value[band] > lo) & (value[band] < hi), value[band]))).alias(f"mid_{name}"))
    second = df.crossJoin(F.broadcast(first)).agg(*found, *(F.max(f"n_{b}").alias(f"n_{b}") for b in bands))

    def pick(name: str) -> Column:
        band, at = wanted[name]
        place = F.lit(at) * (F.col(f"n_{band}") - 1)
        k, mid = F.floor(place), F.col(f"mid_{name}")

        def value_at(i: Column) -> Column:
            i = i - F.col(f"below_{name}") - F.col(f"low_{name}")
            return F.when(i < 0, F.col(f"lo_{name}")).when(i >= F.size(mid), F.col(f"hi_{name}")).otherwise(F.get(mid, i.cast("int")))

        one, two = value_at(k), value_at(F.ceil(place))
        return F.when(F.col(f"n_{band}") > 0, one + (two - one) * (place - k)).alias(name)

    return second.select(*map(pick, wanted))


def quantiles(df: DataFrame, band: str, at: list[float], where: Column | None = None) -> DataFrame:
    """One row q0, q1, ... of a band."""
    return quantile_row(df, {f"q{i}": (band, q) for i, q in enumerate(at)}, where)


def robust_units(df: DataFrame, jobs: dict[str, str], where: Column | None = None, lo: float = 0.02, hi: float = 0.995, zero_outside: bool = True) -> DataFrame:
    """For each out -> band: the band between two quantiles of the domain as 0 to 1; all zero where they are equal; outside zero, too, or scaled like inside."""
    q = F.broadcast(quantile_row(df, {f"__{side}_{out}": (band, at) for out, band in jobs.items() for side, at in (("lo", lo), ("hi", hi))}, where))  # one row
    scaled = {}
    for out, band in jobs.items():
        low, high = F.col(f"__lo_{out}"), F.col(f"__hi_{out}")
        unit = F.when(high > low, F.least(F.greatest((F.col(band) - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        domain = finite(band) if where is None or not zero_outside else finite(band) & where
        scaled[out] = F.when(domain, unit).otherwise(0.0)
    return df.crossJoin(q).withColumns(scaled).drop(*(f"__{side}_{out}" for out in jobs for side in ("lo", "hi")))


def robust_unit(df: DataFrame, band: str, out: str, where: Column | None = None, lo: float = 0.02, hi: float = 0.995, zero_outside: bool = True) -> DataFrame:
    return robust_units(df, {out: band}, where, lo, hi, zero_outside)


def tie_free(df: DataFrame, band: str, out: str, where: Column, hi: float = 0.99999) -> DataFrame:
    """out: the band over an extreme quantile, never clipped, so no ties arise; over its largest magnitude where that quantile is not above zero."""
    q = quantiles(df, band, [hi], where).crossJoin(df.filter(where).agg(F.max(F.abs(band)).alias("m")))
    scale = F.when(F.col("q0") > 1e-12, F.col("q0")).otherwise(F.col("m"))
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.when(where, F.col(band) / (scale + 1e-12)).otherwise(0.0)).drop("q0", "m")


def clip(df: DataFrame, band: str, out: str, where: Column, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    q = F.broadcast(quantiles(df, band, [lo, hi], where))
    return df.crossJoin(q).withColumn(out, F.least(F.greatest(F.col(band), F.col("q0")), F.col("q1"))).drop("q0", "q1")


def quantise(df: DataFrame, band: str, out: str, where: Column, lo: float = 0.02, hi: float = 0.995) -> DataFrame:
    """out: 0 to 255 in a short, truncated."""
    scaled = robust_unit(df, band, "__u", where, lo, hi)
    return scaled.withColumn(out, F.floor(F.col("__u") * 255).cast("short")).drop("__u")


def rank_unit(df: DataFrame, band: str, out: str, where: Column) -> DataFrame:
    """out: ordinal rank over the domain as 0 to 1, ties by (r, c); null outside.

    The table is sorted by ranges of (value, r, c), so a band that is mostly
    one value spreads like any other, and no task sorts the whole lattice.
    """
    ranked = numbered(ordered(df.filter(where), band, "r", "c"), "__k", "__n")
    return ranked.withColumn(out, F.col("__k") / F.greatest(F.col("__n") - 1, F.lit(1))).drop("__k", "__n")


def rank_units(df: DataFrame, jobs: dict[str, str], where: Column) -> DataFrame:
    """(r, c, outs): rank_unit of several bands (out -> band) of the domain's cells, with one sort for all of them."""
    bands = F.explode(F.array(*(F.struct(F.lit(i).alias("b"), F.col(band).cast("double").alias("v")) for i, band in enumerate(jobs.values()))))
    ranked = numbered(ordered(df.filter(where).select("r", "c", bands.alias("x")).select("r", "c", "x.b", "x.v"), "b", "v", "r", "c"), "__k", "__n")
    cells = F.col("__n") / len(jobs)  # every cell has a row per band
    unit = (F.col("__k") - F.col("b") * cells) / F.greatest(cells - 1, F.lit(1))
    return ranked.groupBy("r", "c").agg(*(F.max(F.when(F.col("b") == i, unit)).alias(out) for i, out in enumerate(jobs)))


def harmonic_fusion(ranks: dict[str, float], floor: float = 0.05) -> Column:
    """Weighted harmonic mean of ranks (columns 0 to 1), each lifted by floor."""
    total = sum(ranks.values())
    return F.lit(float(total)) / sum(((F.lit(float(w)) / (F.col(c) + floor)) for c, w in list(ranks.items())[1:]), F.lit(float(next(iter(ranks.values())))) / (F.col(next(iter(ranks))) + floor))


def geometric_fusion(channels: dict[str, float], floor: float = 1e-6) -> Column:
    """Weighted geometric mean of channels, each no lower than floor."""
    terms = [F.lit(float(w)) * F.log(F.greatest(F.col(c), F.lit(floor))) for c, w in channels.items()]
    return F.exp(sum(terms[1:], terms[0]) / float(sum(channels.values())))
