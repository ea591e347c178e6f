"""Connected components of marked cells: runs within tiles in one pass, then the seams between tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, shared_dir  # noqa: F401
from .distance import spread
from .ordered import numbered, ordered

_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def _label(tile: pd.DataFrame) -> pd.DataFrame:
    """label: the least cell, as r * 2**31 + c, of each cell's component within the tile."""
    r, c = tile.r.to_numpy().astype(np.int64), tile.c.to_numpy().astype(np.int64)
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1))))
    last = np.append(first[1:], len(r)) - 1
    row, lo, hi = r[first].tolist(), c[first].tolist(), c[last].tolist()
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0  # the first run of the row before that may still touch
    for i in range(len(row)):
        while above < i and (row[above] < row[i] - 1 or (row[above] == row[i] - 1 and hi[above] < lo[i] - 1)):
            above += 1
        k = above
        while k < i and row[k] == row[i] - 1 and lo[k] <= hi[i] + 1:
            a, b = root(k), root(i)
            parent[max(a, b)] = min(a, b)
            k += 1
    top = np.array([root(i) for i in range(len(row))])
    label = (r[first][top] << 31) + c[first][top]  # runs are in order, so a root is its component's first
    return pd.DataFrame({"r": r.astype(np.int32), "c": c.astype(np.int32), "label": np.repeat(label, last - first + 1)})


def components(points: DataFrame, tile: int = 512) -> DataFrame:
    """(r, c, comp): comp numbers the 8-connected components from 1 in order of their first cells.

    Each tile labels its cells by its runs. Labels that touch across a seam
    are links; the least label spreads over them in rounds that also jump to
    the label's label. A lattice of one tile has no seams and no rounds.
    """
    at = lambda x: F.floor(F.col(x) / tile)
    cells = settle(points.select(F.col("r").cast("int"), F.col("c").cast("int")).distinct().groupBy(at("r"), at("c")).applyInPandas(_label, "r int, c int, label long"))
    edge = cells.filter((F.pmod("r", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1)))
    other = spread(edge.withColumnsRenamed({"label": "a"}), _AROUND, ["dr", "dc"]).select("r", "c", "a")
    links = edge.join(other, ["r", "c"]).filter("label <> a").select("a", F.col("label").alias("b")).distinct()
    links = settle(links)  # both ways round, as every cell sees every neighbour
    if links.limit(1).count():
        label = settle(links.select(F.col("a").alias("run")).distinct().withColumn("label", F.col("run")))
        while True:
            heard = links.join(label, links["b"] == label["run"]).groupBy(F.col("a").alias("run")).agg(F.min("label").alias("heard"))
            nearer = label.join(heard, "run", "left").select("run", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
            jump = nearer.select(F.col("run").alias("at"), F.col("label").alias("jump"))
            nearer = settle(nearer.join(jump, F.col("label") == F.col("at"), "left").select("run", "was", F.least("label", F.coalesce("jump", "label")).alias("label")))
            moved = nearer.filter("was <> label").limit(1).count()
            label = nearer.select("run", "label")
            if not moved:
                break
        cells = cells.join(label.select(F.col("run").alias("label"), F.col("label").alias("least")), "label", "left").select("r", "c", F.coalesce("least", "label").alias("label"))
    number = numbered(ordered(cells.select("label").distinct(), "label"), "k")
    return cells.join(number, "label").select("r", "c", (F.col("k") + 1).cast("int").alias("comp"))


def stats(labelled: DataFrame) -> DataFrame:
    """Size, centroid and box of each component."""
    return labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.avg("r").alias("mean_r"), F.avg("c").alias("mean_c"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def tips(labelled: DataFrame, least: int = 25) -> DataFrame:
    """Cells with one neighbour in a component of at least so many cells."""
    count = spread(labelled.select("r", "c"), _AROUND, ["dr", "dc"]).groupBy("r", "c").agg(F.count(F.lit(1)).alias("neighbours"))
    large = stats(labelled).filter(F.col("size") >= least).select("comp", "size")
    return labelled.join(count, ["r", "c"]).filter("neighbours = 1").join(large, "comp").select("r", "c", "comp", "size")
