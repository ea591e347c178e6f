"""Greedy spaced points: best first, none closer than a distance, by passes over tiles that equal the sequential rule."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import RADIUS, credit_offsets
from ..session import settle
from .distance import spread
from .ordered import numbered, ordered
from .stencil import tiled


def _settle_tile(rows: pd.DataFrame, moves: list[tuple[int, int]], reach: int, side: int, frame: int) -> pd.DataFrame:
    """Points of a tile and its frame that are certain to be taken or lost, whatever stands outside; state 1: taken, 0: open.

    In turns, every open point that beats all open points in conflict with it
    is taken. Points within reach of the frame's rim may meet better ones
    outside: they stay open, and hold back those they beat.
    """
    tr, tc = int(rows.tr.iloc[0]), int(rows.tc.iloc[0])
    r, c, score = rows.r.to_numpy(np.int64), rows.c.to_numpy(np.int64), rows.score.to_numpy()
    y, x = r - tr * side + frame, c - tc * side + frame
    size = side + 2 * frame + 2 * reach  # with a blank margin, so shifts need no bounds
    rank = np.zeros((size, size), np.int32)
    order = np.lexsort((c, r, -score))
    value = np.empty(len(r), np.int32)
    value[order] = np.arange(len(r), 0, -1)
    taken = rows.state.to_numpy() == 1
    flat = (y + reach) * size + x + reach
    rank.ravel()[flat[~taken]] = value[~taken]
    rim = np.ones((size, size), bool)
    rim[2 * reach : size - 2 * reach, 2 * reach : size - 2 * reach] = False
    core = slice(reach, size - reach)
    shifts = [(slice(reach + i, size - reach + i), slice(reach + j, size - reach + j)) for i, j in moves]
    won = np.zeros((size, size), bool)
    fresh = np.zeros((size, size), bool)
    fresh.ravel()[flat[taken]] = True
    while True:
        lost = np.zeros((size - 2 * reach,) * 2, bool)
        for s in shifts:
            lost |= fresh[s]
        rank[core, core][lost] = 0
        best = np.zeros((size - 2 * reach,) * 2, np.int32)
        for s in shifts:
            np.maximum(best, rank[s], out=best)
        fresh = np.zeros((size, size), bool)
        fresh[core, core] = (rank[core, core] > best) & ~rim[core, core]
        if not fresh.any():
            break
        won |= fresh
        rank[fresh] = 0
    mine = (r // side == tr) & (c // side == tc) & ~taken
    won, left = won.ravel()[flat] & mine, (rank.ravel()[flat] > 0) & mine
    keep = won | left
    return pd.DataFrame({"r": r[keep].astype(np.int32), "c": c[keep].astype(np.int32), "score": score[keep], "state": won[keep].astype(np.int32)})


def emit_groups(scored: DataFrame, score: str, by: str, spacing: float | dict[int, float], tile: int = 256, frame: int = 32) -> DataFrame:
    """(by, r, c, score, rank): emit in each group (an integer) on its own, all groups in one pass; spacing may differ by group.

    A group is part of the key of a tile, so groups never meet, however many
    there are; a group may hold all rows.
    """
    widest = max(spacing.values()) if isinstance(spacing, dict) else spacing
    if math.ceil(widest) > frame:
        raise ValueError("a frame must hold all points in conflict with a tile's own")
    schema = f"{by} int, r int, c int, score double, state int"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows[by].iloc[0])
        apart = spacing[group] if isinstance(spacing, dict) else spacing
        reach = math.ceil(apart)
        moves = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if 0 < i * i + j * j < apart * apart]
        out = _settle_tile(rows, moves, reach, tile, frame)
        out.insert(0, by, np.int32(group))
        return out

    points = scored.filter(F.col(score) > 0).select(F.col(by).cast("int").alias(by), F.col("r").cast("int"), F.col("c").cast("int"), F.col(score).cast("double").alias("score"), F.lit(0).alias("state"))
    state = settle(tiled(points, frame, tile).groupBy(by, "tr", "tc").applyInPandas(one, schema))
    taken = state.filter("state = 1").drop("state")
    while True:
        open_ = state.filter("state = 0")
        if not open_.limit(1).count():
            break
        owners = open_.select(by, F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc")).distinct()
        dealt = tiled(open_.unionByName(taken.withColumn("state", F.lit(1))), frame, tile).join(owners, [by, "tr", "tc"], "left_semi")
        state = settle(dealt.groupBy(by, "tr", "tc").applyInPandas(one, schema))
        taken = taken.unionByName(state.filter("state = 1").drop("state"))
    placed = settle(numbered(ordered(taken, by, F.desc("score"), "r", "c"), "k"), "emitted")
    first = placed.groupBy(by).agg(F.min("k").alias("first"))  # a row per group
    return placed.join(first, by).select(by, "r", "c", "score", (F.col("k") - F.col("first") + 1).cast("long").alias("rank"))


def emit(scored: DataFrame, score: str, spacing: float, tile: int = 256, frame: int = 32) -> DataFrame:
    """(r, c, score, rank) of the points that taking the best left, again and again, accepts.

    Order is by score, then row, then column; points with score <= 0 or null
    don't take part; two points conflict where d**2 < spacing**2. Tiles with
    a frame of neighbours settle what is certain, in one pass nearly all; only
    tiles with open points go to the next pass. The result is that of the
    sequential rule. rank numbers the points by order from 1, so the first k
    are what a budget of k gives.
    """
    return emit_groups(scored.withColumn("__g", F.lit(0)), score, "__g", spacing, tile, frame).drop("__g")


def emit_budget(scored: DataFrame, score: str, budget: int, spacing: float, pool: int = 6, exact: bool = False) -> DataFrame:
    """The first budget points of emit, from a pool of the best cells only.

    A cell that is worse than the whole pool can't change what the pool gives,
    so the pool's points are a prefix of all. The pool is all cells from a
    score on, read from a sketch to hold about pool * budget of them; it
    doubles until there are enough points or no more cells. exact: raises
    where the field has fewer points than budget.
    """
    if budget < 1 or spacing <= 0:
        raise ValueError("budget and spacing must be positive")
    cells = settle(scored.filter(F.col(score) > 0).select("r", "c", F.col(score).cast("double").alias("score")), "pool")
    total, size = cells.count(), pool * budget
    while True:
        best = cells
        if size < total:
            best = cells.filter(F.col("score") >= cells.agg(F.percentile_approx("score", 1 - size / total, 10_000)).first()[0])
        dots = settle(emit(best, "score", spacing).filter(F.col("rank") <= budget), "budget")
        found = dots.count()
        if found == budget or size >= total:
            break
        size *= 2
    if exact and found < budget:
        raise ValueError(f"{found} points of {budget}")
    return dots


def number(points: DataFrame) -> DataFrame:
    """Adds rank from 1 by descending score, then row, then column; no task sorts all points."""
    placed = numbered(ordered(points, F.desc("score"), "r", "c"), "k")
    return placed.select("r", "c", "score", (F.col("k") + 1).cast("long").alias("rank"))


def spacing_knn(points: DataFrame, radius: int) -> DataFrame:
    """Each point with d2, the squared distance to its nearest other point within radius; null beyond."""
    moves = [(i, j, float(i * i + j * j)) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]
    other = spread(points.select("r", "c"), moves, ["dr", "dc", "d2"]).groupBy("r", "c").agg(F.min("d2").alias("d2"))
    return points.join(other, ["r", "c"], "left")


def _cover_tile(rows: pd.DataFrame, moves: list[tuple[int, int, float]], span: float, least: float, side: int, frame: int) -> pd.DataFrame:
    """Cells of a tile and its frame that covering takes for certain (gain not null), and a row without gain if the tile's own cells may give more.

    Gains only fall as cells are taken, and a taken cell changes gains within
    span of it. So a cell whose gain is the largest within span is taken with
    that gain, whatever happens elsewhere. Near the rim, what stands outside
    may lower gains: there they are upper bounds, which hold back their
    neighbours and are not taken themselves.
    """
    tr, tc = int(rows.tr.iloc[0]), int(rows.tc.iloc[0])
    near, far = math.ceil(RADIUS), math.ceil(span)
    pad = far + near  # a blank margin, so that shifts need no bounds
    size = side + 2 * frame + 2 * pad
    y, x = rows.r.to_numpy(np.int64) - tr * side + frame + pad, rows.c.to_numpy(np.int64) - tc * side + frame + pad
    flat = y * size + x
    w, top, best = (np.zeros(size * size) for _ in range(3))
    gain = np.full(size * size, -1.0)
    w[flat] = rows.w
    top[flat] = rows.gain0
    reach = np.array([i * size + j for i, j, _ in moves])
    credit = np.array([k for *_, k in moves])
    disc = np.array([(i, j) for i in range(-far, far + 1) for j in range(-far, far + 1) if 0 < i * i + j * j < span * span])
    around = disc[:, 0] * size + disc[:, 1]
    square = max(h for h in range(far + 1) if 2 * h * h < span * span)
    inner = np.zeros((size, size), bool)
    inner[pad + near : size - pad - near, pad + near : size - pad - near] = True  # all scores that a gain adds up are here
    sure = np.zeros((size, size), bool)
    sure[pad + far : size - pad - far, pad + far : size - pad - far] = True  # and all takes that can lower it
    inner, sure = inner.ravel(), sure.ravel()
    exists = np.zeros(size * size, bool)
    exists[flat] = True

    def settle_gains(at: np.ndarray) -> None:
        own = at[inner[at]]
        near_by = own[:, None] + reach
        gain[own] = np.round((w[near_by] * np.maximum(credit - best[near_by], 0.0)).sum(1), 9)

    def take(at: np.ndarray) -> None:
        for step, k in zip(reach.tolist(), credit.tolist(), strict=True):
            best[at + step] = np.maximum(best[at + step], k)
        changed = np.unique((at[:, None] + np.append(around, 0)).ravel())
        settle_gains(changed[exists[changed]])
        gain[at] = 0.0

    gain[flat] = np.round(rows.gain0, 9)
    before = flat[rows.taken.to_numpy()]
    done = np.zeros(size * size, bool)
    if len(before):
        done[before] = True
        take(before)
    out = []
    while True:
        g = gain.reshape(size, size)
        best_near = g
        for axis in (0, 1):  # the largest in a square inside of the disc
            m = best_near
            for step in range(1, square + 1):
                m = np.maximum(m, np.maximum(np.roll(best_near, step, axis), np.roll(best_near, -step, axis)))
            best_near = m
        hopeful = np.flatnonzero((gain >= least) & (gain > 0) & (gain >= best_near.ravel()) & sure & ~done)
        for step, (i, j) in zip(around.tolist(), disc.tolist(), strict=True):
            other = gain[hopeful + step]
            first = i < 0 or (i == 0 and j < 0)  # that one comes first where both are equal
            hopeful = hopeful[(other < gain[hopeful]) | ((other == gain[hopeful]) & (not first))]
        if not len(hopeful):
            break
        out.append(np.stack((hopeful.astype(float), gain[hopeful])))
        done[hopeful] = True
        take(hopeful)
    own = np.zeros((size, size), bool)
    own[pad + frame : pad + frame + side, pad + frame : pad + frame + side] = True
    more = bool(((gain >= least) & (gain > 0) & ~done & own.ravel()).any())
    at, value = np.concatenate(out, 1) if out else np.empty((2, 0))
    at = at.astype(np.int64)
    r, c = at // size - frame - pad + tr * side, at % size - frame - pad + tc * side
    found = pd.DataFrame({"r": r.astype(np.int32), "c": c.astype(np.int32), "gain": value})
    return pd.concat([found, pd.DataFrame({"r": np.array([tr * side], np.int32), "c": np.array([tc * side], np.int32), "gain": [np.nan]})]) if more else found


def _only(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """f as a function of one argument, as Spark counts them."""
    return lambda rows: f(rows)


def max_cover(scored: DataFrame, score: str, budget: int, tile: int = 256, frame: int = 48, pool: int = 12) -> DataFrame:
    """(r, c, step, gain) of the greedy rule for covering: each step takes the cell that adds most score times credit within three cells.

    Every cell of scored may be taken, also one whose own score is 0 or null;
    gains are compared at nine decimals, equal ones go by row, then column.

    Steps are not taken one by one: tiles with frames take at once what is
    certain (see _cover_tile), and only tiles with open cells go to another
    pass. As gains only fall, the order of the steps is that of the gains at
    which cells were taken. Cells are admitted from a gain on that about pool
    * budget cells have at the start; it is lowered until there are enough
    steps or no cell is left. The result is that of the sequential rule.
    """
    moves, span = credit_offsets(), 2 * RADIUS
    if frame < 2 * span:
        raise ValueError("a frame must hold all that can lower the gain of a cell's rivals")
    cells = scored.select(F.col("r").cast("int"), F.col("c").cast("int"), F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    cells = settle(_offered(cells, moves, tile), "cover_cells")
    total, admitted = cells.filter("gain0 > 0").count(), pool * budget
    taken = cells.limit(0).select("r", "c", F.col("gain0").alias("gain"))
    while True:
        least = 0.0
        if admitted < total:
            least = cells.filter("gain0 > 0").agg(F.percentile_approx("gain0", 1 - admitted / total, 10_000)).first()[0]
        owners = None
        while True:
            rows = cells.join(taken.select("r", "c", F.lit(True).alias("taken")), ["r", "c"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
            dealt = tiled(rows, frame, tile)
            if owners is not None:
                dealt = dealt.join(F.broadcast(owners), ["tr", "tc"], "left_semi")  # a row per tile

            one = partial(_cover_tile, moves=moves, span=span, least=least, side=tile, frame=frame)
            state = settle(dealt.groupBy("tr", "tc").applyInPandas(_only(one), "r int, c int, gain double"), "cover_takes")
            known = taken.unionByName(state.filter("gain IS NOT NULL"))
            taken = settle(known.groupBy("r", "c").agg(F.max("gain").alias("gain")), "cover_known")  # tiles find the same cells in their frames
            owners = state.filter("gain IS NULL").select(F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"))
            if not owners.limit(1).count():
                break
        if least == 0.0 or taken.count() >= budget:
            break
        admitted *= 3
    placed = numbered(ordered(taken.withColumn("__down", -F.col("gain")), "__down", "r", "c"), "k")
    return placed.filter(F.col("k") < budget).select("r", "c", (F.col("k") + 1).cast("int").alias("step"), "gain")


def _offered(cells: DataFrame, moves: list[tuple[int, int, float]], tile: int) -> DataFrame:
    """cells with gain0: the score times credit that each covers at the start."""
    near = math.ceil(RADIUS)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(t.tr.iloc[0]), int(t.tc.iloc[0])
        y, x = t.r.to_numpy() - tr * tile + 2 * near, t.c.to_numpy() - tc * tile + 2 * near
        w = np.zeros((tile + 4 * near,) * 2)
        w[y, x] = t.w
        mine = (t.r.to_numpy() // tile == tr) & (t.c.to_numpy() // tile == tc)
        y, x = y[mine], x[mine]
        gain = sum(k * w[y + i, x + j] for i, j, k in moves)
        return t[mine][["r", "c", "w"]].assign(gain0=gain)

    return tiled(cells, near, tile).groupBy("tr", "tc").applyInPandas(one, "r int, c int, w double, gain0 double")
