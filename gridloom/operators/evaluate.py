"""Locked evaluation: cells laid over a footprint, what a model may see of them, and paired scores of two fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import ALPHA, BETA, EPSILON, RADIUS, credit_offsets
from ..session import settle
from .components import components
from .distance import dilate, distance, near, spread
from .emission import emit_groups
from .metric import dti, parts


def edges(lo: int, hi: int, n: int) -> list[int]:
    """n + 1 whole numbers from lo to hi in equal steps, rounded down."""
    return [math.floor(lo + i * (hi - lo) / n) for i in range(n + 1)]


def locked_cells(df: DataFrame, foot: Column, n: int = 8, erosion: int = 15) -> DataFrame:
    """(r, c, ordinal, active): cells of an n x n grid over the footprint's bounding box, of every second row and column, in row-major order.

    active: in the footprint and further than erosion from what is outside
    of it or of the cell.
    """
    r0, r1, c0, c1 = df.filter(foot).agg(F.min("r"), F.max("r") + 1, F.min("c"), F.max("c") + 1).first()  # four numbers
    if r0 is None:
        raise ValueError("no cells in the footprint")
    er, ec = edges(r0, r1, n), edges(c0, c1, n)
    below = lambda e, x: sum((F.when(F.col(x) >= v, 1).otherwise(0) for v in e[1:]), F.when(F.col(x) >= e[0], 0).otherwise(-1))
    placed = df.withColumns({"gr": below(er, "r"), "gc": below(ec, "c")})
    placed = placed.filter(F.col("gr").between(0, n - 1) & F.col("gc").between(0, n - 1) & (F.col("gr") % 2 == 0) & (F.col("gc") % 2 == 0))
    # what is outside of the footprint, as far as it can matter; the cell's own rim counts by its distance
    out = near(df.filter(~foot), erosion).select("r", "c", F.lit(True).alias("__out"))
    at = lambda e, k: F.element_at(F.array(*map(F.lit, e)), k + 1)
    side = lambda e, g, x: F.least(F.col(x) - at(e, F.col(g)) + 1, at(e, F.col(g) + 1) - F.col(x))
    rim = F.least(side(er, "gr", "r"), side(ec, "gc", "c"))
    joined = placed.join(out, ["r", "c"], "left")
    half = (n + 1) // 2
    return joined.select("r", "c", (F.col("gr") / 2 * half + F.col("gc") / 2).cast("int").alias("ordinal"), (foot & F.col("__out").isNull() & (rim > erosion)).alias("active"))


def hidden_components(labelled: DataFrame, cells: DataFrame, collar: int = 15) -> DataFrame:
    """(ordinal, comp): components with a cell in the box of a locked cell widened by collar."""
    boxes = cells.groupBy("ordinal").agg((F.min("r") - collar).alias("r0"), (F.max("r") + collar).alias("r1"), (F.min("c") - collar).alias("c0"), (F.max("c") + collar).alias("c1"))
    inside = F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))
    return labelled.join(F.broadcast(boxes), inside).select("ordinal", "comp").distinct()  # a row per locked cell


def fold_view(df: DataFrame, labelled: DataFrame, cells: DataFrame, hidden: DataFrame, ordinal: int, collar: int = 15) -> DataFrame:
    """df with known (visible catalogue of one fold) and train (outside of the widened cell and of hidden components)."""
    gone = labelled.join(hidden.filter(F.col("ordinal") == ordinal).select("comp"), "comp", "left_semi").select("r", "c", F.lit(True).alias("__hidden"))
    seen = labelled.select("r", "c", F.lit(True).alias("__cat"))
    box = F.broadcast(cells.filter(F.col("ordinal") == ordinal).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")))  # one row
    out = df.join(gone, ["r", "c"], "left").join(seen, ["r", "c"], "left").crossJoin(box)
    near_box = F.col("r").between(F.col("r0") - collar, F.col("r1") + collar) & F.col("c").between(F.col("c0") - collar, F.col("c1") + collar)
    return out.withColumns({"known": F.col("__cat").isNotNull() & F.col("__hidden").isNull(), "train": ~near_box & F.col("__hidden").isNull()}).drop("__hidden", "__cat", "r0", "r1", "c0", "c1")


def negative_pools(df: DataFrame, positive: Column, ring: tuple[float, float] = (1.0, 6.0), steps: int = 6) -> DataFrame:
    """df with hard (between two distances of a positive cell) and background (further than steps over edges from any)."""
    points = df.filter(positive)
    close = near(points, ring[1]).select("r", "c", F.col("d").alias("__d"))
    grown = dilate(points, steps).select("r", "c", F.lit(True).alias("__grown"))
    out = df.join(close, ["r", "c"], "left").join(grown, ["r", "c"], "left")
    hard = F.coalesce(F.col("__d").between(*ring), F.lit(False)) & ~positive
    return out.withColumns({"hard": hard, "background": F.col("__grown").isNull() & ~positive}).drop("__d", "__grown")


def emit_by(scored: DataFrame, score: str, by: str, spacing: float) -> DataFrame:
    """emit in each group on its own, in one pass for all: (by, r, c, rank) with rank within the group."""
    return emit_groups(scored, score, by, spacing).select(by, "r", "c", "rank")


def emission_grid(cells: DataFrame, score: str, known: Column, truth: Column, spacings: list[float], buffers: list[float], budgets: list[int], active: Column | None = None) -> DataFrame:
    """(spacing, buffer, budget, n, tp, fp, n_truth, dti): what each setting of an emission would score.

    cells are those that may be scored or emitted; a setting emits outside of
    buffer around known cells, spacing apart, budget points at most, and is
    scored over the active cells that are not known. All spacings and buffers
    are emitted in one pass over tiles; budgets are prefixes of an emission,
    so one pass over its points scores all of them.
    """
    settings = {k: (s, b) for k, (s, b) in enumerate((s, b) for s in spacings for b in buffers)}
    close = near(cells.filter(known), max(buffers)).select("r", "c", F.col("d").alias("__d"))
    field = cells.select("r", "c", F.col(score).cast("double").alias("score"), (active if active is not None else F.lit(True)).alias("live"), known.alias("known"), truth.alias("truth"))
    field = settle(field.join(close, ["r", "c"], "left"), "grid_field")
    of = F.array_compact(F.array(*(F.when(F.col("__d").isNull() | (F.col("__d") > b), F.lit(k)) for k, (_, b) in settings.items())))
    dots = emit_groups(field.filter("NOT known").withColumn("setting", F.explode(of)), "score", "setting", {k: s for k, (s, _) in settings.items()})
    dots = settle(dots.filter(F.col("rank") <= max(budgets)).select("setting", "r", "c", "rank"), "grid_dots")
    marks = field.filter("live AND NOT known")
    live = settle(dots.join(marks.select("r", "c"), ["r", "c"], "left_semi"), "grid_live")
    truths = marks.filter("truth").select("r", "c")
    upto = lambda agg, x, name: [agg(F.when(F.col("rank") <= b, x)).alias(f"{name}_{b}") for b in budgets]
    given = spread(live, credit_offsets(), ["dr", "dc", "k"]).join(truths, ["r", "c"], "left_semi").groupBy("setting", "r", "c").agg(*upto(F.max, F.col("k"), "k"))
    tp = given.groupBy("setting").agg(*(F.sum(f"k_{b}").alias(f"tp_{b}") for b in budgets))
    seen = near(truths, RADIUS).select("r", "c", F.greatest(1 - F.col("d") / RADIUS, F.lit(0.0)).alias("k"))
    fp = live.join(seen, ["r", "c"], "left").groupBy("setting").agg(*upto(F.sum, 1 - F.coalesce("k", F.lit(0.0)), "fp"))
    n = dots.groupBy("setting").agg(*upto(F.count, F.lit(1), "n"))
    table = cells.sparkSession.createDataFrame([(k, float(s), float(b)) for k, (s, b) in settings.items()], "setting int, spacing double, buffer double")
    lines = F.explode(F.array(*(F.struct(F.lit(b).cast("long").alias("budget"), *(F.coalesce(f"{x}_{b}", F.lit(0)).cast("long" if x == "n" else "double").alias(x) for x in ("n", "tp", "fp"))) for b in budgets)))
    out = table.join(n, "setting", "left").join(tp, "setting", "left").join(fp, "setting", "left").select("spacing", "buffer", lines.alias("l")).select("spacing", "buffer", "l.*")
    out = out.crossJoin(F.broadcast(truths.agg(F.count(F.lit(1)).alias("n_truth"))))  # one row
    return out.withColumn("dti", F.when(F.col("n_truth") > 0, dti(F.col("tp"), F.col("fp"), F.col("n_truth") - F.col("tp"))).otherwise(0.0))


def budgets(cells: DataFrame, total: int, whole: Column | int) -> DataFrame:
    """(ordinal, budget): each cell's share of total by its active cells of whole, rounded half to even."""
    per = cells.groupBy("ordinal").agg(F.count(F.when(F.col("active"), 1)).alias("n"))
    return per.select("ordinal", F.bround(total * F.col("n") / whole, 0).cast("long").alias("budget"))


def paired_scores(cells: DataFrame, fields: tuple[str, str], truth: str, known: str, budget: DataFrame, spacing: float = 2.7, buffer: float = 2.0) -> DataFrame:
    """Per locked cell: budget, points and index of both fields, emitted and measured alike, and whether the first wins strictly.

    cells: (r, c, ordinal, active, both fields, truth, known). Points keep
    buffer from known cells; known cells don't count.
    """
    live = settle(cells.filter(F.col("active")), "locked")
    close = near(cells.filter(F.col(known)), buffer).select("r", "c")
    allowed = live.join(close, ["r", "c"], "left_anti")
    out = budget
    for side, field in zip(("a", "b"), fields, strict=True):
        dots = emit_by(allowed.select("r", "c", "ordinal", field), field, "ordinal", spacing).join(F.broadcast(budget), "ordinal").filter(F.col("rank") <= F.col("budget"))  # a row per locked cell
        marked = live.filter(~F.col(known)).join(dots.select("r", "c", "ordinal", F.lit(1.0).alias("__p")), ["r", "c", "ordinal"], "left").fillna(0.0, ["__p"])
        score = parts(marked, "__p", truth, by=("ordinal",)).select("ordinal", F.col("n_pred").alias(f"dots_{side}"), F.col("n_truth").alias(f"truth_{side}"), *(F.col(x).alias(f"{x}_{side}") for x in ("tp", "fp", "fn", "dti")))
        out = out.join(score, "ordinal", "left")
    filled = {f"{x}_{s}": 0.0 for x in ("tp", "fp", "fn", "dti") for s in "ab"} | {f"{x}_{s}": 0 for x in ("dots", "truth") for s in "ab"}
    return out.fillna(filled).withColumn("win", F.col("dti_a") > F.col("dti_b"))


def diagnostics(cells: DataFrame, pred: str, truth: str, by: tuple[str, ...] = (), radius: float = 3.0) -> DataFrame:
    """parts, with truth_covered (truth cells within radius of a predicted one), coverage (their share), hits (predicted cells within radius of truth) and hit_rate, per fold."""
    keys = [*by, "r", "c"]
    t, p = cells.filter(F.col(truth)).select(*keys), cells.filter(F.col(pred) > 0).select(*keys)
    from ..functions.kernels import offsets
    from .distance import spread

    def within(points: DataFrame, others: DataFrame, name: str) -> DataFrame:
        around = spread(others, offsets(radius), ["dr", "dc", "d"]).select(*keys).distinct().withColumn("__hit", F.lit(1))
        return points.join(around, keys, "left").groupBy(*by).agg(F.count("__hit").alias(name))

    covered, hit = within(t, p, "truth_covered"), within(p, t, "hits")
    out = parts(cells, pred, truth, by=by)
    out = out.join(covered, list(by), "left").join(hit, list(by), "left") if by else out.crossJoin(covered).crossJoin(hit)  # one row each without folds
    out = out.fillna(0, ["truth_covered", "hits"])
    return out.withColumns({"coverage": F.col("truth_covered") / F.greatest("n_truth", F.lit(1)), "hit_rate": F.col("hits") / F.greatest("n_pred", F.lit(1))})


def two_instruments(cells: DataFrame, pred: str, instruments: dict[str, tuple[str, Column]], by: str) -> DataFrame:
    """Per instrument: mean index and hit rate of its folds, and the pooled figures with that instrument's known cells left out.

    instruments: name -> (truth column, condition of known cells).
    """
    out = None
    for name, (truth, known) in instruments.items():
        domain = cells.filter(~known)
        folds = diagnostics(domain, pred, truth, (by,)).agg(F.avg("dti").alias("mean_dti"), F.avg("hit_rate").alias("mean_hit_rate"), F.count(F.lit(1)).alias("folds"))
        whole = diagnostics(domain, pred, truth).select(*(F.col(x).alias(f"pooled_{x}") for x in ("tp", "fp", "fn", "n_truth", "n_pred")), (F.col("tp") / (F.col("tp") + ALPHA * F.col("fp") + BETA * F.col("fn") + EPSILON)).alias("pooled_dti"), "truth_covered", "coverage", "hits", "hit_rate")
        row = folds.crossJoin(whole).select(F.lit(name).alias("instrument"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def holdout(df: DataFrame, foot: Column, mask: Column, block: Column, share: float = 0.25, seed: int = 11, collar: int = 2, erosion: int = 0) -> DataFrame:
    """df with block, truth, known and active of a holdout of whole components: a share of each block's cells is hidden; what is visible, and collar steps around it, is known.

    active: in the footprint, not known, and further than erosion steps from
    what is outside of the footprint.
    """
    from .holdout import domains, hide

    labelled = settle(components(df.filter(mask & foot).select("r", "c")), "labelled")
    hidden = settle(hide(labelled, block, share, seed), "hidden")
    out = domains(df.withColumn("block", block), labelled, hidden, collar)
    active = foot & ~F.col("known")
    if erosion:
        rim = dilate(df.filter(~foot), erosion).select("r", "c", F.lit(True).alias("__rim"))
        out = out.join(rim, ["r", "c"], "left")
        active = active & F.col("__rim").isNull()
    out = out.withColumn("active", active).drop("__rim")
    return out.withColumn("truth", F.col("truth") & F.col("active"))


def away_from(df: DataFrame, mask: Column) -> DataFrame:
    """df with d, the exact distance to the nearest marked cell."""
    return distance(df, mask).withColumn("d", F.sqrt("d2")).drop("d2", "fr", "fc")
