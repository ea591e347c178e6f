"""Blocked out-of-fold classifiers: a cell is scored by models that saw nothing of its block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import boosting
from .sampling import fold_samples

#: The recipe of the boosted trees: rounds, shrinkage, leaves, ridge; seeds whose models are averaged.
RECIPE = {"rounds": 250, "rate": 0.08, "leaves": 31, "l2": 1.0, "least": 20}
SEEDS = (0, 1, 2)


def _fitted(samples: DataFrame, folds: list[int], seeds: tuple[int, ...], features: list[str], recipe: dict) -> list:
    """The models of all folds and seeds, fitted at once, a task each."""
    labelled = samples.withColumn("label", (F.col("pool") == "positive").cast("int"))
    return settle(boosting.fit(labelled, {"fold": folds, "seed": list(seeds)}, features, **(RECIPE | recipe)), "models").collect()  # bounded by folds, seeds, rounds and leaves


def out_of_fold(cells: DataFrame, features: list[str], label: Column, fold: str, folds: int, most: int = 90_000, negatives: int | None = None, seeds: tuple[int, ...] = SEEDS, **recipe) -> DataFrame:
    """(r, c, fold, label, prob): prob is the mean over seeds of models fitted on samples of the other folds.

    A model learns from most rows of a class at most, drawn without
    replacement and balanced: as many of either class as the rarer one has;
    with negatives, from up to so many negatives instead. A fold whose others
    hold one class only gets that class; without any rows it gets 0.
    """
    def sizes(n: dict[str, int]) -> dict[str, int]:
        p, q = n.get("positive", 0), n.get("negative", 0)
        if negatives is not None:
            return {"positive": min(p, most), "negative": min(q, negatives)}
        m = min(p, q, most) if p and q else most
        return {"positive": min(m, p), "negative": min(m, q)}

    data = cells.select("r", "c", F.col(fold).cast("int").alias("fold"), label.cast("int").alias("label"), *features)
    pool = F.when(F.col("label") == 1, "positive").otherwise("negative")
    samples = fold_samples(data.select("r", "c", F.col("fold").alias("own"), "label", *features), F.array("own"), pool, list(range(folds)), list(seeds), sizes)
    return boosting.score(data, ["r", "c", "fold", "label"], features, F.col("fold"), _fitted(samples, list(range(folds)), seeds, features, recipe))


def discriminant(cells: DataFrame, features: list[str], positive: Column, block: str, blocks: int, rows: int = 90_000, least: int = 500, ring: tuple[float, float] = (1.0, 6.0), seeds: tuple[int, ...] = (0,), **recipe) -> DataFrame:
    """(r, c, block, label, prob): a cell's chance of being positive, by trees that saw nothing of its block.

    Half of the negatives lie in a ring around positives, half are background.
    A block whose others have fewer than least positives or ring cells gets 0.
    """
    from .evaluate import negative_pools

    def sizes(n: dict[str, int]) -> dict[str, int]:
        if min(n.get("positive", 0), n.get("hard", 0)) < least:
            return {}
        m = min(n["positive"], rows)
        hard = min(n["hard"], m, rows // 2)
        return {"positive": m, "hard": hard, "background": min(m - hard, n.get("background", 0))}

    pooled = negative_pools(cells.withColumn("label", positive.cast("int")), positive, ring, int(ring[1]))
    pool = F.when(F.col("label") == 1, "positive").when(F.col("hard"), "hard").when(F.col("background"), "background")
    data = settle(pooled.select("r", "c", F.col(block).cast("int").alias("block"), "label", pool.alias("pool"), *features), "pools")
    samples = fold_samples(data, F.array("block"), F.col("pool"), list(range(blocks)), list(seeds), sizes)
    return boosting.score(data, ["r", "c", "block", "label"], features, F.col("block"), _fitted(samples, list(range(blocks)), seeds, features, recipe))


def fold_pools(df: DataFrame, labelled: DataFrame, locked: DataFrame, hidden: DataFrame, ordinals: list[int], collar: int) -> DataFrame:
    """df's footprint with pool (positive: of the catalogue; negative) and unseen: the folds that must not learn from a cell.

    A fold sees nothing of its locked cell widened by collar. A component that
    is hidden from a fold is neither positive nor negative for it.
    """
    boxes = locked.filter(F.col("ordinal").isin(ordinals)).groupBy("ordinal").agg(*(f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in "rc")).collect()  # four numbers per fold
    inside = [F.when(F.col("r").between(b.min_r - collar, b.max_r + collar) & F.col("c").between(b.min_c - collar, b.max_c + collar), F.lit(b.ordinal)) for b in boxes]
    gone = hidden.filter(F.col("ordinal").isin(ordinals)).groupBy("comp").agg(F.collect_set("ordinal").alias("hid"))  # as many as folds
    marks = labelled.select("r", "c", "comp").join(gone, "comp", "left").select("r", "c", F.lit("positive").alias("pool"), "hid")
    out = df.filter("foot").join(marks, ["r", "c"], "left")
    none = F.array().cast("array<int>")
    some = F.array_sort(F.array_union(F.array_compact(F.array(*inside).cast("array<int>")), F.coalesce("hid", none)))
    unseen = F.when(F.col("hid").isNotNull() | F.coalesce(*inside, F.lit(None)).isNotNull(), some).otherwise(none)  # most cells are seen by all
    return out.withColumns({"pool": F.coalesce("pool", F.lit("negative")), "unseen": unseen}).drop("hid")


def locked_comparator(df: DataFrame, features: list[str], labelled: DataFrame, locked: DataFrame, hidden: DataFrame, ordinals: list[int], collar: int, most: int = 90_000, seeds: tuple[int, ...] = SEEDS, **recipe) -> DataFrame:
    """(r, c, ordinal, prob) of the active cells of each locked cell, by trees fitted on what its fold may see (fold_pools): as many rows of either class, most at most."""
    def sizes(n: dict[str, int]) -> dict[str, int]:
        m = min(n.get("positive", 0), n.get("negative", 0), most)
        return {"positive": m, "negative": m}

    pools = fold_pools(df.select("r", "c", "foot", *features), labelled, locked, hidden, ordinals, collar)
    samples = fold_samples(pools.drop("foot"), F.col("unseen"), F.col("pool"), ordinals, list(seeds), sizes)
    active = df.join(locked.filter(F.col("ordinal").isin(ordinals) & F.col("active")).select("r", "c", "ordinal"), ["r", "c"])
    return boosting.score(active, ["r", "c", "ordinal"], features, F.col("ordinal"), _fitted(samples, ordinals, seeds, features, recipe), tasks=df.sparkSession.sparkContext.defaultParallelism)


def block_auc(scored: DataFrame, fold: str, least: int = 50) -> DataFrame:
    """Area under the curve in each fold with at least so many positives: counts per distinct value, then sums below it within the fold."""
    from .ordered import ordered, running

    per = scored.groupBy(fold, "prob").agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"))
    per = running(ordered(per, fold, "prob"), F.col("n"), "below", "all")
    first = per.groupBy(fold).agg(F.min("below").alias("first"))
    wins = per.join(first, fold).withColumn("w", F.col("p") * (F.col("below") - F.col("first") + F.col("n") / 2))
    return wins.groupBy(fold).agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives")).filter(F.col("positives") >= least)
