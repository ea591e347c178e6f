"""MinHash near-duplicates by min-max hashing.

Each permutation of a document's shingles gives two values of its signature,
the smallest and the largest, so 64 hash evaluations a shingle give 128
values. Bands of four make candidates; every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, mix, slices, word_hashes
from .graph import components

#: Permutations, and signature values in a band: 2 * 64 / 4 = 32 bands miss a pair at 0.75 with a chance of (1 - 0.75**4)**32, 5 in a million.
PERMUTATIONS, ROWS = 64, 4
SHINGLE, PERCENT = 5, 75
#: Documents in a block of a cluster, and about how many rows go to one group of blocks.
BLOCK, GROUP_ROWS = 1024, 2000

_rng = np.random.Generator(np.random.PCG64(9))
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(rows: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes; with fewer words, the whole sequence as one; none without words."""
    h, begin = word_hashes(rows)
    n = len(h)
    whole = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        whole += h[j : n - size + 1 + j] * _PLACE[j] if n >= size else np.uint64(0)
    whole = mix(whole)
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(whole[lo : hi - size + 1])
        elif hi > lo:
            yield mix((h[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
        else:
            yield np.empty(0, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The band hashes of a set: smallest and largest value under each permutation, four values to a band."""
    low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 2048):
        v = shingles[i : i + 2048, None] * _A + _B
        np.minimum(low, v.min(0), out=low)
        np.maximum(high, v.max(0), out=high)
    values = np.stack((low, high), 1).reshape(-1, ROWS)
    return mix((mix(values) * _PLACE[:ROWS]).sum(1, dtype=np.uint64))


def signatures(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set (fp1, fp2) and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column(1)):
                n, fp1, fp2, sig = [], [], [], []
                for s in shingle_sets(rows):
                    n.append(len(s))
                    fp1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    fp2.append(int(mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(bands(s).view(np.int64) if len(s) else np.empty(0, np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sig]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sig)))], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def full_sets(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, a print of the set (fp), and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column(1)):
                sets = list(shingle_sets(rows))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                prints = pa.array([int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), prints, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "fp", "shingles"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "id long, fp long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets share at least percent of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    na, nb, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    near = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * both >= percent * (na + nb - both))
    return pairs.join(right, "b").join(left, "a").filter(near).select("a", "b")


def _links_in(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """One link (a, b) for each two components that have one, between the documents of two blocks."""
    sets = [*a.shingles, *b.shingles]
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1  # a shingle of one document is in no intersection
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)[shared]
    _, col = np.unique(code[shared], return_inverse=True)
    both = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        x, y = np.searchsorted(col, (lo, lo + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[x:y], col[x:y] - lo] = 1
        both += part[: len(a)] @ part[len(a) :].T
    both = both.astype(np.int64)
    union = size[: len(a), None] + size[len(a) :] - both
    ca, cb = a.c.to_numpy(), b.c.to_numpy()
    i, j = np.nonzero((100 * both >= percent * union) & (ca[:, None] != cb))
    if not len(i):
        return []
    _, one = np.unique(np.stack((np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j]))), axis=1, return_index=True)
    return list(zip(a.id.to_numpy()[i[one]].tolist(), b.id.to_numpy()[j[one]].tolist(), strict=True))


def refined(docs_of: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Clusters (id, c, cluster) parted further: only documents that share a rare shingle can be linked.

    Of two sets with at least percent of their union in common, each shares
    ceil(percent * n / 100) of its n shingles with the other. In any order of
    shingles the first n - ceil(...) + 1 of the one then meet those of the
    other. The order is by how many documents of the cluster hold a shingle,
    rare ones first, so a line that a cluster has in common binds nobody.
    Documents whose rare shingles no other component holds drop out.
    """
    size = F.size("shingles")
    rows = docs_of.join(sets, "id").select("id", "fp", "c", "cluster", (size - F.ceil(size * percent / 100) + 1).alias("room"), F.explode("shingles").alias("token"))
    rows = keep(rows, "cluster_shingles")
    often = rows.groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("often"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("often > 1")
    mine = rows.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("all"))
    shared = rows.join(often, ["cluster", "token"])
    # shingles that nobody else holds come first in the order and take up room
    w = Window.partitionBy("id", "fp")
    alone = F.col("all") - F.count(F.lit(1)).over(w)
    first = shared.join(mine, ["id", "fp"]).withColumn("place", F.row_number().over(w.orderBy("often", "token")) + alone).filter("place <= room AND lo < hi").select("id", "c", "cluster", "token")
    first = keep(first, "rare_shingles")
    meeting = first.groupBy("cluster", "token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("head")).filter("lo < hi").select("cluster", "token", "head")
    linked = keep(first.join(meeting, ["cluster", "token"]).select("id", "c", "head").distinct(), "rare_meetings")
    parted = components(linked.select(F.col("head").alias("a"), F.col("id").alias("b")))
    return linked.groupBy("id").agg(F.min("c").alias("c")).join(parted, "id", "left").select("id", "c", F.coalesce("component", "id").alias("cluster"))


def across(docs_of: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members of different components (c) of a cluster: at least one for each two components that have any.

    A cluster is dealt in blocks, and each two blocks of it meet once. Pairs
    of blocks go to groups, whose number follows the rows with all repeats, so
    a group holds a few thousand sets on average, however large a cluster is.
    """
    counts = keep(docs_of.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "cluster_blocks")
    total = counts.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    groups = max(12, total // GROUP_ROWS)
    placed = docs_of.join(counts.drop("n"), "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("id", "c", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = placed.withColumn("g", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for (_, i, j), part in rows.drop_duplicates(["id", "fp", "cluster", "i", "j"]).groupby(["cluster", "i", "j"], sort=False):
            out += _links_in(part[part.own == i], part[part.own == j], percent)
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.join(sets, "id").groupBy("g").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents without words (and null texts) have no shingles and link with
    nothing. A row with a null doc_id links with nothing either: its
    component_id is null and it is kept. Rows that repeat a doc_id are one
    document, whatever their texts: what links with one of them links with
    all. Other columns are not read. An empty table gives an empty table.

    Equal sets are merged first (by partial aggregation), so copies never
    meet. In each bucket of a band every member is compared with one member.
    After the confirmed links have been joined to components, most buckets
    hold one component and are done. Documents of the others form clusters
    (buckets that share documents), which are parted by the rare shingles of
    their members; what then is left of a cluster is compared in blocks, and
    only links between different components come out. Where a group is alike
    the comparisons follow its size. Where many documents are almost but not
    quite alike (they share rare shingles and reach no link), the blocks of
    that cluster all meet: that work grows with the square of the cluster,
    in tasks of bounded size. No link between different texts is left out.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = keep(signatures(docs, "text", "doc_id"), "signatures")
    classes = keep(sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id")), "classes")
    heads = sig.withColumnRenamed("doc_id", "id").join(classes, ["id", "fp1", "fp2"], "left_semi")
    spread = heads.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("key"))
    shared = keep(spread.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("hi")).filter("pivot < hi").drop("hi"), "shared_buckets")
    members = keep(spread.join(shared, "key").select("key", "pivot", "id"), "members")
    involved = keep(members.select("id").distinct(), "involved")
    sets = keep(full_sets(docs.join(involved, docs["doc_id"] == involved["id"], "left_semi"), "text", "doc_id"), "sets")
    pairs = keep(members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = keep(confirmed(pairs, sets, percent), "confirmed")
    comp = keep(components(links), "components")
    # buckets that still hold several components: their documents are compared in blocks, cluster by cluster
    where = members.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    where = keep(where, "bucket_components")
    several = keep(where.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("head")).filter("lo < hi").select("key", "head"), "several")
    open_ = keep(where.join(several, "key"), "open_buckets")
    if open_.limit(1).count():
        cluster = components(open_.select(F.col("head").alias("a"), F.col("id").alias("b")))
        docs_of = open_.groupBy("id").agg(F.min("c").alias("c")).join(cluster, "id", "left").select("id", "c", F.coalesce("component", "id").alias("cluster"))
        docs_of = keep(refined(keep(docs_of, "clusters"), sets, percent), "parted_clusters")
        found = keep(across(docs_of, sets, percent), "across")
        if found.limit(1).count():
            comp = keep(components(links.unionByName(found)), "components")
    named = keep(classes.join(comp, "id", "left").select("fp1", "fp2", F.coalesce("component", "id").alias("class_component")), "named_classes")
    out = sig.drop("bands").join(named, ["fp1", "fp2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_component"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")) | F.col("doc_id").isNull())
