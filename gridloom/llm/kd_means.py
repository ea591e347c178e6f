"""Centroid clustering by kd-tree filtering, in exact integers.

Each block of a partition's vectors gets a kd-tree whose nodes hold the count,
the integer sums and the box of their vectors. In a round the centroids walk
down a tree: one that is farther than another from all of a node's box is
pruned there; a node with one candidate left is assigned whole, by its sums;
leaves with several are resolved vector by vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_at

DIM, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Vectors in a tree and in a leaf, at most.
BLOCK, LEAF = 4096, 16
#: Integers below NARROW stand in trees and have squared distances in 64 bits; products of those below FLOAT are exact in doubles (for up to 128 components).
NARROW, FLOAT = 1 << 26, 1 << 22
#: Sums leave a task in digits of so many bits, which Spark adds up exactly.
DIGIT = 60
_TREE = "ids array<long>, narrow boolean, vectors binary, lo binary, hi binary, sums binary, shape binary"


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and nodes (start, end, left child or -1) of a kd-tree: halves at the median of the widest side; children stand side by side."""
    order, nodes, at = np.arange(len(x)), [[0, len(x), -1]], 0
    while at < len(nodes):
        start, end, _ = nodes[at]
        if end - start > LEAF:
            part = x[order[start:end]]
            side = part[:, int(np.argmax(part.max(0) - part.min(0)))]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(side, half)]
            nodes[at][2] = len(nodes)
            nodes += [[start, start + half, -1], [start + half, end, -1]]
        at += 1
    return order, np.array(nodes, np.int64)


class Tree:
    """The kd-tree of a block, as it is stored: vectors in tree order, nodes with boxes, sums, and (start, end, left)."""

    def __init__(self, row: dict, dim: int):
        self.x = np.frombuffer(row["vectors"], np.int32).reshape(-1, dim)
        self.lo, self.hi = (np.frombuffer(row[c], np.int32).reshape(-1, dim) for c in ("lo", "hi"))
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dim)
        self.start, self.end, self.left = np.frombuffer(row["shape"], np.int64).reshape(-1, 3).T

    def filtered(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that one centroid owns and which; leaves that several may own and a mask of them. c: centroids in a type that is exact here."""
        kind = c.dtype
        norm = (c * c).sum(1)
        most = np.inf if kind == np.float64 else np.iinfo(np.int64).max
        whole, owner, leaves, masks = [], [], [], []
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            lo, hi = self.lo[nodes].astype(kind), self.hi[nodes].astype(kind)
            star = np.argmin(np.where(may, norm - (lo + hi) @ c.T, most), 1)  # nearest to the middle of the box
            for s in np.unique(star).tolist():
                mine = np.flatnonzero(star == s)
                way = c - c[s]
                farthest = hi[mine] @ np.maximum(way, 0).T + lo[mine] @ np.minimum(way, 0).T  # the box's corner that lies most towards each
                may[mine] &= norm - norm[s] - 2 * farthest <= 0  # above 0: all of the box is strictly nearer to s
            one, leaf = may.sum(1) == 1, self.left[nodes] < 0
            whole.append(nodes[one])
            owner.append(np.argmax(may[one], 1))
            leaves.append(nodes[~one & leaf])
            masks.append(may[~one & leaf])
            down = ~one & ~leaf
            left = self.left[nodes[down]]
            nodes, may = np.concatenate((left, left + 1)), np.concatenate((may[down], may[down]))
        return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves), np.concatenate(masks)

    def resolved(self, c: np.ndarray, leaves: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the leaves and the nearest candidate of each; ties go to the smaller number."""
        sizes = self.end[leaves] - self.start[leaves]
        rows = np.arange(int(sizes.sum())) + np.repeat(self.start[leaves] - (np.cumsum(sizes) - sizes), sizes)
        near = (c * c).sum(1) - 2 * (self.x[rows].astype(c.dtype) @ c.T)
        return rows, np.argmin(np.where(np.repeat(masks, sizes, 0), near, np.inf if c.dtype == np.float64 else np.iinfo(np.int64).max), 1)


def _stored(ids: pa.Array, x: np.ndarray, scale: int) -> Iterator[dict]:
    """Rows of the table of trees for a block of vectors: what is narrow in a tree, the rest as it came."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    narrow = (np.abs(v) < NARROW).all(1)
    for some in (np.flatnonzero(narrow), np.flatnonzero(~narrow)):
        if not len(some):
            continue
        if narrow[some[0]]:
            y = v[some].astype(np.int32)
            order, nodes = build(y)
            y = np.ascontiguousarray(y[order])
            begin = np.concatenate((np.zeros((1, y.shape[1]), np.int64), np.cumsum(y, 0, dtype=np.int64)))
            lo, hi = (np.stack([f(y[a:b], axis=0) for a, b, _ in nodes.tolist()]) for f in (np.min, np.max))
            yield {"ids": ids.take(pa.array(some[order])).to_pylist(), "narrow": True, "vectors": y.tobytes(), "lo": lo.tobytes(), "hi": hi.tobytes(), "sums": (begin[nodes[:, 1]] - begin[nodes[:, 0]]).tobytes(), "shape": nodes.tobytes()}
        else:
            yield {"ids": ids.take(pa.array(some)).to_pylist(), "narrow": False, "vectors": x[some].tobytes(), "lo": None, "hi": None, "sums": None, "shape": None}


def _whole_number(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is too large for a double."""
    y = x * scale
    return int(np.floor(y)) if np.isfinite(y) else int(x) * scale


def _assigned(row: dict, centroids: list[list[int]], scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one stored block: vectors as integers, the cluster of each, and counts and sums per cluster (k rows of 1 + dim)."""
    k, dim = len(centroids), len(centroids[0])
    largest = max((abs(v) for c in centroids for v in c), default=0)
    totals = np.zeros((k, 1 + dim), object)
    if row["narrow"] and largest < NARROW:
        tree = Tree(row, dim)
        fits = dim <= 128 and largest < FLOAT and np.abs(np.stack((tree.lo[0], tree.hi[0])).astype(np.int64)).max() < FLOAT
        c = np.array(centroids, np.int64).astype(np.float64 if fits else np.int64)
        whole, owner, leaves, masks = tree.filtered(c)
        rows, nearest = tree.resolved(c, leaves, masks)
        cluster = np.empty(len(tree.x), np.int64)
        for node, own in zip(whole.tolist(), owner.tolist(), strict=True):
            cluster[tree.start[node] : tree.end[node]] = own
        cluster[rows] = nearest
        for j in range(k):
            own, some = whole[owner == j], rows[nearest == j]
            totals[j, 0] = int((tree.end[own] - tree.start[own]).sum()) + len(some)
            totals[j, 1:] = (tree.sums[own].sum(0) + tree.x[some].sum(0, dtype=np.int64)).tolist()
        return tree.x, cluster, totals
    # numbers beyond 64 bits: plain integers, vector by vector
    if row["narrow"]:
        x = np.frombuffer(row["vectors"], np.int32).reshape(-1, dim).astype(object)
    else:
        x = np.array([[_whole_number(v, scale) for v in r] for r in np.frombuffer(row["vectors"], np.float64).reshape(-1, dim).tolist()], object)
    c = np.array(centroids, object)
    near = np.array([[int(((v - z) ** 2).sum()) for z in c] for v in x], object)
    cluster = np.array([min(range(k), key=lambda j, d=d: (d[j], j)) for d in near], np.int64)
    for j in range(k):
        some = x[cluster == j]
        totals[j, 0], totals[j, 1:] = len(some), some.sum(0) if len(some) else 0
    return x, cluster, totals


def _digits(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _next(trees: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Floors of the means of each centroid's vectors; what is nobody's nearest stays. A task sends a row for each digit of its sums; a row for each digit comes to the driver."""
    k, dim = len(centroids), len(centroids[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, 1 + dim), object)
        for row in _rows(batches):
            totals = totals + _assigned(row, centroids, scale)[2]
        out = [(j, d, n, v) for j in range(k) for d in range(1 + dim) for n, v in enumerate(_digits(int(totals[j, d])))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "d", "n", "v"])

    sums = trees.mapInArrow(partial, "c int, d int, n int, v long").groupBy("c", "d", "n").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    totals = [[0] * (1 + dim) for _ in range(k)]
    for r in sums.collect():
        totals[r.c][r.d] += int(r.v) << (DIGIT * r.n) if r.v >= 0 else -(int(-r.v) << (DIGIT * r.n))
    return [[v // t[0] for v in t[1:]] if t[0] else c for t, c in zip(totals, centroids, strict=True)]


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, count: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for every vector of dim finite components.

    Other rows (null vectors, other lengths, null or non-finite components)
    are left out. A component x counts as the integer floor(scale * x).
    Centroids start as the vectors with the smallest sha256 of
    `salt:<vec_id>`; rows that repeat an id come in the order of their
    vectors, rows without an id last. With fewer vectors than `count` there
    are as many clusters as vectors; an empty table gives an empty table. Each
    round assigns every vector to the nearest centroid (ties: the smaller
    number) and moves each centroid that has vectors to the floor of their
    mean; rounds end early where nothing moves. All sums and distances are
    exact at any size of a component; a distance, or a sum of distances, that
    no long can hold is null. Other columns are not read.

    The trees are written once, and each round reads them: a lost executor
    costs its tasks. What a round brings to the driver are the sums of all
    centroids.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.coalesce((F.size("v") == dim) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False)))
    drawn = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(count).collect()
    centroids = [[_whole_number(x, scale) for x in r.v] for r in drawn]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"ids": pa.list_(pa.int64()), "narrow": pa.bool_()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                stored = list(_stored(part.column(0), part.column(1).flatten().to_numpy().reshape(-1, dim), scale))
                names = [c.split()[0] for c in _TREE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([s[c] for s in stored], types.get(c, pa.binary())) for c in names], names=names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = np.array(centroids, object)
        for row in _rows(batches):
            x, cluster, _ = _assigned(row, centroids, scale)
            if x.dtype == object:
                far = [int(((v - fixed[j]) ** 2).sum()) for v, j in zip(x, cluster.tolist(), strict=True)]
            else:
                far = ((x.astype(np.int64) - fixed[cluster].astype(np.int64)) ** 2).sum(1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array([d if d < 1 << 63 else None for d in far], pa.int64())], names=["vec_id", "cluster", "distance"])

    trees, at = keep_at(rows.mapInArrow(plant, _TREE), "kd_trees")
    for _ in range(rounds if centroids else 0):
        moved = _next(trees, centroids, scale)
        if moved == centroids:
            break
        centroids = moved
    found, _ = keep_at(trees.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    discard(spark, at)
    whole = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))
    per_cluster = found.groupBy("cluster").agg(whole("distance").alias("sum"))
    total = per_cluster.agg(whole("sum").try_cast("long").alias("inertia"))
    prints = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids or [[]]))
    facts = per_cluster.select("cluster", F.col("sum").try_cast("long").alias("cluster_inertia"), F.get(prints, F.col("cluster")).alias("centroid_sha256")).crossJoin(F.broadcast(total))  # a row for each cluster, and one
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
