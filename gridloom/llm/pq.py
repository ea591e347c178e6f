"""Embedding near-duplicates by product quantisation.

Unit vectors go to coarse inverted lists; their residuals are coded subspace
by subspace. A query looks into every list that can hold a neighbour, reads
its distances from tables, and reranks by exact cosine what they leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .graph import components

#: Vectors that the index is fitted on at most, vectors of a label to a list aimed at, lists at most (eight vectors of the sample to each), codes of a subspace, queries or members in a block.
FIT_ROWS, LIST_ROWS, LISTS, CODES, BLOCK = 20_000, 200, 2500, 64, 4096


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that no square overflows or vanishes; cosines stay what they are."""
    _, exponent = np.frexp(np.abs(raw).max(1))
    return np.ldexp(raw, -exponent[:, None])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((c * c).sum(1) - 2 * y @ c.T, 1) for y in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks; fitted on a bounded sample, small enough to broadcast."""

    def __init__(self, sample: np.ndarray, lists: int, codes: int = CODES):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        self.cuts = np.array_split(np.arange(self.dim), min(8, self.dim))
        rest = sample - self.coarse[self.nearest(sample)[0]]
        self.books = [kmeans(rest[:, cut], codes) for cut in self.cuts]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        return d.argmin(1), d

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the length of what the codes leave out."""
        codes = np.stack([np.argmin((b * b).sum(1) - 2 * rest[:, cut] @ b.T, 1) for cut, b in zip(self.cuts, self.books, strict=True)], 1)
        made = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest[:, np.concatenate(self.cuts)] - made) ** 2).sum(1))

    def probes(self, d: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Lists that a vector looks into: its own, and those whose plane between the two centroids lies within reach.

        Two vectors of different lists stand on either side of the plane
        between their centroids, and together no further from it than they are
        apart. So one of the two is within half that distance and looks into
        the list of the other: half the radius of the threshold misses no pair.
        """
        c = self.coarse
        apart = np.sqrt(np.maximum((c[own] ** 2).sum(1)[:, None] + (c * c).sum(1) - 2 * c[own] @ c.T, 1e-18))
        return (d - d[np.arange(len(d)), own][:, None]) / (2 * apart) <= reach + 1e-6

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        return [(b * b).sum(1) - 2 * rest[:, cut] @ b.T + (rest[:, cut] ** 2).sum(1)[:, None] for cut, b in zip(self.cuts, self.books, strict=True)]


_EMPTY = {"id": "int64", "other": "int64", "links": "int64"}


def _block(rows: pd.DataFrame, index: Index, at: int, threshold: float, kind: type) -> pd.DataFrame:
    """One block of queries against one block of members of list at: numbers of links, and enough links to hold components together.

    A pair of vectors of two lists that look into each other's list is met
    twice; the list with the smaller number counts it.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    q, x = rows[rows["query"]].reset_index(drop=True), rows[~rows["query"]].reset_index(drop=True)
    if not len(q) or not len(x):
        return pd.DataFrame({k: pd.Series(dtype=t) for k, t in _EMPTY.items()})
    raw_q, raw_x = (scaled(np.stack(t.vector.map(lambda v: np.frombuffer(v, kind))).astype(np.float64)) for t in (q, x))
    len_q, len_x = np.sqrt((raw_q * raw_q).sum(1)), np.sqrt((raw_x * raw_x).sum(1))
    codes = np.stack(x.code.map(lambda v: np.frombuffer(v, np.uint8)))
    error, copies, ids, queries, q_copies, own = x.error.to_numpy(), x.copies.to_numpy(), x.id.to_numpy(), q.id.to_numpy(), q.copies.to_numpy(), q.own.to_numpy()
    looks = np.zeros((len(x), len(index.coarse)), bool)  # lists that each member looks into itself
    for i, p in enumerate(x.looks):
        looks[i, np.frombuffer(p, np.int32)] = True
    first = np.full(len(q), -1, np.int64)
    links, back = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
    root = np.arange(len(x))  # members that share a query hang together
    for i in range(0, len(q), 256):
        part = slice(i, i + 256)
        table = index.tables(raw_q[part] / len_q[part, None] - index.coarse[at])
        far = np.zeros((len(raw_q[part]), len(x)))
        for s, t in enumerate(table):
            far += t[:, codes[:, s]]
        near = np.sqrt(np.maximum(far, 0)) - error <= radius + 1e-6
        if at != 0:  # pairs that the other list counts
            near &= ~((own[part, None] < at) & looks[:, own[part]].T)
        cols = np.flatnonzero(near.any(0))
        if not len(cols):
            continue
        cosine = raw_q[part] @ raw_x[cols].T / (len_q[part, None] * len_x[cols])
        hit = near[:, cols] & (cosine >= threshold) & (queries[part, None] != ids[cols])
        links[part] = hit.astype(np.int64) @ copies[cols]
        back[cols] += (hit & (own[part, None] != at)).astype(np.int64).T @ q_copies[part]  # within a list the other order counts the member's
        for k in np.flatnonzero(hit.any(1)):
            h = cols[np.flatnonzero(hit[k])]
            first[i + k] = h[0]
            roots = np.unique(root[h])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    found, joined = first >= 0, np.flatnonzero((root != np.arange(len(x))) | (back > 0))
    return pd.concat([pd.DataFrame({"id": queries[found], "other": ids[root[first[found]]], "links": links[found]}), pd.DataFrame({"id": ids[joined], "other": ids[root[joined]], "links": back[joined]})])


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: links join vectors of one label with a cosine of at least threshold.

    Vectors that are null, empty, zero, or hold a null or non-finite component,
    and rows with a null label, link with nothing (component_id is their own
    id). Vectors of different lengths never link. Rows with a null id take no
    part: n_links 0, component_id null, kept. Rows that repeat an id count as
    rows of one component. Other columns are not read; an empty table gives an
    empty table.

    Equal vectors of a label are merged before they are compared. A label is
    compared with itself only, list by list, in blocks of queries and members,
    so a task holds two blocks at most. Recall is whole by construction (see
    Index.probes), and a table's distance is only believed less the vector's
    own coding error. Lists follow the size of the largest label up to LISTS;
    beyond 500,000 vectors of one label the lists grow, and work faster than
    the input. A label whose vectors are nearly all alike needs all its
    comparisons: their number is part of the result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sane = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("sane", F.coalesce(sane, F.lit(False)))
    good = rows.filter("sane")
    classes = keep(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector_classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    u = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = [r.v for r in classes.filter(u < min(1.0, fit_rows / max(n, 1))).orderBy("id").limit(fit_rows).select("v").collect()]
    unit = np.zeros((max(len(sample), 1), dim))
    for i, v in enumerate(sample):
        unit[i, : len(v)] = v
    if sample:
        unit = scaled(unit)
        unit /= np.sqrt((unit * unit).sum(1))[:, None]
    index = Index(unit, int(min(LISTS, max(1, largest // LIST_ROWS), max(1, len(unit) // 8))))
    shared = spark.sparkContext.broadcast(index)  # LISTS * dim and CODES * dim doubles at most
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) / 2
    single = df.schema[vector].dataType.elementType.simpleString() == "float"  # vectors travel in the width they came in
    width = np.float32 if single else np.float64

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                lists = b.column(3)
                sizes = lists.value_lengths().to_numpy()
                raw = np.zeros((b.num_rows, ix.dim))
                flat = lists.flatten().to_numpy()
                raw[np.repeat(np.arange(b.num_rows), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                x = scaled(raw)
                x /= np.sqrt((x * x).sum(1))[:, None]
                own, d = ix.nearest(x)
                codes, error = ix.code(x - ix.coarse[own])
                probed = ix.probes(d, own, reach)
                who, where = np.nonzero(probed)
                sent = raw.astype(width)
                bytes_, code_ = [r.tobytes() for r in sent], [c.tobytes() for c in codes]
                looks = [np.flatnonzero(p).astype(np.int32).tobytes() for p in probed]
                m = len(codes)
                r = np.concatenate((np.arange(m), who))
                member = np.arange(len(r)) < m
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(r)), pa.array(sizes[r], pa.int32()), pa.array(np.concatenate((own, where)), pa.int32()), pa.array(own[r], pa.int32()), pa.array(~member), b.column(1).take(pa.array(r)), b.column(2).take(pa.array(r)),
                    pa.array([bytes_[i] for i in r], pa.binary()), pa.array([code_[i] if k else None for i, k in zip(r, member, strict=True)], pa.binary()), pa.array([looks[i] if k else None for i, k in zip(r, member, strict=True)], pa.binary()), pa.array(error[r]),
                ], names=["label", "size", "list", "own", "query", "id", "copies", "vector", "code", "looks", "error"])

    kind = classes.schema["label"].dataType.simpleString()
    dealt = keep(classes.select("label", "id", "copies", "v").mapInArrow(assign, f"label {kind}, size int, list int, own int, query boolean, id long, copies long, vector binary, code binary, looks binary, error double"), "lists")
    key = ["label", "size", "list"]
    counts = keep(dealt.groupBy(*key).agg(F.ceil(F.count(F.when(~F.col("query"), 1)) / BLOCK).cast("int").alias("xs"), F.ceil(F.count(F.when(F.col("query"), 1)) / BLOCK).cast("int").alias("qs")).filter("xs > 0 AND qs > 0"), "list_counts")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = dealt.join(counts, key)
    placed = placed.withColumn("xb", F.explode(F.when(F.col("query"), all_of("xs")).otherwise(F.array(mine("xs"))))).withColumn("qb", F.explode(F.when(F.col("query"), F.array(mine("qs"))).otherwise(all_of("qs"))))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        return _block(group, shared.value, int(group["list"].iloc[0]), threshold, width)

    found = keep(placed.groupBy(*key, "xb", "qb").applyInPandas(block, "id long, other long, links long"), "vector_links")
    comp = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    summed = keep(classes.join(links, "id", "left").join(comp, "id", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector_components")
    out = good.join(summed, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sane").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
