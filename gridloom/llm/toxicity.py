"""Toxicity by a counterfactual-regularised classifier.

A linear scorer over hashed distinct words and their beginnings is fitted to labelled documents.
Each document also stands with its identity terms swapped, and the fit pays
for the square of the change in score, so naming a group moves a score little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, keep, slices

#: Buckets of hashed words, lengths in bytes of the beginnings that count as well (inflected words share them), and labelled documents that the classifier is fitted on at most.
BUCKETS, PREFIXES, TRAIN_ROWS = 1 << 20, (4, 5, 6, 7, 8), 6000
#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "gender": ["women", "men", "girls", "boys", "female", "male", "woman", "man", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "homosexual", "heterosexual", "queer"],
    "religion": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    "origin": ["black", "white", "asian", "african", "european", "arab", "latino", "indian", "chinese", "mexican", "immigrants", "refugees"],
    "age": ["old", "young", "elderly", "teenagers"],
    "disability": ["disabled", "blind", "deaf", "autistic"],
}
#: Marks that part words.
_MARKS = re.compile(rb"[.,;:!?\"'()\[\]{}*%$#&<>/\\|_=+~`-]+")


def buckets_of(rows: list[bytes]) -> list[np.ndarray]:
    """For each text the distinct buckets of its words and of their beginnings, lower-cased and parted at marks, ascending."""
    words = Words([_MARKS.sub(b" ", r) for r in rows])
    parts = [words.prefixes(k) for k in PREFIXES]
    at = np.concatenate((np.arange(len(words.hash)), *(p[0] for p in parts)))
    code = (np.concatenate((words.hash, *(p[1] for p in parts))) >> np.uint64(64 - 20)).astype(np.int64)
    doc = np.searchsorted(words.first, at, side="right") - 1
    found = np.unique(doc * BUCKETS + code)
    cut = np.searchsorted(found, np.arange(len(rows) + 1) * BUCKETS)
    return [found[a:b] % BUCKETS for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def identity_buckets() -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """By the bucket of each identity term: all buckets of the term (its word and its beginnings), and those of each other term of its kind."""
    found = {}
    for terms in IDENTITY_TERMS.values():
        names = [t.encode() for t in terms]
        codes, sets = (Words(names).hash >> np.uint64(64 - 20)).astype(np.int64).tolist(), buckets_of(names)
        for i, c in enumerate(codes):
            found[c] = sets[i], [x for j, x in enumerate(sets) if j != i]
    return found


def swapped(doc: np.ndarray, kinds: dict[int, tuple[np.ndarray, list[np.ndarray]]], turn: int) -> np.ndarray:
    """The document with each identity term, beginnings included, swapped for another of its kind."""
    named = doc[np.isin(doc, list(kinds))].tolist()
    if not named:
        return doc
    stays = np.setdiff1d(doc, np.concatenate([kinds[c][0] for c in named]))
    return np.unique(np.concatenate([stays, *(kinds[c][1][turn % len(kinds[c][1])] for c in named)]))


#: Documents that must hold a word for it to count, and the least chi-square with the label: words that go with neither label only add noise.
LEAST, SCREEN = 3, 12.0


def screened(n: int, hits: int) -> F.Column:
    """Whether a bucket counts: seen, the documents that hold it; inside, the toxic ones; of n documents, hits of them toxic."""
    seen, inside = F.col("seen").cast("double"), F.col("inside").cast("double")
    expected = seen * hits / n if n else F.lit(0.0)
    spread = F.greatest(seen * (n - seen) * float(hits * (n - hits)) / float(max(n, 1)) ** 3, F.lit(1e-9))
    return (seen >= LEAST) & ((inside - expected) * (inside - expected) / spread >= SCREEN)


def fit(docs: list[np.ndarray], labels: np.ndarray, weigh: np.ndarray, pull: float = 1.0, l2: float = 2e-5, rounds: int = 300, rate: float = 0.5, least: int = LEAST, screen: float = SCREEN) -> np.ndarray:
    """Weights of all buckets and a bias (last), by AdaGrad on the whole sample.

    weigh: what each document counts, 1 on average. The loss is the mean
    logistic loss, pull times the mean squared change of score under swaps,
    and l2. Words of fewer than least documents, or whose chi-square with the
    label is below screen, get no weight. Where the sample names no group,
    the swaps still count: a probe of each term must not score other than the
    other terms of its kind.
    """
    kinds = identity_buckets()
    y, n = labels.astype(float), float(max(len(docs), 1))
    seen, inside = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, bad in zip(docs, y, strict=True):
        seen[d] += 1
        if bad:
            inside[d] += 1
    # chi-square of word against label: words that go with neither label only add noise
    hits = y.sum()
    expected = seen * hits / n
    spread = np.maximum(seen * (n - seen) * hits * (n - hits) / n**3, 1e-9)
    allowed = (seen >= least) & ((inside - expected) ** 2 / spread >= screen)
    allowed[np.concatenate([own for own, _ in kinds.values()])] = True
    docs = [d[allowed[d]].astype(np.int64) for d in docs]
    twins = [swapped(d, kinds, i) for i, d in enumerate(docs)]
    terms = [(own, other) for own, others in kinds.values() for other in others]
    left, right = [*docs, *(own for own, _ in terms)], [*twins, *(other for _, other in terms)]
    many = lambda sets: np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
    cl, rl = many(docs), np.repeat(np.arange(len(docs)), [len(s) for s in docs])
    moved = [i for i in range(len(left)) if len(left[i]) != len(right[i]) or (left[i] != right[i]).any()]
    cm = many(np.concatenate((left[i], right[i])) for i in moved)
    rm = np.repeat(np.arange(len(moved)), [len(left[i]) + len(right[i]) for i in moved])
    sign = np.concatenate([*(np.concatenate((np.ones(len(left[i])), -np.ones(len(right[i])))) for i in moved), np.empty(0)])
    used, at = np.unique(np.concatenate((cl, cm)), return_inverse=True)
    al, am = at[: len(cl)], at[len(cl) :]
    n = int(n)
    w, b = np.zeros(len(used)), float(np.log(((y * weigh).sum() + 1) / (((1 - y) * weigh).sum() + 1)))
    past, past_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rl, w[al], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh / n
        grad = np.bincount(al, g[rl], len(used)) + l2 * w
        if len(moved):
            change = np.bincount(rm, w[am] * sign, len(moved))
            grad += 2 * pull / len(moved) * np.bincount(am, change[rm] * sign, len(used))
        past += grad * grad
        w -= rate * grad / np.sqrt(past)
        past_b += g.sum() ** 2
        b -= rate * g.sum() / np.sqrt(past_b)
    out = np.zeros(BUCKETS + 1)
    out[used] = w
    out[-1] = b
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, train: F.Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row of docs, from whole texts.

    labels: (doc_id, label) rows; those with a null are not learned from, and
    of an id with several labels the largest counts. train: a condition on
    docs that labelled rows must meet to be learned from. Null and empty texts
    get the score of the bias; without any usable label all scores are 0.5.
    Null and repeated doc_ids keep their rows. Only text is an input of a score.

    The fit takes about train_rows labelled texts, 2 * train_rows at most, by
    hash of their ids and texts, half of either label. Their buckets are counted and screened in
    the tasks, so the driver holds the few that count, however long the texts
    are and however many rows share an id or a text.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL").groupBy("__id").agg(F.max("__y").alias("__y"))
    # what is drawn are texts of ids, told by a hash; counts, too, are of those that may be learned from
    told = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marks = keep(docs.filter(train).select(F.col(doc_id).alias("__id"), told.alias("__text")).join(marks, "__id").distinct(), "toxicity_marks")
    bad = F.col("__y") > 0
    toxic, clean = marks.agg(F.count(F.when(bad, 1)), F.count(F.when(~bad, 1))).first()
    share = [min(1.0, train_rows / 2 / max(n, 1)) for n in (clean, toxic)]
    u = F.pmod(F.xxhash64(F.lit(7), "__id", "__text"), F.lit(1 << 30)) / float(1 << 30)
    marks = marks.filter(u < F.when(bad, F.lit(share[1])).otherwise(F.lit(share[0]))).orderBy(u, "__id", "__text").limit(2 * train_rows)
    sample = docs.filter(train).join(F.broadcast(marks), (docs[doc_id] == F.col("__id")) & (told == F.col("__text")))  # 2 * train_rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), pa.array([x.astype(np.int32).tobytes() for x in buckets_of(rows)], pa.binary())], names=["y", "x"])

    # copies would count a document's words again and again
    found = sample.select(F.col("__y").alias("y"), F.col(text).cast("string").alias("t")).mapInArrow(features, "y int, x binary").distinct()
    found = keep(found, "toxicity_sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic_ in (True, False):
                x = [np.frombuffer(v.as_py(), np.int32) for v, y in zip(b.column(1), b.column(0), strict=True) if (y.as_py() > 0) == toxic_]
                if x:
                    code, n = np.unique(np.concatenate(x), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.array(n if toxic_ else 0 * n)], names=["code", "seen", "inside"])

    total, hits = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("y") > 0, 1))).first()
    per = found.mapInArrow(counts, "code int, seen long, inside long").groupBy("code").agg(F.sum("seen").alias("seen"), F.sum("inside").alias("inside"))
    few = np.array([r.code for r in per.filter(screened(total, hits)).select("code").collect()], np.int64)
    few = np.union1d(few, np.concatenate([own for own, _ in identity_buckets().values()]))
    counted = spark.sparkContext.broadcast(few)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(v.as_py(), np.int32) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v[np.isin(v, counted.value)].tobytes() for v in x], pa.binary())], names=["y", "x"])

    got = sorted((r.x, r.y) for r in found.mapInArrow(screen, "y int, x binary").collect())
    labels_of = np.array([int(y > 0) for _, y in got])
    weigh = np.where(labels_of == 1, 1 / share[1], 1 / share[0])  # each side was sampled at a rate of its own
    weights = fit([np.frombuffer(x, np.int32) for x, _ in got], labels_of, weigh / weigh.mean()) if got else np.zeros(BUCKETS + 1)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for _, rows in slices(b.column(1)):
                out += [float(w[x].sum(dtype=np.float64)) + float(w[-1]) for x in buckets_of(rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30))))], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
