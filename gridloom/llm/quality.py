"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-
maximisation estimates each labeller's accuracy from how the votes agree, and
the posterior labels train a linear scorer on hashed byte trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, slices

#: Buckets that byte trigrams are hashed into, and documents that the scorer is fitted on at most.
BUCKETS = 1 << 13
TRAIN_ROWS = 3000


#: The labellers, in the order of their votes.
LABELLERS = ("letters", "symbols", "capitals", "marks", "word_length", "words")
_KIND = np.zeros((5, 256), np.float64)  # characters, letters, capitals, symbols, white space
_KIND[0] = 1
_KIND[0, 0x80:0xC0] = 0  # bytes that go on a character
_KIND[1, [*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = 1  # others than ASCII count as letters
_KIND[2, 65:91] = 1
_KIND[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'-"]] = 1
_KIND[4, [0x20, *range(0x09, 0x0E)]] = 1
_MARK = (_KIND[0] - _KIND[1] - _KIND[4]).astype(bool)
_MARK[48:58] = False
_MARK[0x80:] = False
_WHITE = _KIND[4].astype(bool)


def votes(rows: list[bytes]) -> np.ndarray:
    """A row of votes for each text, read whole: 1 good, -1 bad, 0 no vote."""
    out = np.zeros((len(rows), len(LABELLERS)), np.int64)
    for i, r in enumerate(rows):
        b = np.frombuffer(r, np.uint8)
        chars, letters, capitals, symbols, _ = _KIND @ np.bincount(b, minlength=256)
        white, mark = _WHITE[b], _MARK[b]
        words = max(1, int(np.count_nonzero(white[:-1] & ~white[1:])) + bool(len(b) and not white[0]))
        n = max(1.0, chars)
        inner = mark[1:] & mark[:-1]
        runs = np.count_nonzero(inner[1:] & ~inner[:-1]) + bool(len(inner) and inner[0])
        length = chars / words
        for k, (good, bad) in enumerate((
            (letters / n > 0.75, letters / n < 0.62),
            (symbols / n < 0.01, symbols / n > 0.05),
            (capitals / n < 0.1, capitals / n > 0.3),
            (runs / words < 0.02, runs / words > 0.2),
            (3 < length < 9, length < 2.2 or length > 14),
            (words >= 30, words < 5),
        )):
            out[i, k] = -1 if bad else int(good)
    return out


def fit_labellers(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, np.ndarray, dict]:
    """Expectation-maximisation over vote patterns and how many documents have each.

    Returns the share of good documents, an array (labeller, class, vote) of
    probabilities, and each pattern's posterior of good. Classes are told
    apart by starting from majority votes.
    """
    keys = [p for p, _ in patterns]
    v = np.array(keys, np.int64).reshape(len(keys), -1) + 1
    n = np.array([c for _, c in patterns], float)
    q = np.clip((v - 1).sum(1) / max(1, v.shape[1]) / 2 + 0.5, 0.05, 0.95)
    prior, table = 0.5, np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        prior = float(np.clip((n * q).sum() / max(n.sum(), 1), 0.01, 0.99))
        for k in range(v.shape[1]):
            for c, w in ((1, n * q), (0, n * (1 - q))):
                table[k, c] = np.bincount(v[:, k], w, 3) + 0.5
                table[k, c] /= table[k, c].sum()
        good, bad = np.log(prior) + np.zeros(len(n)), np.log(1 - prior) + np.zeros(len(n))
        for k in range(v.shape[1]):
            good += np.log(table[k, 1, v[:, k]])
            bad += np.log(table[k, 0, v[:, k]])
        q = 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
    return prior, table, dict(zip(keys, q.tolist(), strict=True))


def trigrams(rows: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed byte trigrams, scaled to length 1; empty texts: zeros."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        b = np.frombuffer(b"  " + r, np.uint8).astype(np.uint32)
        if len(r):
            code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(19)
            out[i] = np.sqrt(np.bincount(code, minlength=BUCKETS) / len(code))
    return out


def fit_scorer(first: np.ndarray, code: np.ndarray, value: np.ndarray, p: np.ndarray, rounds: int = 150, rate: float = 4.0, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on posterior labels p by gradient steps with momentum; classes weigh alike. The last weight is the bias.

    Documents are sparse rows: those of document i are code[first[i]:first[i+1]]
    and value[...], so memory follows the trigrams that occur in the sample.
    """
    balance = p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9)
    parts = [slice(i, min(i + 256, len(p))) for i in range(0, len(p), 256)]
    w, step, bias, bias_step = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for _ in range(rounds):
        slope, total = l2 * w, l2 * bias
        for part in parts:
            x = slice(first[part.start], first[part.stop])
            row = np.repeat(np.arange(part.stop - part.start), np.diff(first[part.start : part.stop + 1]))
            z = np.bincount(row, value[x] * w[code[x]], part.stop - part.start) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p[part]) * balance[part]
            slope = slope + np.bincount(code[x], value[x] * g[row], BUCKETS)
            total += g.sum()
        step, bias_step = 0.9 * step - rate * slope, 0.9 * bias_step - rate * total
        w, bias = w + step, bias + bias_step
    return np.append(w, bias).astype(np.float32)


def score_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """docs with vote_sum, posterior, score and accepted.

    posterior: of good, from the votes alone; score: of the trained scorer on
    the whole text; accepted: their mean is at least threshold. Null and empty
    texts get the posterior of their votes and the score of the bias. With an
    empty table, or one pattern of votes, scores still are defined: EM then
    has one class. Columns of the input with these names are replaced. Nulls
    in doc_id are allowed (they hash alike); ties and repeats don't matter.

    EM sees counts of vote patterns (at most 3 to the number of labellers) of
    all documents. The scorer is fitted on at most train_rows distinct texts,
    taken by hash of id and text from each side of the posterior; that many at
    any size, and however many rows are equal.
    """
    spark = docs.sparkSession
    docs = docs.drop(*({"vote_sum", "posterior", "score", "accepted"} - {text, doc_id}))
    place = 3 ** np.arange(len(LABELLERS))  # a pattern of votes as one number

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, rows in slices(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array((votes(rows) + 1) @ place)], names=["code"])

    texts = docs.select(F.col(text).cast("string").alias("t"))
    counted = texts.mapInArrow(patterns, "code long").groupBy("code").count().collect()  # 3 ** 6 rows at most
    counts = sorted((tuple(int(r["code"]) // int(q) % 3 - 1 for q in place), r["count"]) for r in counted) or [((0,) * len(LABELLERS), 0)]
    prior, _, posterior = fit_labellers(counts)
    table = np.full(3 ** len(LABELLERS), prior)
    for k, q in posterior.items():
        table[(np.array(k) + 1) @ place] = q

    # about as many of either side; the share to take follows from the counts, so the sample is bounded
    good = sum(n for k, n in counts if posterior[k] >= 0.5)
    bad = sum(n for _, n in counts) - good
    take = [min(1.0, train_rows / 2 / max(n, 1)) for n in (bad, good)]
    u = F.pmod(F.xxhash64(F.lit(11), F.col(doc_id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(0)):
                p = table[(votes(part) + 1) @ place]
                picked = np.flatnonzero(b.column(1).slice(first, len(part)).to_numpy() < np.where(p >= 0.5, take[1], take[0]))
                for k in range(0, len(picked), 256):
                    at = picked[k : k + 256]
                    x = trigrams([part[i] for i in at])
                    yield pa.RecordBatch.from_arrays([pa.array([v[v > 0].tobytes() for v in x], pa.binary()), pa.array([np.flatnonzero(v > 0).astype(np.int16).tobytes() for v in x], pa.binary()), pa.array(p[at]), b.column(1).take(pa.array(first + at))], names=["v", "i", "p", "u"])

    drawn = docs.select(F.col(text).cast("string").alias("t"), u.alias("u")).mapInArrow(features, "v binary, i binary, p double, u double")
    drawn = drawn.groupBy("v", "i", "p").agg(F.min("u").alias("u"))  # equal texts are learned from once
    got = drawn.orderBy("u", "i", "v").limit(train_rows).collect()
    rows = sorted((r.v, r.i, r.p) for r in got)  # train_rows of 48 kB at most, however long or alike the texts are
    code = np.frombuffer(b"".join(i for _, i, _ in rows), np.int16)
    value = np.frombuffer(b"".join(v for v, _, _ in rows), np.float32)
    first = np.concatenate(([0], np.cumsum([len(i) // 2 for _, i, _ in rows]))).astype(np.int64)
    posteriors = np.array([q for _, _, q in rows])
    del got, rows
    weights = spark.sparkContext.broadcast(fit_scorer(first, code, value, posteriors) if len(posteriors) else np.zeros(BUCKETS + 1, np.float32))  # 32 kB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            for first, part in slices(b.column(b.num_columns - 1)):
                v = votes(part)
                s = np.empty(len(part))
                for k in range(0, len(part), 256):
                    s[k : k + 256] = trigrams(part[k : k + 256]) @ w[:-1] + w[-1]
                kept = [c.slice(first, len(part)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(v.sum(1)), pa.array(table[(v + 1) @ place]), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=[*b.schema.names[:-1], "vote_sum", "posterior", "score"])

    schema = docs.schema
    for name, kind in (("vote_sum", "long"), ("posterior", "double"), ("score", "double")):
        schema = type(schema)(schema.fields).add(name, kind)
    scored = docs.withColumn("__text", F.col(text).cast("string")).mapInArrow(score, schema)
    return scored.withColumn("accepted", (F.col("score") + F.col("posterior")) / 2 >= threshold)
