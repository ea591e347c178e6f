"""Periodic runs of words, by the runs theorem.

Every maximal repetition has a Lyndon root, and that root is the longest
Lyndon word at its place under one of two opposite orders of the words. The
longest Lyndon words end at the next smaller and the next larger value of the
inverse suffix array, so a text of n words has 2n candidates; each is extended
to both sides with the LCP array and a sparse table of its minima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, word_codes

#: Words that a run has at least, and how often its period fits into it at least.
LEAST, TIMES = 24, 3
_FAR = np.iinfo(np.int64).max


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each pair (hi included), by a sparse table of which one row at a time is held."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out, row = np.empty(len(lo), values.dtype), values
    for k in range(int(level.max()) + 1 if len(lo) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class Suffixes:
    """Suffix array of texts, its inverse and its LCP array.

    words holds codes of at least 1, each text followed by one 0; text is the
    number of the text of each place, ascending. Suffixes are ordered by text
    first, so none is compared with one of another text, and a 0 is the least.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        key = text * (int(words.max()) + 1) + words
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        heads = np.flatnonzero(new)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        lcp = np.where(new, 0, _FAR)
        k = 1
        open_ = np.flatnonzero(~new | ~np.append(new[1:], True))  # places of the order that share their rank
        while len(open_):
            s = order[open_]
            group, then = rank[s], rank[s + k]  # a suffix that shares its first k words with another one has k words
            by = np.lexsort((then, group))
            s, group, then = s[by], group[by], then[by]
            order[open_] = s
            split = np.flatnonzero((group[1:] == group[:-1]) & (then[1:] != then[:-1]))
            found = k + range_min(lcp, then[split] + 1, then[split + 1])  # what follows was told apart before
            lcp[open_[split + 1]] = found
            new_group = np.concatenate(([True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])))
            heads = np.flatnonzero(new_group)
            sizes = np.diff(np.append(heads, len(s)))
            rank[s] = np.repeat(open_[heads], sizes)
            open_ = open_[np.repeat(sizes > 1, sizes)]
            k *= 2
        self.order, self.rank, self.lcp = order, rank, lcp

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and at j (another place of the same text) have in common."""
        a, b = self.rank[i], self.rank[j]
        return range_min(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one that holds less; the length where there is none."""
    n = len(values)
    out, values = [n] * n, [*values, min(values, default=0) - 1]
    for i in range(n - 1, -1, -1):
        j, v = i + 1, values[i]
        while values[j] > v:
            j = out[j]
        out[i] = j
    return out


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, each with a 0 behind it; the number of the text and its first place, by place."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    words = np.zeros(int(sizes.sum()), np.int64)
    first = np.cumsum(sizes) - sizes
    for a, t in zip(first.tolist(), texts, strict=True):
        words[a : a + len(t)] = t
    return words, np.repeat(np.arange(len(texts)), sizes), np.repeat(first, sizes)


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text (codes of at least 1) its runs as rows (start, length, period), by start, then period.

    A run is a stretch with smallest period q of at least max(least, times * q)
    words that cannot be extended to either side; times is at least 3.
    """
    out = [np.empty((0, 3), np.int64) for _ in texts]
    if not sum(map(len, texts)):
        return out
    words, text, first = _laid_out(texts)
    forward = Suffixes(words, text)
    ranks = forward.rank.tolist()
    here = np.tile(np.arange(len(words)), 2)
    there = np.concatenate((next_smaller(ranks), next_smaller([-r for r in ranks])))
    inside = there < len(words)
    here, there = here[inside], there[inside]
    # one root of a run is followed by itself, as it holds three periods: the others find the same run
    alike = (words[here] == words[there]) & (text[here] == text[there]) & (words[here] > 0)
    here, there = here[alike], there[alike]
    period, ahead = there - here, forward.common(here, there)
    twice = ahead >= period
    here, there, period, ahead = here[twice], there[twice], period[twice], ahead[twice]
    if not len(here):
        return out
    _, one = np.unique(np.stack((there + ahead, period)), axis=1, return_index=True)  # a run is known by its end and its period
    here, there, period, ahead = here[one], there[one], period[one], ahead[one]
    some, at = np.unique(text[here], return_inverse=True)
    shift = first[here]
    words, number, first = _laid_out([texts[k][::-1] for k in some.tolist()])
    backward = Suffixes(words, number)
    starts = np.searchsorted(number, np.arange(len(some)))
    last = starts[at] + np.array([len(texts[k]) for k in some.tolist()])[at] - 1  # where word 0 stands now
    i, j = here - shift, there - shift
    behind = np.zeros(len(i), np.int64)
    more = i > 0
    behind[more] = backward.common((last - i + 1)[more], (last - j + 1)[more])
    start, length = i - behind, behind + period + ahead
    keep = length >= np.maximum(least, times * period)
    which, start, length, period = some[at][keep], start[keep], length[keep], period[keep]
    by = np.lexsort((period, start, which))
    found = np.stack((start, length, period), 1)[by]
    which = which[by]
    for k in np.unique(which).tolist():
        a, b = np.searchsorted(which, (k, k + 1))
        out[k] = found[a:b]
    return out


def may_repeat(codes: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Texts in which some span words stand twice. codes: words of all texts; first: where each text begins, and the end."""
    out = np.zeros(len(first) - 1, bool)
    if len(codes) < span:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gram, reach = mix(codes.astype(np.uint64)), 1
    while reach < span:  # twice as long each time; equal stretches have equal hashes, so none is missed
        step = min(reach, span - reach)
        gram = mix(gram[: len(gram) - step] * np.uint64(0x9E3779B97F4A7C15) + gram[step:])
        reach += step
    own = np.flatnonzero(text[: len(gram)] == text[span - 1 :])
    text, key = text[own], mix(gram[own] + mix(text[own].astype(np.uint64)))
    ascending = np.sort(key)
    out[text[np.isin(key, ascending[1:][ascending[1:] == ascending[:-1]])]] = True
    return out


def _best(runs: np.ndarray) -> list[int] | None:
    """Start, length and period of the run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = [start, length, period]
    return best


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: doc_id, n_words, runs, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed and collapsed_sha256.

    Words are [^\\x20\\x09-\\x0D]+, compared byte by byte. A run is a stretch
    of words with smallest period q of at least max(least, times * q) words
    that cannot be extended to either side; runs is an array of (start,
    length, period) by start, then period. start, length, period and
    exponent_milli are those of the run with the greatest length / period
    (ties: smallest start, then period), null without runs. collapsed is the
    text without the words that follow the first q of any run that holds them,
    joined by one space. Null and empty texts have no words. Each row is
    judged by itself, whatever ids repeat or are null; other columns are not
    read; an empty table gives an empty table.

    Every step works on arrays over a slice of texts; a text longer than a
    slice is a slice of its own, and memory is a few dozen bytes a word. Texts
    in which no stretch of least * (times - 1) / times words stands twice hold
    no run, so no suffix array is made of them.
    """
    span = -(-least * (times - 1) // times)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, rows in slices(batch.column(1)):
                codes, _, first = word_codes(rows)
                repeats = np.flatnonzero(may_repeat(codes, first, span))
                found = dict(zip(repeats.tolist(), find_runs([codes[first[k] : first[k + 1]] + np.int64(1) for k in repeats.tolist()], least, times), strict=True))
                cols: dict[str, list] = {c: [] for c in ("runs", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "collapsed_sha256")}
                for k, body in enumerate(rows):
                    runs = found.get(k, ())
                    words = body.split()  # of bytes: at the same six characters
                    if len(runs):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    best = _best(runs) if len(runs) else None
                    collapsed = b" ".join(words)
                    digest = hashlib.sha256()
                    for r in runs.tolist() if len(runs) else ():
                        digest.update(b"%d,%d,%d\n" % tuple(r))
                    values = ([tuple(r) for r in runs.tolist()] if len(runs) else [], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest.hexdigest(), collapsed, hashlib.sha256(collapsed).hexdigest())
                    for name, v in zip(cols, values, strict=True):
                        cols[name].append(v)
                of = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                types = {"runs": of, "runs_sha256": pa.string(), "collapsed": pa.string(), "collapsed_sha256": pa.string()}
                runs_column = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in cols.pop("runs")], of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(rows)), pa.array(np.diff(first), pa.int64()), runs_column, *(pa.array(v, types.get(c, pa.int64())) for c, v in cols.items())],
                    names=["doc_id", "n_words", "runs", *cols],
                )

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, collapsed_sha256 string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
