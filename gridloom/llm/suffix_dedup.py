"""Removal of long repeats with run-length indexes (run-compressed Burrows-Wheeler transforms).

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Every such string holds a content-defined anchor
(the least hash of its 18-byte grams), so equal strings meet by their anchors:
no document is compared with another one, and no index covers the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, keep, mix, powers, slices, stretch_hashes, text_bytes
from .suffix_index import RunLengthIndex

#: Bytes in a gram; bytes of text that a group of documents and that a bucket of anchors stand for, on average; contexts of one anchor beyond which they are told apart by windows.
GRAM, GROUP_BYTES, BUCKET_BYTES, CROWD = 18, 4 << 20, 4 << 20, 2000
_BIG = np.iinfo(np.int64).max
#: A prime and a factor whose products fit in 63 bits: a hash that Spark and numpy work out alike.
_PRIME, _TURN = (1 << 31) - 1, 1103515245
#: Share of all anchors from which a gram's contexts are dealt apart; it must stand out so often in a slice to be counted.
HOT, HOT_IN_SLICE = 10_000, 4
#: Windows that anchors are sought for at a time.
BLOCK = 1 << 15
#: Bytes of a slice: what it repeats is merged before it is sent.
SLICE = 2 << 20


class Anchors:
    """Anchors of a slice of texts: which windows each stands for, with hashes of the gram and of the whole stretch of windows."""

    def __init__(self, rows: list[bytes], length: int):
        rows_at = [i for i, r in enumerate(rows) if len(r) >= length]
        self.row = self.lo = self.hi = self.gram = self.offset = self._at = self._width = np.empty(0, np.int64)
        self._data, self.length = np.empty(0, np.uint8), length
        if not rows_at:
            return
        data = np.frombuffer(b"".join(rows[i] for i in rows_at), np.uint8)
        sizes = np.array([len(rows[i]) for i in rows_at])
        begin = np.cumsum(sizes) - sizes
        ends = begin + sizes
        place, gram = self._places(data, length)
        # windows in a row with one place share an anchor; a document ends its last one
        new = np.empty(len(place), bool)
        new[0], new[1:] = True, place[1:] != place[:-1]
        new[begin[begin < len(place)]] = True
        new[(ends - length + 1)[:-1]] = True  # windows from here on reach into the next document
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(place)) - 1
        doc = np.searchsorted(begin, lo, side="right") - 1
        inside = lo + length <= ends[doc]
        lo, hi, doc = lo[inside], hi[inside], doc[inside]
        self.row, base = np.array(rows_at)[doc], begin[doc]
        self.gram, self.offset = gram[lo], place[lo] - lo
        self._width = hi - lo + length
        self.lo, self.hi = lo - base, hi - base
        self._at, self._data, self.length = lo, data, length

    @staticmethod
    def _places(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window: where its least gram stands (the leftmost of several), and that gram's hash.

        In blocks that fit in the cache. The order is by the upper bits of the
        hash and then by place, so it hangs on the window's bytes alone.
        """
        span = length - GRAM + 1  # grams in a window
        n = len(data) - length + 1
        place, least = np.empty(n, np.int64), np.empty(n, np.uint64)
        at = np.arange(BLOCK + span - 1, dtype=np.uint64)
        upper = ~np.uint64((1 << len(at).bit_length()) - 1)
        up, down = powers(BLOCK + length)
        total = np.zeros(BLOCK + length, np.uint64)
        for b in range(0, n, BLOCK):
            k = min(BLOCK, n - b)  # windows of this block; k + span - 1 grams
            m = k + length - 1
            np.cumsum(_BYTE[data[b : b + m]] * up[:m], out=total[1 : m + 1])
            gram = mix((total[GRAM : m + 1] - total[: m + 1 - GRAM]) * down[: m + 1 - GRAM])
            low, step = (gram & upper) | at[: len(gram)], 1
            while 2 * step <= span:  # the least of span grams from each place, by doubling
                low = np.minimum(low[: len(low) - step], low[step:])
                step *= 2
            if step < span:
                low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
            found = (low & ~upper).astype(np.int64)
            place[b : b + k] = found + b
            least[b : b + k] = gram[found]
        return place, least

    @property
    def context(self) -> np.ndarray:
        """Hashes of the whole stretches and of where the gram stands in them."""
        return mix(stretch_hashes(self._data, self._at, self._width) + self.offset.astype(np.uint64))

    def windows(self, some: np.ndarray) -> list[np.ndarray]:
        """Hashes of the windows of each of some anchors."""
        n = self.hi[some] - self.lo[some] + 1
        s = np.repeat(self._at[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.split(stretch_hashes(self._data, s, np.full(len(s), self.length)), np.cumsum(n)[:-1])


def _blobs(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per bucket with the columns' values as bytes."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(bucket)) if len(bucket) else cuts
    out = {"bucket": bucket[order][cuts]}
    for name, v in columns.items():
        v = v[order]
        out[name] = [v[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pd.DataFrame(out)


def _stack(frames: list[pd.DataFrame], kinds: dict[str, object]) -> pd.DataFrame:
    """All rows of the frames; columns that a frame hasn't are null there. Values are not looked at one by one."""
    out = {}
    for c, kind in kinds.items():
        parts = [f[c].astype(kind).array if c in f else pd.array([None] * len(f), kind) for f in frames]
        if kind is object:
            out[c] = np.concatenate([np.empty(0, object), *(x.to_numpy() for x in parts)])
        else:
            out[c] = pd.concat([pd.Series(x) for x in parts], ignore_index=True) if parts else pd.array([], kind)
    return pd.DataFrame(out)


def _join(rows: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first counts most), and where a new value of the first two begins."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b) * np.uint64(0x9E3779B97F4A7C15))


def _alike(gram: np.ndarray, own: np.ndarray, offset: np.ndarray, texts: list[bytes], reach: int) -> np.ndarray:
    """Contexts that can share a window with another document's: one that does agrees with it on the reach bytes before the gram or on those after it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    out = np.zeros(len(texts), bool)
    for start, fits in ((begin + offset - reach, offset >= reach), (begin + offset + GRAM, offset + GRAM + reach <= sizes)):
        some = np.flatnonzero(fits)
        side = mix((total[start[some] + reach] - total[start[some]]) * down[start[some]])
        key = _pair(gram[some].view(np.uint64), side)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(some) else np.empty(0, np.int64)
        if len(first):
            d = own[some][order]
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            out[some[order[np.repeat(several, np.diff(np.append(first, len(d))))]]] = True
    return out


def _cut(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes that the stretches cover, their maximal runs, and the bytes that stay."""
    if not len(starts):
        return 0, 0, body
    delta = np.zeros(len(body) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    gone = np.cumsum(delta[:-1]) > 0
    return int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(gone[0]), np.frombuffer(body, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, crowd: int = CROWD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (binary).

    Strings are judged on the input, byte by byte; a null text is empty, and a
    text shorter than length keeps all. Rows that repeat a doc_id are parts of
    one document: they take nothing from each other. Rows with a null doc_id
    keep all and take nothing. Other columns are not read. An empty table
    gives an empty table.

    Passes, all linear in the text:
    1. Each slice of documents sends its distinct (gram, context, least id);
       a bucket of grams answers to each group of documents which of its
       contexts stand in a document with a smaller id, and which grams have
       several contexts. Grams that hold one in HOT of all anchors, and more
       than crowd, are counted first: their contexts are dealt over all
       buckets and count as crowded.
    2. Each group marks repeated contexts whole. Where a gram has several
       contexts, the first document of each sends it, once.
    3. A bucket builds a run-length index of its contexts and streams their
       matching statistics: a window that matches length bytes of a context
       with a smaller id goes. Grams with more than crowd contexts (edges of
       very frequent passages) meet by windows instead, merged by group.
    4. Documents with contexts from pass 3 put their marks together.
    """
    n_bytes = max(1, text_bytes(docs, text))
    rows_n = max(1, docs.count())
    groups, buckets = max(8, n_bytes // GROUP_BYTES), max(8, n_bytes // BUCKET_BYTES)
    per = max(1, rows_n // groups // 4)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    null_rows = slim.filter("doc_id IS NULL")
    slim = slim.filter("doc_id IS NOT NULL")

    def group_of(ids: np.ndarray) -> np.ndarray:
        """Runs of neighbouring ids share a group, so that what they repeat is merged before it is sent; runs are dealt by a hash, so ids may lie at any distance."""
        return (ids // per % _PRIME * _TURN % _PRIME * _TURN + 1) % _PRIME % groups

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, n): grams that stand out in a slice; gram null: all anchors of it."""
        for batch in batches:
            for _, rows in slices(batch.column(0), SLICE):
                gram, n = np.unique(Anchors(rows, length).gram, return_counts=True)
                often = n >= HOT_IN_SLICE
                yield pa.RecordBatch.from_arrays([pa.array([None, *gram[often].view(np.int64).tolist()], pa.int64()), pa.array(np.append(n.sum(), n[often]).astype(np.int64))], names=["gram", "n"])

    counted = keep(slim.select("t").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "repeat_grams")
    anchors = counted.filter("gram IS NULL").agg(F.sum("n")).first()[0] or 0
    least_hot = max(crowd, anchors // HOT)
    hot_grams = [r.gram for r in counted.filter(F.col("gram").isNotNull() & (F.col("n") > least_hot)).select("gram").collect()]  # HOT at most
    hot = docs.sparkSession.sparkContext.broadcast(np.array(hot_grams, np.int64).view(np.uint64))  # 8 bytes each

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, rows in slices(batch.column(1), SLICE):
                a = Anchors(rows, length)
                if not len(a.row):
                    continue
                doc = ids[first + a.row]
                group = group_of(doc)
                context = a.context
                order = np.lexsort((doc, group, context, a.gram))
                g, c, gr, d = a.gram[order], context[order], group[order], doc[order]
                new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (gr[1:] != gr[:-1])))
                g, c, d = g[new], c[new], d[new]
                by_doc = np.argsort(d, kind="stable")  # runs of one id compress
                g, c, d = g[by_doc], c[by_doc], d[by_doc]
                apart = np.where(np.isin(g, hot.value), mix(c), np.uint64(0))  # contexts of a hot gram spread over all buckets
                out = _blobs(((g + apart) % np.uint64(buckets)).astype(np.int64), {"grams": g, "contexts": c, "docs": d})
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    sent = slim.mapInArrow(send, "bucket long, grams binary, contexts binary, docs binary")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        g, c, d = _join(rows.grams, np.uint64), _join(rows.contexts, np.uint64), _join(rows.docs, np.int64)
        order, new = _firsts(g, c, d)
        g, c, d = g[order], c[order], d[order]
        which = np.cumsum(new) - 1
        least = d[new][which]
        gram_new = np.concatenate(([True], g[1:] != g[:-1]))
        gram = np.cumsum(gram_new) - 1
        contexts = np.bincount(gram, new)[gram].astype(np.int64)
        starts = np.flatnonzero(gram_new)
        several = (contexts > 1) & (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))[gram]
        dealt_apart = np.isin(g, hot.value)  # this bucket sees a part of its contexts only
        several |= dealt_apart
        kind = np.where(several, np.where((contexts > crowd) | dealt_apart, 2, 1), 0).astype(np.int8)
        tell = several | (least < d)
        return _blobs(group_of(d[tell]), {"grams": g[tell], "contexts": c[tell], "least": least[tell], "kind": kind[tell]}).rename(columns={"bucket": "grp"})

    answers = keep(sent.groupBy("bucket").applyInPandas(answer, "grp long, grams binary, contexts binary, least binary, kind binary"), "repeat_answers")
    run = f"pmod((doc_id - pmod(doc_id, {per})) div {per}, {_PRIME})"  # as group_of
    texts = slim.withColumn("grp", F.expr(f"({run} * {_TURN} % {_PRIME} * {_TURN} + 1) % {_PRIME} % {groups}").cast("long"))

    def mark(texts_of: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """kind 0: a finished document; 1: one that waits, with its marks and crowded windows; 2: contexts for an index; 3: windows."""
        if not len(texts_of):
            return pd.DataFrame({c: [] for c in columns})
        ids, grp = texts_of.doc_id.to_numpy(), int(texts_of.grp.iloc[0])
        tags, key = [], _pair(_join(told.grams, np.uint64), _join(told.contexts, np.uint64))
        key, first = np.unique(key, return_index=True)
        told_least, told_kind = _join(told.least, np.int64)[first], _join(told.kind, np.int8)[first]
        parts, bodies = [], []
        for begin, rows in slices(pa.array(texts_of.t, pa.string()), SLICE):
            bodies += rows
            parts.append((begin, Anchors(rows, length)))
        tags = np.array([int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in bodies], np.int64)  # tells texts of one id apart
        joined = lambda name, kind: np.concatenate([np.empty(0, kind), *(getattr(a, name) for _, a in parts)]).astype(kind)
        row = np.concatenate([np.empty(0, np.int64), *(a.row + begin for begin, a in parts)]).astype(np.int64)
        lo, hi, gram, own = joined("lo", np.int64), joined("hi", np.int64), joined("gram", np.uint64), ids[row]
        mine = _pair(gram, joined("context", np.uint64))
        least, kind = np.full(len(row), _BIG), np.zeros(len(row), np.int8)
        if len(key) and len(row):
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = key[at] == mine
            least[hit], kind[hit] = told_least[at[hit]], told_kind[at[hit]]
        _, same = np.unique(mine, return_inverse=True)
        local = np.full(int(same.max()) + 1 if len(same) else 0, _BIG)
        np.minimum.at(local, same, own)
        gone = own > np.minimum(least, local[same])
        kind = np.where(gone, 0, kind)
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(a.row)) for _, a in parts)]).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), [len(a.row) for _, a in parts])

        to_index = np.flatnonzero(kind == 1)
        frames = [pd.DataFrame({"kind": 2, "doc_id": own[to_index], "grp": grp, "tag": tags[row[to_index]], "gram": gram[to_index].view(np.int64), "lo": lo[to_index], "blob": [bytes((o,)) + bodies[r][x : y + length] for r, x, y, o in zip(row[to_index].tolist(), lo[to_index].tolist(), hi[to_index].tolist(), joined("offset", np.int64)[to_index].tolist(), strict=True)]})]
        crowded: dict[int, list] = {}
        many = np.flatnonzero(kind == 2)
        for k in np.unique(part[many]).tolist():
            some = many[part[many] == k]
            for i, hashes in zip(some.tolist(), parts[k][1].windows(place[some]), strict=True):
                crowded.setdefault(int(row[i]), []).append((np.arange(lo[i], hi[i] + 1), hashes))
        if crowded:
            h = np.concatenate([w for ws in crowded.values() for _, w in ws])
            d = np.concatenate([np.full(len(w), ids[r]) for r, ws in crowded.items() for _, w in ws])
            order, new = _firsts(h, np.zeros(len(h), np.int64), d)
            blobs = _blobs((h[order][new] % np.uint64(buckets)).astype(np.int64), {"blob": h[order][new], "blob2": d[order][new]})
            frames.append(blobs.rename(columns={"bucket": "gram"}).assign(kind=3))
        order = np.flatnonzero(gone)
        order = order[np.argsort(row[order], kind="stable")]
        cuts = np.searchsorted(row[order], np.arange(len(bodies) + 1))
        waits = set(row[to_index].tolist()) | set(crowded)
        done, late = [], []
        for r, body in enumerate(bodies):
            g = order[cuts[r] : cuts[r + 1]]
            begin, end = lo[g], hi[g] + length
            if r in waits:
                pos, hashes = ([np.empty(0, k), *x] for k, x in zip((np.int64, np.uint64), zip(*crowded[r], strict=True) if r in crowded else ((), ()), strict=True))
                late.append((1, int(ids[r]), grp, int(tags[r]), body, np.stack((begin, end), 1).tobytes(), np.concatenate(pos).tobytes(), np.concatenate(hashes).tobytes()))
            else:
                removed, spans, kept = _cut(body, begin, end)
                done.append((0, int(ids[r]), len(body), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        frames.append(pd.DataFrame(late, columns=["kind", "doc_id", "grp", "tag", "blob", "blob2", "blob3", "blob4"]))
        frames.append(pd.DataFrame(done, columns=["kind", "doc_id", "n_bytes", "n_removed", "n_spans", "sha", "blob"]))
        numbers = ("kind", "doc_id", "grp", "tag", "gram", "lo", "n_bytes", "n_removed", "n_spans")
        return _stack([f for f in frames if len(f)], {c: "Int64" if c in numbers else object for c in columns})

    columns = ["kind", "doc_id", "grp", "tag", "gram", "lo", "n_bytes", "n_removed", "n_spans", "sha", "blob", "blob2", "blob3", "blob4"]
    schema = "kind int, doc_id long, grp long, tag long, gram long, lo long, n_bytes long, n_removed long, n_spans long, sha string, blob binary, blob2 binary, blob3 binary, blob4 binary"
    marked = keep(texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(mark, schema), "repeat_marks")

    def look_up(rows: pd.DataFrame) -> pd.DataFrame:
        """Starts of the windows that a context with a smaller id holds, by document."""
        rows = rows.sort_values(["gram", "doc_id", "lo"], ignore_index=True)
        gram, own, tag, lo = (rows[c].to_numpy() for c in ("gram", "doc_id", "tag", "lo"))
        texts_ = [b[1:] for b in rows.blob]
        alike = np.flatnonzero(_alike(gram, own, np.array([b[0] for b in rows.blob]), texts_, (length - GRAM) // 2))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.append(np.flatnonzero(np.concatenate(([True], gram[alike][1:] != gram[alike][:-1]))), len(alike)) if len(alike) else np.zeros(1, int)
        begin = 0
        while begin < len(alike):  # contexts of one gram stay together; an index holds a few thousand
            end = int(cuts[max(np.searchsorted(cuts, begin + 4096, side="right") - 1, np.searchsorted(cuts, begin, side="right"))])
            part = alike[begin:end]
            index = RunLengthIndex([texts_[i] for i in part], own[part], length)
            lengths, least = index.statistics([texts_[i] for i in part], np.arange(len(part)))
            at, j = np.nonzero((lengths >= length) & (least < own[part][:, None]))
            hits.append((part[at], j))
            begin = end
        out: list[tuple] = []
        at, j = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (zip(*hits, strict=True) if hits else ((), ())))
        if len(at):
            starts = lo[at] + j
            order, new = _firsts(own[at], tag[at], starts)
            cut = np.flatnonzero(new)
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist(), strict=True):
                i = at[order[x]]
                out.append((int(group_of(own[i])), int(own[i]), int(tag[i]), starts[order[x:y]].tobytes(), None))
        return pd.DataFrame(out, columns=["grp", "doc_id", "tag", "starts", "hashes"])

    replied = "grp long, doc_id long, tag long, starts binary, hashes binary"
    contexts = marked.filter("kind = 2").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    found = contexts.select("bucket", "gram", "doc_id", "tag", "lo", "blob").groupBy("bucket").applyInPandas(look_up, replied)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        h, d = _join(rows.blob, np.uint64), _join(rows.blob2, np.int64)
        order, new = _firsts(h, np.zeros(len(h), np.int64), d)
        h, d = h[order], d[order]
        least = d[new][np.cumsum(new) - 1]
        tell = least < d
        out = _blobs(group_of(d[tell]), {"hashes": h[tell], "starts": least[tell]})
        return out.rename(columns={"bucket": "grp"}).assign(doc_id=-1, tag=-1)[["grp", "doc_id", "tag", "starts", "hashes"]]

    windows = marked.filter("kind = 3").select("gram", "blob", "blob2").groupBy("gram").applyInPandas(meet, replied)
    replies = keep(found.unionByName(windows), "repeat_replies")

    def finish(waiting: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        by_doc: dict[tuple[int, int], np.ndarray] = {}
        hashed = told.hashes.notna() if len(told) else np.empty(0, bool)
        for d, t, s in zip(told.doc_id[~hashed], told.tag[~hashed], told.starts[~hashed], strict=True):
            by_doc[d, t] = np.concatenate((by_doc.get((d, t), np.empty(0, np.int64)), np.frombuffer(s, np.int64)))
        # the least id of each crowded window: as told, and among the documents of this very group
        own = [np.frombuffer(h, np.uint64) for h in waiting.blob4]
        h = np.concatenate([_join(told.hashes[hashed], np.uint64), *own])
        least = np.concatenate([_join(told.starts[hashed], np.int64), *(np.full(len(x), d) for d, x in zip(waiting.doc_id, own, strict=True))]).astype(np.int64)
        order = np.lexsort((least, h))
        h, least = h[order], least[order]
        out = []
        for d, tag, body, marks, pos, hashes in zip(waiting.doc_id, waiting.tag, waiting.blob, waiting.blob2, waiting.blob3, own, strict=True):
            marks = np.frombuffer(marks, np.int64).reshape(-1, 2)
            more = np.frombuffer(pos, np.int64)[least[np.searchsorted(h, hashes)] < d] if len(hashes) else np.empty(0, np.int64)
            starts = np.concatenate((by_doc.get((d, tag), np.empty(0, np.int64)), more))
            removed, spans, kept = _cut(body, np.concatenate((marks[:, 0], starts)), np.concatenate((marks[:, 1], starts + length)))
            out.append((d, len(body), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    waiting = marked.filter("kind = 1").select("grp", "doc_id", "tag", "blob", "blob2", "blob3", "blob4")
    late = waiting.groupBy("grp").cogroup(replies.groupBy("grp")).applyInPandas(finish, result)
    early = marked.filter("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), F.col("blob").alias("kept_text"))
    body = F.coalesce("t", F.lit("")).cast("binary")
    apart = null_rows.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), body.alias("kept_text"))
    return early.unionByName(late).unionByName(apart)
