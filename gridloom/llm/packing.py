"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition, in order, are one stream of tokens. Cuts fall at
ends of documents (free), ends of sentences (a small penalty) or, where a
sentence alone is long, within it (a larger one). The program minimises
padding plus penalties over all ways to cut the stream.
"""

from __future__ import annotations

import string
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words that a Python worker remembers the ids of; beyond it starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of text that are encoded at a time: the more, the fewer distinct words for each.
SLICE = 6 << 20
#: Letters that no normalisation turns into anything else than letters (for a class of a regular expression), and marks of which a row is one piece.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΣ-ώЀ-ҁ", string.punctuation
#: Tokens that the program looks at before it hands out sequences.
BLOCK_TOKENS = 1 << 18


class Tokens:
    """Ids of whole texts by a tokenizer whose pieces never span white space, each distinct word encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.fresh()

    def fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0
        self.at, self.n = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def learn(self, words: list[str]) -> None:
        """Words of letters, in any script, go to the tokenizer in one text, told apart by the word ends; all others one by one.

        Each word is one piece at least, so as many word ends as words say that each was one. Where
        there are more (a letter that falls apart), that text's words go one by one, too.
        """
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                self.store(part, ids, np.diff(ends, prepend=0))
            else:
                rest += part
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.store(part, np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64))

    def store(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        k = len(self.known)
        while k + len(words) > len(self.at):
            self.at, self.n = (np.concatenate((x, np.empty_like(x))) for x in (self.at, self.n))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[k : k + len(words)] = self.used + np.cumsum(counts) - counts
        self.n[k : k + len(words)] = counts
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, the number of ids of each text, and where a sentence ends (after which ids)."""
        if len(self.known) > CACHE_WORDS:
            self.fresh()
        if not any(texts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64), np.empty(0, np.int64)
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        lists = pc.ascii_split_whitespace(column)
        coded = lists.values.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        lower = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        # letters alone and the marks after them are encoded apart: there the tokenizer parts a word, too
        core = pc.utf8_rtrim(lower, MARKS)
        parted = pc.match_substring_regex(core, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        whole, bare = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (lower, core))
        _, at, data = lower.buffers()
        at = np.frombuffer(at, np.int64)[lower.offset : lower.offset + len(lower) + 1]
        inner = at[:-1] + np.where(parted, bare, whole)
        both = pa.Array.from_buffers(lower.type, 2 * len(lower), [None, pa.py_buffer(np.append(np.stack((at[:-1], inner), 1).ravel(), at[-1])), data]).dictionary_encode()
        known, names = self.known, listed(both.dictionary)
        self.learn([w for w in names if w not in known])
        number = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[both.indices.to_numpy()]
        head, tail = number[0::2], number[1::2]  # the empty word has no ids
        size = self.n[head] + self.n[tail]
        # ids of the distinct words in a row, then of all words by gathering from it
        flat = gather(self.pool, np.stack((self.at[head], self.at[tail]), 1).ravel(), np.stack((self.n[head], self.n[tail]), 1).ravel())
        first = np.cumsum(size) - size
        counts = size[code]
        ids = gather(flat, first[code], counts)
        stops = pc.match_substring_regex(words, "[.!?][\"')]*$").to_numpy(zero_copy_only=False)[code]
        ends = np.concatenate(([0], np.cumsum(counts)))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.diff(ends[offsets]), ends[1:][stops]


def listed(words: pa.Array) -> list[str]:
    """The words, none of which holds a space, as Python strings: in one string, then split."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py().split(" ") if len(words) else []


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """pool[starts[0]:starts[0]+counts[0]], then the next range, and so on, in one array."""
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at += np.arange(len(at))
    return pool[at]


def ascending(*parts: np.ndarray) -> np.ndarray:
    """The distinct values of all parts in order, by one sort."""
    x = np.sort(np.concatenate(parts))
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def cut(points: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """The best cuts of a stream that starts at 0 and ends at points[-1].

    points: where a cut may fall, ascending; gaps of at most length. A
    sequence of n tokens costs its padding, length - n, or nothing at a power
    of two; each cut costs its penalty. best(j) = penalty(j) + least over i in
    [j - length, j) of best(i) + cost(j - i): since length - (j - i) parts into
    a term of i and one of j, the least is the head of a monotone queue of
    best(i) + i; powers of two are looked up.
    """
    end = int(points[-1])
    # by place + length, so that places before the start need no test; which points lie a power of two before each point
    is_point = np.zeros(end + length + 1, bool)
    is_point[points + length] = is_point[length] = True
    ahead, behind = [], []
    for k in range(length.bit_length()):
        if 1 << k < length:
            from_ = points + (length - (1 << k))
            hit = np.flatnonzero(is_point[from_])
            ahead.append(hit)
            behind.append(from_[hit])
    ahead, behind = np.concatenate(ahead), np.concatenate(behind)
    order = np.argsort(ahead, kind="stable")
    looks, first = behind[order].tolist(), np.searchsorted(ahead[order], np.arange(len(points) + 1)).tolist()
    best = [0.0] * (end + length + 1)
    back = [0] * (end + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j, (p, fee) in enumerate(zip(points.tolist(), penalty.tolist(), strict=True)):
        while queue[0][1] < p - length:
            queue.popleft()
        key, i = queue[0]
        least = key + length - p
        for m in looks[first[j] : first[j + 1]]:
            if best[m] < least:
                least, i = best[m], m - length
        least += fee
        best[p + length] = least
        back[p] = i
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p))
    cuts, p = [], end
    while p:
        cuts.append(p)
        p = back[p]
    return cuts[::-1]


class Packer:
    """Takes documents in order; gives rows of pieces. Holds one block of tokens and what it could not yet close."""

    def __init__(self, length: int, sentence_fee: float, inner_fee: float, spacing: int, first_id: int):
        self.length, self.fees, self.spacing = length, (sentence_fee, inner_fee), spacing
        self.sequence = first_id
        self.ids = np.empty(0, np.uint32)
        self.points = np.empty(0, np.int64)  # sentence ends in the stream
        self.docs: list[tuple[int, int, int, int]] = []  # row, begin in the stream, end, ids before it that have been handed out

    def add(self, rows: list[int], ids: np.ndarray, counts: np.ndarray, stops: np.ndarray) -> None:
        base = len(self.ids)
        ends = base + np.cumsum(counts)
        self.docs += [(r, e - c, e, 0) for r, e, c in zip(rows, ends.tolist(), counts.tolist(), strict=True)]
        self.ids = np.concatenate((self.ids, ids))
        self.points = np.concatenate((self.points, base + stops))

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Pieces (row, start, length, crc, doc_tokens, sequence, offset) of all full sequences; at the end of the rest, too."""
        n, length = len(self.ids), self.length
        if not n:
            return
        docs = ascending(np.array([d[2] for d in self.docs], np.int64))
        stops = self.points[self.points <= n]
        marks = ascending(docs, stops)
        gaps = np.diff(marks, prepend=0)
        inner = [np.arange(a + self.spacing, a + g, self.spacing) for a, g in zip((marks - gaps)[gaps > 4 * self.spacing].tolist(), gaps[gaps > 4 * self.spacing].tolist(), strict=True)]
        tail = np.arange(max(1, n - length), n) if last else np.empty(0, np.int64)
        points = ascending(marks, tail, *inner, np.array([n], np.int64))
        points = points[points > 0]
        fee = np.full(len(points), self.fees[1])
        fee[np.searchsorted(points, stops[stops > 0])] = self.fees[0]
        fee[np.searchsorted(points, docs)] = 0
        cuts = cut(points, fee, length)
        if not last:  # the last cuts lean on an end that isn't one
            cuts = [c for c in cuts if c <= n - 4 * length]
        done, d = 0, 0
        for c in cuts:
            offset, begin = 0, done
            while begin < c:
                while self.docs[d][2] <= begin:
                    d += 1
                row, a, e, gone = self.docs[d]
                end = min(c, e)
                yield row, begin - a + gone, end - begin, zlib.crc32(self.ids[begin:end].astype("<u4").tobytes()), e - a + gone, self.sequence, offset
                offset += end - begin
                begin = end
            done = c
            self.sequence += 1
        self.docs = [(r, max(0, a - done), e - done, gone + max(0, done - a)) for r, a, e, gone in self.docs if e > done]
        self.ids = self.ids[done:]
        self.points = self.points[self.points > done] - done


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, text: str = "text", doc_id: str = "doc_id", sentence_fee: float = 4.0, inner_fee: float = 32.0, spacing: int = 32) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: the file of a tokenizer whose pieces never span white space, on
    every executor. Each document is its ids and then end_id; a null or empty
    text is end_id alone. Sequences follow the order of the rows in each
    partition and never span two; sequence ids hold the partition's number in
    their upper bits, so a task that is run again gives the same ones. A
    document longer than length is cut into pieces. Null and repeated doc_ids
    are kept as they are: a piece belongs to one row. Other columns are not
    read, and an empty table gives an empty table. Memory: one slice of text
    and one block of tokens, or one document where that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _TOKENS
        if "_TOKENS" not in globals() or _TOKENS[0] != tokenizer:
            _TOKENS = (tokenizer, Tokens(tokenizer))
        tokens = _TOKENS[1]
        packer = Packer(length, sentence_fee, inner_fee, spacing, TaskContext.get().partitionId() << 40)
        names: list = []  # the doc_id of each row; rows handed out are dropped with their slice

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = list(packer.pack(last))
            if pieces:
                row, *rest = map(list, zip(*pieces, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in row], id_type), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for first, rows in slices(batch.column(1), SLICE):
                ids, counts, stops = tokens.encode(rows)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                at = np.searchsorted(ends, stops)  # ids that end earlier documents come before
                base = len(names)
                names.extend(batch.column(0).slice(first, len(rows)).to_pylist())
                packer.add(list(range(base, len(names))), ids, counts + 1, stops + at)
                if len(packer.ids) >= BLOCK_TOKENS:
                    yield from out(False)
                    if packer.docs and packer.docs[0][0] > 100_000:
                        gone = packer.docs[0][0]
                        del names[:gone]
                        packer.docs = [(r - gone, *d) for r, *d in packer.docs]
        yield from out(True)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
