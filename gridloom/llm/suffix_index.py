"""A run-length index of short texts: run-compressed Burrows-Wheeler transform, sampled run ends, matching statistics."""

from __future__ import annotations

import numpy as np


def _ranks(key: np.ndarray, most: int) -> np.ndarray:
    """The place of each key (0 to most) among the distinct ones: key and position are sorted as one integer where they fit in 63 bits."""
    n = len(key)
    bits = n.bit_length()
    if not n or most.bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)[1]
    both = np.sort(key << bits | np.arange(n))
    high = both >> bits
    out = np.empty(n, np.int64)
    out[both & ((1 << bits) - 1)] = np.cumsum(np.concatenate(([0], high[1:] != high[:-1])))
    return out


class RunLengthIndex:
    """Texts (byte strings), each with a number; answers, for a pattern's every position, how long it matches and the least number among the texts that hold a match of at least depth bytes.

    Rows are the suffixes of all texts in order, each text ending in a mark
    of its own that sorts before all bytes. Only the runs of the transform are
    kept, with the position of the suffix at each run's end, and for the
    intervals of suffixes that agree on depth bytes their first row and least
    number.
    """

    def __init__(self, texts: list[bytes], numbers: np.ndarray, depth: int):
        self.depth, m = depth, len(texts)
        sizes = np.fromiter((len(t) for t in texts), np.int64, m)
        n = int(sizes.sum()) + m
        symbol = np.zeros(n, np.int64)  # 0: the mark after a text
        self.ends = np.cumsum(sizes + 1) - 1
        body = np.ones(n, bool)
        body[self.ends] = False
        symbol[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.symbol = symbol
        text = np.repeat(np.arange(m), sizes + 1)
        left = self.ends[text] - np.arange(n)  # symbols of the suffix before its mark
        # ranks of suffixes by their first few symbols, as many as fit in one integer with a position, then by twice as many and so on; marks tell apart what ends alike
        code = np.zeros(257, np.int64)
        code[symbol] = 1
        code = np.cumsum(code) - 1 if n and code[0] else np.cumsum(code)  # in the same order, the mark is 0
        width = int(code[256]).bit_length()
        pack = max(1, min(7, depth, (63 - n.bit_length()) // max(1, width)))
        dense, key = code[symbol], np.zeros(n, np.int64)
        for j in range(pack):
            key <<= width
            if n > j:
                key[: n - j] |= np.where(left[: n - j] >= j, dense[j:], 0)
        rank, at, agree = _ranks(key, (1 << width * pack) - 1), pack, []
        longest = int(sizes.max()) + 1 if m else 1
        while at < longest:
            agree.append((at, rank))
            follow = np.zeros(n, np.int64)
            ok = left >= at
            follow[ok] = rank[np.flatnonzero(ok) + at] + 1
            rank = _ranks(rank * (n + 2) + follow, (n + 1) * (n + 2))
            at *= 2
        agree.append((at, rank))
        bits = n.bit_length()
        rows = np.sort(rank << bits | np.arange(n)) & ((1 << bits) - 1)  # equal to the mark: in order of the texts
        before = np.where(np.concatenate(([True], ~body[:-1])), 0, np.concatenate(([0], symbol[:-1])))[rows] if n else symbol
        # runs of the transform; marks never continue a run, as each is a symbol of its own
        starts = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))) if n else np.empty(0, np.int64)
        self.starts, self.heads = starts, before[starts]
        self.lengths = np.diff(np.append(starts, n))
        self.last = rows[np.append(starts[1:], n) - 1]  # sampled: the suffix at each run's end
        self.first = rows[starts]
        order = np.argsort(self.heads.astype(np.int16), kind="stable")
        self.of, total = {}, np.cumsum(np.bincount(symbol, minlength=257)) if n else np.zeros(257, np.int64)
        self.base = np.concatenate(([0], total))  # rows whose suffix begins with a smaller symbol
        self.seen = np.zeros(len(starts), np.int64)  # of a run's symbol, in the runs before it
        cuts = np.searchsorted(self.heads[order], np.arange(258))
        for c in range(1, 257):
            runs = order[cuts[c] : cuts[c + 1]]
            if len(runs):
                self.seen[runs] = np.cumsum(self.lengths[runs]) - self.lengths[runs]
                self.of[c] = runs
        # intervals of suffixes that agree on depth bytes
        valid = left >= depth
        step, ranks = max((a for a in agree if a[0] <= depth), key=lambda a: a[0])
        pair = np.full(n, -1, np.int64)
        ok = np.flatnonzero(valid)
        pair[ok] = ranks[ok] * (n + 2) + ranks[ok + depth - step] if 2 * step >= depth else self._covering(ok, depth, step, ranks, n)
        in_rows, ok_rows = pair[rows], valid[rows]
        new = np.concatenate(([True], (in_rows[1:] != in_rows[:-1]) | ~ok_rows[1:] | ~ok_rows[:-1])) if n else np.empty(0, bool)
        self.interval = np.flatnonzero(new)
        number = np.where(ok_rows, np.asarray(numbers, np.int64)[text[rows]], np.iinfo(np.int64).max) if n else np.empty(0, np.int64)
        self.least = np.minimum.reduceat(number, self.interval) if n else number
        self.size = n

    @staticmethod
    def _covering(ok: np.ndarray, depth: int, step: int, ranks: np.ndarray, n: int) -> np.ndarray:
        out = ranks[ok]
        for at in [*range(step, depth - step, step), depth - step]:
            out = np.unique(out * (n + 2) + ranks[ok + at], return_inverse=True)[1]
        return out

    def back(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer to the left; run: the run that row stands in."""
        return self.base[self.heads[run]] + self.seen[run] + row - self.starts[run]

    def common(self, a: int, b: int, most: int) -> int:
        """Symbols that the suffixes at positions a and b share, up to most and to a mark."""
        k = 0
        while k < most and self.symbol[a + k] == self.symbol[b + k] and self.symbol[a + k]:
            k += 1
        return k

    def statistics(self, patterns: list[bytes], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, least) as arrays (pattern, position): how far the pattern matches from there, and the least number among the texts with a match of depth bytes there (the largest integer where none is that long).

        All patterns are streamed from their ends in step, a symbol at a time.
        own: for patterns that are texts of the index, their places in it; then
        a pattern begins at its own mark and never has to look for a row.
        """
        m = len(patterns)
        sizes = np.fromiter((len(p) for p in patterns), np.int64, m)
        widest = int(sizes.max()) if m else 0
        symbols = np.zeros((m, widest), np.int64)
        for i, p in enumerate(patterns):
            symbols[i, : len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 1
        lengths = np.zeros((m, widest), np.int64)
        least = np.full((m, widest), np.iinfo(np.int64).max)
        row = np.asarray(own, np.int64).copy() if own is not None else np.zeros(m, np.int64)
        pos = self.ends[row].copy() if own is not None and m else np.full(m, self.ends[0] if len(self.ends) else 0)
        size = np.zeros(m, np.int64)
        for k in range(widest):
            live = np.flatnonzero(sizes > k)
            j = sizes[live] - 1 - k
            c = symbols[live, j]
            run = np.searchsorted(self.starts, row[live], side="right") - 1
            miss = np.flatnonzero(self.heads[run] != c)
            for i in miss.tolist():  # no match to the left: go to the nearest run of the symbol, above or below
                p, runs = live[i], self.of.get(int(c[i]))
                if runs is None:
                    size[p], row[p], pos[p] = -1, 0, self.ends[0]
                    run[i] = 0
                    continue
                at = np.searchsorted(runs, run[i])
                best = (-1, 0, 0, 0)
                for r, end in ((runs[at - 1], True) if at > 0 else (None, True), (runs[at], False) if at < len(runs) else (None, False)):
                    if r is not None:
                        to = int(self.last[r] if end else self.first[r])
                        best = max(best, (self.common(int(pos[p]), to, int(size[p])), int(self.starts[r] + self.lengths[r] - 1 if end else self.starts[r]), to, int(r)))
                size[p], row[p], pos[p], run[i] = best
            moved = np.flatnonzero(size[live] >= 0)
            go = live[moved]
            row[go] = self.back(row[go], run[moved])
            pos[go] -= 1
            size[live] += 1  # a symbol that no text holds starts anew at nothing
            lengths[live, j] = size[live]
            deep = live[size[live] >= self.depth]
            inside = np.searchsorted(self.interval, row[deep], side="right") - 1
            least[deep, sizes[deep] - 1 - k] = self.least[inside]
        return lengths, least
