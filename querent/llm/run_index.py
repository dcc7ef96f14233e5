"""A run-compressed Burrows-Wheeler index over short strings, and matching statistics through it.

The text is the strings end to end, each closed by a separator that ranks below all bytes;
equal suffixes rank by place. Suffixes are ordered once, by doubling, to build the transform;
what is kept are its runs and nothing with an entry for each row:

* the symbol, the first row and the size of a run, and where it lands under LF (a run and an
  offset in it), so that a step costs one look-up and no rank;
* the text places of its first and last row (the sampled run ends);
* the least owner of the suffixes that share their first ``width`` bytes with those of the run
  (a run ends where this changes);
* between two runs of one symbol, the row from which the later one shares more (a threshold).

``stream`` reads any strings backwards, all in step. Where the byte goes on in the row's run, LF
follows it; else the row jumps to the nearer end of a run of that byte, by threshold, whose
sampled place starts the match anew. So it has, for every place of the strings, a text place
that shares the most bytes with them from there on. ``matched`` compares the bytes at these places up
to ``width``: the matching statistics, truncated.
"""

from __future__ import annotations

import numpy as np

from querent.llm import kernels as K

SEPARATOR = 0xFF  # in no UTF-8 text
NONE = np.iinfo(np.int64).max


class RunIndex:
    def __init__(self, strings: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int):
        """strings: bytes end to end; lengths of each, all positive, and their owners."""
        self.width = width
        ends = np.cumsum(lengths + 1)
        n = int(ends[-1])
        raw = np.full(n, SEPARATOR, dtype=np.uint8)
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        raw[inside] = strings
        used = np.zeros(256, dtype=bool)
        used[strings] = True
        self.code = np.where(used, np.cumsum(used), -1)
        self.sigma = int(used.sum()) + 1
        text = np.zeros(n, dtype=np.uint64)
        text[inside] = self.code[strings]
        left = np.repeat(ends, lengths + 1) - 1 - np.arange(n)
        order, shared = _sorted(text, left, self.sigma, int(lengths.max()) + 1)
        self.text = K.eights(raw)
        self._compress(text, order, shared, np.where(left >= width, np.repeat(owners, lengths + 1), NONE)[order])

    def _compress(self, text: np.ndarray, order: np.ndarray, shared: np.ndarray, owners: np.ndarray) -> None:
        n = len(text)
        classes = np.flatnonzero(shared < self.width)
        least = np.repeat(np.minimum.reduceat(owners, classes), np.diff(np.append(classes, n)))
        last = text[order - 1].astype(np.int64)
        self.starts = np.flatnonzero(np.concatenate(([True], (last[1:] != last[:-1]) | (least[1:] != least[:-1]))))
        r = len(self.starts)
        ends = np.append(self.starts[1:], n)
        self.sizes = ends - self.starts
        self.heads = last[self.starts]
        self.least = least[self.starts]
        self.at_start, self.at_end = order[self.starts], order[ends - 1]
        first_row = np.concatenate(([0], np.cumsum(np.bincount(last, minlength=self.sigma))))
        by = np.argsort(self.heads, kind="stable")
        lands = np.empty(r, dtype=np.int64)
        lands[by] = np.cumsum(self.sizes[by]) - self.sizes[by]  # rows of lower symbols, and of this one before: LF of the run's first row
        self.to_run = np.searchsorted(self.starts, lands, side="right") - 1
        self.to_offset = lands - self.starts[self.to_run]
        assert int(first_row[-1]) == n
        self.by, self.keys = by, self.heads[by] * r + by
        self.edges = np.searchsorted(self.heads[by], np.arange(self.sigma + 1))
        self.threshold = self._thresholds(shared)

    def _thresholds(self, shared: np.ndarray) -> np.ndarray:
        """For each run but the first of its symbol, the row from which it shares at least as much as the one before."""
        packed = shared << 32 | np.arange(len(shared))
        low = np.minimum.reduceat(packed, self.starts)
        i, j = self.by[:-1], self.by[1:]
        out = packed[self.starts[j]]  # the first row of the later run; whole runs lie between
        gap = np.where(self.heads[i] == self.heads[j], j - i - 1, 0)
        level, size = low, 1
        while len(own := np.flatnonzero((gap >= size) & (gap < 2 * size))) or (gap >= 2 * size).any():
            out[own] = np.minimum(out[own], np.minimum(level[i[own] + 1], level[j[own] - size]))
            level = np.minimum(level[:-size], level[size:])
            size *= 2
        return np.concatenate(([0], out & 0xFFFFFFFF))

    def _jump(self, symbol: np.ndarray, run: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, offset, text place) of the run end with a symbol that shares most with the given rows."""
        k = np.searchsorted(self.keys, symbol * len(self.starts) + run)
        before, after = k > self.edges[symbol], k < self.edges[symbol + 1]
        row = self.starts[run] + offset
        back = before & (~after | (row < self.threshold[np.minimum(k, len(self.by) - 1)]))
        to = self.by[np.where(back, k - 1, k)]
        return to, np.where(back, self.sizes[to] - 1, 0), np.where(back, self.at_end[to], self.at_start[to])

    def stream(self, strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the query strings (end to end): a text place that shares the most bytes from there on (-1: its byte
        is not in the text), and the least owner of the suffixes that share ``width`` bytes with that one."""
        total = int(lengths.sum())
        pointer, least = np.full(total, -1, dtype=np.int64), np.full(total, NONE)
        by = np.argsort(-lengths, kind="stable")
        sizes, last = lengths[by], np.cumsum(lengths)[by] - 1
        run, offset = np.zeros(len(by), dtype=np.int64), np.zeros(len(by), dtype=np.int64)
        place = np.full(len(by), self.at_start[0])
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            run, offset, place = run[:n], offset[:n], place[:n]
            at = last[:n] - step
            symbol = self.code[strings[at]]
            lost = np.flatnonzero(self.heads[run] != symbol)
            strange = lost[symbol[lost] < 0]
            if len(strange):
                lost = lost[symbol[lost] >= 0]
            if len(lost):
                run[lost], offset[lost], place[lost] = self._jump(symbol[lost], run[lost], offset[lost])
            offset = offset + self.to_offset[run]
            run = self.to_run[run]
            over = np.flatnonzero(offset >= self.sizes[run])
            for _ in range(4):
                if not len(over):
                    break
                offset[over] -= self.sizes[run[over]]
                run[over] += 1
                over = over[offset[over] >= self.sizes[run[over]]]
            if len(over):
                row = self.starts[run[over]] + offset[over]
                run[over] = np.searchsorted(self.starts, row, side="right") - 1
                offset[over] = row - self.starts[run[over]]
            place = place - 1
            run[strange], offset[strange], place[strange] = 0, 0, self.at_start[0]
            pointer[at], least[at] = place, self.least[run]
            pointer[at[strange]], least[at[strange]] = -1, NONE
        return pointer, least

    def matched(self, strings: np.ndarray, lengths: np.ndarray, pointer: np.ndarray) -> np.ndarray:
        """Starts, ascending, of the ``width`` bytes of the query strings that the text has at their pointers."""
        at = K.spread(np.concatenate(([0], np.cumsum(lengths))), self.width)
        at = at[pointer[at] >= 0]
        return at[K.equal_spans(K.eights(strings), at, self.text, pointer[at], np.full(len(at), self.width))]


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    own = key[order]
    new = np.empty(len(key), dtype=np.uint64)
    new[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1]))).astype(np.uint64)
    return new


def _doubled(rank: np.ndarray, step: int, left: np.ndarray) -> np.ndarray:
    """Ranks by the symbols that rank covers and ``step`` more, from those ``step`` places on."""
    n = len(rank)
    second = np.zeros(n, dtype=np.uint64)
    second[:-step] = np.where(left[:-step] >= step, rank[step:] + np.uint64(1), np.uint64(0))
    if n >= 1 << 20:
        return _ranks(rank << np.uint64(32) | second)
    # both ranks and the place fit one word, and sorting words is faster than sorting places by them
    key = np.sort(rank << np.uint64(42) | second << np.uint64(21) | np.arange(n, dtype=np.uint64))
    own = key >> np.uint64(21)
    new = np.empty(n, dtype=np.uint64)
    new[(key & np.uint64((1 << 21) - 1)).astype(np.int64)] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1]))).astype(np.uint64)
    return new


def _sorted(text: np.ndarray, left: np.ndarray, sigma: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the bytes that each row's suffix shares with the one before. left: bytes before the separator."""
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    depth = min(64 // bits, longest)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(depth):
        key <<= np.uint64(bits)
        key[: n - i] |= np.where(left[: n - i] >= i, text[i:], np.uint64(0))
    levels = [(depth, _ranks(key))]
    while depth < longest:
        levels.append((2 * depth, _doubled(levels[-1][1], depth, left)))
        depth *= 2
    # suffixes equal up to their separator keep the order of the text, as LF on the transform needs
    order = (np.sort(levels[-1][1] << np.uint64(32) | np.arange(n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    a, b = order[:-1], order[1:]
    most = np.minimum(left[a], left[b])
    own = np.zeros(n - 1, dtype=np.int64)
    for size, rank in reversed(levels):
        own = np.minimum(own + size * (rank[a + own] == rank[b + own]), most)
    differ = key[a + own] ^ key[b + own]
    first = levels[0][0]
    for i in range(1, first):
        own += (differ >> np.uint64(bits * (first - i))) == 0
    return order, np.concatenate(([0], np.minimum(own, most)))
