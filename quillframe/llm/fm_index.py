"""FM-index over word symbols of a shard: suffix sorting, wavelet ranks, backward search, locating.

All steps are array operations over the whole shard or over all phrases at once.
Symbol 0 stands for each word or document end that no phrase has; no match can
hold it, so every 0 counts as a symbol of its own, ordered by place.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; only groups that are still equal are sorted again."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    zero = symbols == 0
    n_zero = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + n_zero - 1)
    bits = max(1, int(rank.max() + 1).bit_length())
    step = min(4, 63 // bits)
    pad = np.zeros(n + step, dtype=np.uint64)
    pad[:n] = rank + 1
    key = np.zeros(n, dtype=np.uint64)
    for k in range(step):
        key = (key << np.uint64(bits)) | pad[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.empty(n + 1, dtype=np.int64)  # the rank of each suffix, and of the empty one
    place[order] = head + 1
    place[n] = 0
    last = np.ones(n, dtype=bool)
    last[:-1] = new[1:]
    open_rows = np.flatnonzero(~(new & last))
    # a zero at the head of a key makes it unique, but what follows a zero must not order equals
    while len(open_rows):
        at = order[open_rows]
        nxt = np.minimum(at + step, n)
        sub = (place[at].astype(np.uint64) << np.uint64(32)) | place[nxt].astype(np.uint64)
        s = np.argsort(sub)
        order[open_rows] = at[s]
        sub = sub[s]
        fresh = np.ones(len(sub), dtype=bool)
        fresh[1:] = sub[1:] != sub[:-1]
        heads = np.maximum.accumulate(np.where(fresh, np.arange(len(sub)), 0))
        place[at[s]] = open_rows[heads] + 1
        ends = np.ones(len(sub), dtype=bool)
        ends[:-1] = fresh[1:]
        open_rows = open_rows[~(fresh & ends)]
        step *= 2
    return order


class Wavelet:
    """Wavelet matrix of a sequence: occurrences of a symbol before a place, and the symbol at a place."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq.astype(np.uint32)
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (cur >> np.uint32(shift)) & np.uint32(1) == 1
            ones = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, ones in enumerate(self.levels):
            bit = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            s1, e1 = ones[start], ones[end]
            start = np.where(bit, self.zeros[k] + s1, start - s1)
            end = np.where(bit, self.zeros[k] + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        start, end, symbol = np.zeros(len(at), np.int64), at.astype(np.int64), np.zeros(len(at), np.int64)
        for k, ones in enumerate(self.levels):
            s1, e1 = ones[start], ones[end]
            bit = ones[end + 1] > e1
            symbol = symbol * 2 + bit
            start = np.where(bit, self.zeros[k] + s1, start - s1)
            end = np.where(bit, self.zeros[k] + e1, end - e1)
        return symbol, end - start


class FMIndex:
    """Index of a shard's symbols (0: no phrase has it; the last one is 0, so no row for the empty suffix is needed). Every `rate`-th suffix position is kept, and each that follows a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, rate: int = 8):
        self.n = len(symbols)
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], 0) if self.n else symbols
        self.counts = np.bincount(symbols, minlength=n_symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.wavelet = Wavelet(before, n_symbols)
        kept = (before == 0) | (order % rate == 0)
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept_at = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes for each phrase (rows padded at the end; symbol 0: cannot occur)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        inside = np.arange(width)[None, :] < lengths[:, None]
        possible = ((self.counts[phrases] > 0) & (phrases > 0) | ~inside).all(axis=1) & (lengths > 0)
        hi[~possible] = 0
        for k in range(width - 1, -1, -1):
            go = np.flatnonzero((lo < hi) & (lengths > k))
            if len(go):
                c = phrases[go, k]
                lo[go] = self.first[c] + self.wavelet.rank(c, lo[go])
                hi[go] = self.first[c] + self.wavelet.rank(c, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the shard of each suffix of these rows: back to a kept one, then forward by the steps taken."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows)), 0
        while len(todo):
            kept = self.kept_rank[at + 1] > self.kept_rank[at]
            out[todo[kept]] = self.kept_at[self.kept_rank[at[kept]]] + steps
            todo, at = todo[~kept], at[~kept]
            if len(todo):
                symbol, rank = self.wavelet.access(at)
                at = self.first[symbol] + rank
            steps += 1
        return out
