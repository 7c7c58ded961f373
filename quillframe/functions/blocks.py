"""Matching blocks of two sequences by the longest common block, then left and right of it, for many pairs at a time.

Equal symbols of a pair are cells; cells on one diagonal without a gap are runs, found once by sorting. The longest block of a part
of a pair is a run cut to that part, so each round cuts the runs of all open parts of all pairs, takes the best
of each part and hands the rest to its two sides. No pair has a loop of its own.

As in the common definition, a symbol that makes up more than a hundredth of a second sequence of 200 and more starts no block; a block goes on over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: From which length frequent symbols start no block, and the share that makes one frequent.
LONG, SHARE = 200, 100
#: Cells that one round of pairs has, about; a pair beyond that is a round of its own.
CELLS = 2_000_000
#: Symbols of both sequences that are sorted at once, about: memory follows this, not how many pairs come in a batch.
SYMBOLS = 500_000


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers 0, 0, .., 1, .. by the counts n, and the place in each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _keys(symbols: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) * base + symbols


def matching_blocks(a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pair, i, j, size of each block, by pair and i. a, b: symbols (numbers from 0) of all sequences, one after the other; first: where each starts, one more at the end."""
    first_a, first_b = np.asarray(first_a, np.int64), np.asarray(first_b, np.int64)
    before, out, at = first_a + first_b, [], 0
    while at < len(before) - 1:
        to = max(at + 1, int(np.searchsorted(before, before[at] + SYMBOLS, "right")) - 1)
        pair, *block = _sorted_blocks(a[first_a[at] : first_a[to]], first_a[at : to + 1] - first_a[at], b[first_b[at] : first_b[to]], first_b[at : to + 1] - first_b[at])
        out.append((pair + at, *block))
        at = to
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple([np.zeros(0, np.int64)] * 4)


def _sorted_blocks(a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """matching_blocks() of some pairs, all sorted together."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    base = int(max(a.max(initial=0), b.max(initial=0))) + 1
    key_a, key_b = _keys(a, first_a, base), _keys(b, first_b, base)
    order = np.argsort(key_b, kind="stable")
    sorted_b = key_b[order]
    n_b = np.diff(first_b)
    # frequent symbols of long second sequences
    count = np.searchsorted(sorted_b, sorted_b, "right") - np.searchsorted(sorted_b, sorted_b, "left")
    long = np.repeat(n_b, n_b)[order]
    rare = ~((long >= LONG) & (count > long // SHARE + 1))
    sorted_b, order = sorted_b[rare], order[rare]
    lo, hi = np.searchsorted(sorted_b, key_a, "left"), np.searchsorted(sorted_b, key_a, "right")
    cells = np.add.reduceat(np.append(hi - lo, 0), np.minimum(first_a[:-1], len(a))) if len(first_a) > 1 else np.zeros(0, np.int64)
    cells[np.diff(first_a) == 0] = 0
    greedy = np.zeros(len(n_b), bool)
    greedy[n_b >= LONG] = True
    out, at, total = [], 0, np.cumsum(cells)
    while at < len(cells):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS, "right")))
        out.append(_round(at, to, a, first_a, b, first_b, lo, hi, order, greedy))
        at = to
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    by = np.lexsort((columns[1], columns[0]))
    return tuple(c[by] for c in columns)


def _round(at, to, a, first_a, b, first_b, lo, hi, order, greedy):
    """Blocks of the pairs at .. to - 1."""
    mine = slice(first_a[at], first_a[to])
    which, step = _expand((hi - lo)[mine])
    pair = np.repeat(np.arange(at, to), np.diff(first_a[at : to + 1]))[which]
    i = which + first_a[at] - first_a[pair]
    j = order[lo[mine][which] + step] - first_b[pair]
    # diagonal by diagonal: a cell's neighbour on it is the next number
    stride = np.diff(first_a[at : to + 1]) + 1
    height = np.diff(first_b[at : to + 1]) + np.diff(first_a[at : to + 1]) + 1
    start = np.concatenate([[0], np.cumsum(stride * height)])
    p = pair - at
    number = np.sort(start[p] + (i - j + np.diff(first_b)[pair]) * stride[p] + i)
    edge = np.flatnonzero(np.diff(number, prepend=-2) != 1)
    n = np.diff(np.append(edge, len(number)))
    head = number[edge]
    p = np.searchsorted(start, head, "right") - 1
    diagonal, i = np.divmod(head - start[p], stride[p])
    j = i - (diagonal - np.diff(first_b)[p + at])
    seg_pair = np.arange(at, to)
    seg = np.stack([np.zeros(to - at, np.int64), np.diff(first_a[at : to + 1]), np.zeros(to - at, np.int64), np.diff(first_b[at : to + 1])])
    own, found = p, []
    while seg.shape[1]:
        alo, ahi, blo, bhi = seg
        s = np.maximum(0, np.maximum(alo[own] - i, blo[own] - j))
        e = np.minimum(n, np.minimum(ahi[own] - i, bhi[own] - j))
        keep = e > s
        own, i, j, n = own[keep], (i + s)[keep], (j + s)[keep], (e - s)[keep]
        best_i, best_j, best_n = alo.copy(), blo.copy(), np.zeros(len(alo), np.int64)
        first = np.lexsort((j, i, -n, own))
        first = first[np.diff(own[first], prepend=-1) != 0] if len(first) else first
        best_i[own[first]], best_j[own[first]], best_n[own[first]] = i[first], j[first], n[first]
        _grow(a, first_a, b, first_b, seg_pair, seg, best_i, best_j, best_n, greedy)
        full = best_n > 0
        found.append((seg_pair[full], best_i[full], best_j[full], best_n[full]))
        # what is left of the block, then what is right of it
        sides = [np.stack([alo, best_i, blo, best_j]), np.stack([best_i + best_n, ahi, best_j + best_n, bhi])]
        left_run = np.flatnonzero(full[own] & (i < best_i[own]) & (j < best_j[own]))
        right_run = np.flatnonzero(full[own] & (i + n > (best_i + best_n)[own]) & (j + n > (best_j + best_n)[own]))
        has_run = [np.zeros(len(alo), bool), np.zeros(len(alo), bool)]
        has_run[0][own[left_run]] = has_run[1][own[right_run]] = True
        numbers, parts, pairs, total = [], [], [], 0
        for side, some in zip(sides, has_run, strict=True):
            open_ = full & (side[1] > side[0]) & (side[3] > side[2]) & (some | greedy[seg_pair])
            number = np.full(len(alo), -1)
            number[open_] = total + np.arange(int(open_.sum()))
            total += int(open_.sum())
            numbers.append(number)
            parts.append(side[:, open_])
            pairs.append(seg_pair[open_])
        take = np.concatenate([left_run, right_run])
        own = np.concatenate([numbers[0][own[left_run]], numbers[1][own[right_run]]])
        i, j, n = i[take], j[take], n[take]
        keep = own >= 0
        own, i, j, n = own[keep], i[keep], j[keep], n[keep]
        seg, seg_pair = np.concatenate(parts, axis=1), np.concatenate(pairs)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _grow(a, first_a, b, first_b, pair, seg, i, j, n, greedy) -> None:
    """Blocks of pairs with frequent symbols go on over those, within their part; in place."""
    alo, ahi, blo, bhi = seg
    start_a, start_b = first_a[pair], first_b[pair]
    open_ = np.flatnonzero(greedy[pair])
    while len(open_ := open_[(i[open_] > alo[open_]) & (j[open_] > blo[open_])]):
        open_ = open_[a[start_a[open_] + i[open_] - 1] == b[start_b[open_] + j[open_] - 1]]
        i[open_] -= 1
        j[open_] -= 1
        n[open_] += 1
    open_ = np.flatnonzero(greedy[pair])
    while len(open_ := open_[(i[open_] + n[open_] < ahi[open_]) & (j[open_] + n[open_] < bhi[open_])]):
        open_ = open_[a[start_a[open_] + i[open_] + n[open_]] == b[start_b[open_] + j[open_] + n[open_]]]
        n[open_] += 1


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each starts; a null is empty."""
    texts = texts.fill_null("")
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)


def word_numbers(left: pa.Array, right: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Words by white space of two columns of texts, as numbers that both share, and where each text's start."""
    split = [pc.utf8_split_whitespace(pc.utf8_trim_whitespace(t.fill_null(""))) for t in (left, right)]
    flat = pa.concat_arrays([s.flatten() for s in split])
    number, full = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    out, at = [], 0
    for s in split:
        lengths = s.value_lengths().to_numpy(zero_copy_only=False)
        own = full[at : at + int(lengths.sum())]
        first = np.concatenate([[0], np.cumsum(lengths)])
        kept = np.concatenate([[0], np.cumsum(own)])[first]
        out.append((number[at : at + len(own)][own], kept.astype(np.int64)))
        at += len(own)
    return out[0], out[1]


def ratios(a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Twice the matched symbols over all symbols of each pair; 1 where both are empty."""
    pair, _, _, size = matching_blocks(a, first_a, b, first_b)
    total = np.diff(first_a) + np.diff(first_b)
    return np.where(total > 0, 2.0 * np.bincount(pair, size, len(total)) / np.maximum(total, 1), 1.0)
