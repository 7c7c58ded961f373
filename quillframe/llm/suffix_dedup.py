"""Exact substring dedup by depth-limited most-significant-digit radix sorting of suffixes.

Suffixes are ordered only through `depth` bytes; suffixes that are equal so far are the
repeated windows. The passes go from a digit that prunes to digits that decide:

1. The first digit of a suffix is the smallest 48-byte gram among those of its window,
   with its place in the window: equal windows have it in common, and neighbouring
   suffixes share it, so one record stands for some 180 suffixes. A gram that stands once
   ends its suffixes' sorting; runs of suffixes whose whole surroundings are equal are repeats as they stand.
2. Suffixes of the runs that remain, where a repeat begins or ends, are sorted by two digits of
   half the depth each, the second only where the first is shared. Groups of two and more are repeats.

Digits are 64-bit (the last one 32-bit) fingerprints of bytes. Texts are moved twice,
digits once; the steps end in written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm import kernels as K
from quillframe.llm import packed as P
from quillframe.llm.common import buckets, chunks, keyed, map_batches, materialize, own_id

DEPTH = 400
GRAM = 48
#: Bytes of a chunk's texts; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Suffixes whose digits are made at a time: a long text takes no more memory for them than a chunk.
WINDOW = CHUNK
FULL, OPEN = 1, 2
#: A place in a chunk has 32 bits, so a text may have 4 GB.
_PLACE_BITS = 32
_NAME_TYPES = (np.int64, np.int64, np.int64)
FOUND = "_id long, _sum long, runs array<int>, open array<int>"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbouring values."""
    n = len(x)
    blocks = -(-n // width)
    pad = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    pad = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def equal_groups(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: record numbers in groups that share all digits, groups of two and more only, and where each group starts (and the last ends)."""
    rows = np.arange(len(digits[0]))
    group = np.zeros(len(rows), np.int64)
    bounds = np.zeros(1, np.int64)
    for digit in digits:
        d = digit[rows]
        order = np.lexsort((d, group)) if group.any() else np.argsort(d, kind="stable")
        rows, d, group = rows[order], d[order], group[order]
        new = np.ones(len(rows), bool)
        new[1:] = (d[1:] != d[:-1]) | (group[1:] != group[:-1])
        bounds = np.append(np.flatnonzero(new), len(rows))
        size = np.diff(bounds)
        keep = np.repeat(size > 1, size)
        rows, group = rows[keep], np.repeat(np.arange(len(size)), size)[keep]
        bounds = np.concatenate([[0], np.cumsum(size[size > 1])])
    return rows, bounds


def anchor_runs(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last suffix of each run that shares its least gram, and that gram's place."""
    n = len(data)
    gram = min(GRAM, depth)
    if n < depth:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - gram + 1)
    least = K.span_hash(prefix, at, at + gram) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | at.astype(np.uint64)
    anchor = (sliding_least(least, depth - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    whole = np.diff(offsets) >= depth
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - depth + 1, -1)
    ok = np.cumsum(inside[:-1]) > 0
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    starts = offsets[:-1][whole]
    begin[starts] = True
    end = ok.copy()
    end[:-1] &= ~ok[1:] | begin[1:]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
    return lo, hi, anchor[lo]


def first_digits(data: np.ndarray, offsets: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, ...]:
    """First and last suffix of each run of anchor_runs(), the hash of its gram, and the hash of its surroundings, for `window` suffixes after the other.

    A run that stands across two windows becomes two; their surroundings differ from those of a whole one, so the last passes decide about them."""
    gram, found = min(GRAM, depth), []
    for at in range(0, max(1, len(data)), window):
        part = data[at : at + window + depth - 1]
        prefix = K.prefix_hash(part)
        lo, hi, anchor = anchor_runs(part, np.clip(offsets - at, 0, len(part)), prefix, depth)
        around = K.span_hash(prefix, lo, hi + depth)
        found.append((lo + at, hi + at, K.span_hash(prefix, anchor, anchor + gram), K.mix(around ^ ((anchor - lo).astype(np.uint64) << np.uint64(32)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def last_digits(data: np.ndarray, at: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both halves of the suffixes at some places, in ascending order, for a window after the other."""
    half = depth // 2
    a, b = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for w in range(0, len(data), window):
        i, j = np.searchsorted(at, [w, w + window])
        if i < j:
            prefix, own = K.prefix_hash(data[w : w + window + depth - 1]), at[i:j] - w
            a[i:j], b[i:j] = K.span_hash(prefix, own, own + half), K.span_hash(prefix, own + half, own + depth)
    return a, b


def united_runs(lo: np.ndarray, span: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the unions of runs [lo, lo + span] that touch or overlap in one document."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(lo[order] + span[order] + 1)
    doc = np.searchsorted(first, lo, side="right") - 1
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], end[np.append(at[1:], len(lo)) - 1] if len(at) else end


def _names(t: pa.Table, offsets: np.ndarray) -> bytes:
    return P.pack(t.column("_id").to_numpy(), t.column("_sum").to_numpy(), offsets[1:])


def _first_pass(docs: DataFrame, depth: int, n_parts: int, window: int) -> DataFrame:
    """FOUND rows: runs of suffixes that repeat for sure, and runs that are still open."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            chunk = numbers.next()
            rows = [P.passing(n_parts, chunk, P.NAMES, _names(t, offsets))]
            lo, hi, gram, around = first_digits(data, offsets, depth, window)
            if len(lo):
                span = (hi - lo).astype(np.uint16)
                order = np.lexsort((lo, around, gram))
                lo, gram, around, span = lo[order], gram[order], around[order], span[order]
                new = np.ones(len(lo), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
                size = np.diff(np.append(np.flatnonzero(new), len(lo)))
                many = np.repeat(size > 1, size)
                rows.append(P.passing(n_parts, chunk, P.HITS, P.pack(lo[many].astype(np.uint32), span[many], np.full(many.sum(), FULL, np.uint8))))
                # of runs that are equal in the chunk, one is sent
                lo, gram, around, span, many = lo[new].astype(np.uint32), gram[new], around[new], span[new], many[new]
                part = (gram % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                rows += P.dealt(n_parts, chunk, part[order], gram[order], around[order], span[order], many[order].astype(np.uint8), lo[order])
            yield P.batch(rows)

    def answer(gram: np.ndarray, around: np.ndarray, span: np.ndarray, many: np.ndarray, lo: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((around, gram))
        g, a = gram[order], around[order]
        new_gram = np.ones(len(g), bool)
        new_gram[1:] = g[1:] != g[:-1]
        new = new_gram.copy()
        new[1:] |= a[1:] != a[:-1]
        b = np.flatnonzero(new)
        size = np.diff(np.append(b, len(g)))
        full = np.repeat((size > 1) | (np.maximum.reduceat(many[order], b) > 0), size)
        at_gram = np.flatnonzero(new_gram)
        kinds = np.add.reduceat(new.astype(np.int64), at_gram)
        several = np.repeat(kinds > 1, np.diff(np.append(at_gram, len(g))))
        state = np.where(full, FULL, 0) | np.where(several & new, OPEN, 0)
        use = state > 0
        return order[use], span[order[use]], state[use].astype(np.uint8)

    def gather(places: np.ndarray, more: list[np.ndarray], names: list[np.ndarray]) -> pa.Table:
        ids, sums, ends = names
        first = np.concatenate([[0], ends])
        lo, span, state = places.astype(np.int64), more[0].astype(np.int64), more[1]
        found = {}
        for kind in (FULL, OPEN):
            of = state & kind > 0
            d, starts, ends_ = united_runs(lo[of], span[of], first)
            found[kind] = (d, np.stack([starts - first[d], ends_ - first[d]], axis=1).ravel().astype(np.int32))
        own = np.unique(np.concatenate([found[FULL][0], found[OPEN][0]]))
        lists = [P.ragged(flat, 2 * np.concatenate([np.searchsorted(d, own), [len(d)]])) for d, flat in (found[FULL], found[OPEN])]
        return pa.Table.from_arrays([pa.array(ids[own]), pa.array(sums[own]), *lists], names=["_id", "_sum", "runs", "open"])

    types = (np.uint64, np.uint64, np.uint16, np.uint8, np.uint32)
    return P.exchange(map_batches(docs, scan, P.SCHEMA), n_parts, types, answer, gather, _NAME_TYPES, FOUND, (np.uint16, np.uint8))


def _last_passes(docs: DataFrame, depth: int, n_parts: int, window: int) -> DataFrame:
    """(_id, _sum, runs) of suffixes in open runs that share all their digits with another. docs: with `open`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            chunk = numbers.next()
            rows = [P.passing(n_parts, chunk, P.NAMES, _names(t, offsets))]
            at = np.flatnonzero(P.marked(t.column("open"), offsets, len(data)))
            if len(at):
                a, b = last_digits(data, at, depth, window)
                members, bounds = equal_groups([a, b])
                rows.append(P.passing(n_parts, chunk, P.HITS, P.pack(at[members].astype(np.uint32))))
                send = np.ones(len(at), bool)
                send[members] = False
                send[members[bounds[:-1]]] = True  # of suffixes that are equal in the chunk, one is sent
                a, b, at = a[send], b[send], at[send].astype(np.uint32)
                part = (K.mix(a ^ b) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                rows += P.dealt(n_parts, chunk, part[order], a[order], b[order].astype(np.uint32), at[order])
            yield P.batch(rows)

    def answer(a: np.ndarray, b: np.ndarray, place: np.ndarray, _: np.ndarray) -> tuple[np.ndarray]:
        return (equal_groups([a, b])[0],)

    def gather(places: np.ndarray, _: list, names: list[np.ndarray]) -> pa.Table:
        ids, sums, ends = names
        first = np.concatenate([[0], ends])
        flag = np.zeros(first[-1], bool)
        flag[places] = True
        return P.runs_by_doc(flag, first, ids, sums)

    return P.exchange(map_batches(docs, scan, P.SCHEMA), n_parts, (np.uint64, np.uint32, np.uint32), answer, gather, _NAME_TYPES, P.RUNS)


def repeats(docs: DataFrame, depth: int = DEPTH, window: int = WINDOW) -> DataFrame:
    """(_id, _sum, runs): runs of suffixes whose first `depth` bytes start elsewhere too. Written to the shared folder."""
    d, n_parts = keyed(docs), buckets(docs)
    first = materialize(_first_pass(d, depth, n_parts, window), "first-digit")
    still = P.united(first, "open")
    last = materialize(_last_passes(d.join(still, ["_id", "_sum"]).sortWithinPartitions("_id", "_sum"), depth, n_parts, window), "last-digits")
    return P.united(first.select("_id", "_sum", "runs").unionByName(last))


def dedup(docs: DataFrame, depth: int = DEPTH, texts: bool = True, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (binary) of each row of docs.

    Each byte that a repeated `depth`-byte string covers goes, wherever else the string starts: first
    occurrences go too. Null texts are empty; matches never cross rows. Rows that repeat are repeats of each other. A null doc_id stays null.
    Columns other than doc_id and text are not read. An empty table gives no rows."""
    d = keyed(docs).join(repeats(docs, depth, window), ["_id", "_sum"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                pieces, at, count = [], 0, 0
                last = -1
                for s, e in sorted(zip(runs[::2], runs[1::2], strict=True)) if runs else ():
                    e += depth - 1
                    if s > last:
                        count += 1
                        pieces.append(raw[at:s])
                    at = last = max(last, e)
                raw_kept = b"".join([*pieces, raw[at:]]) if count else raw
                n.append(len(raw))
                gone.append(len(raw) - len(raw_kept))
                spans.append(count)
                kept.append(raw_kept)
            columns = [batch.column("_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            columns += [pa.array(kept, pa.binary())] if texts else []
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    out = map_batches(d, cut, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
    return out.withColumn("_id", own_id()).withColumnRenamed("_id", "doc_id")


def report(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """dedup() without the bytes."""
    return dedup(docs, depth, texts=False)
