"""Substring dedup by fixed-block anchors.

1. Non-overlapping blocks of 7 words are indexed: each window of 13 words holds
   one whole block, wherever it starts. Every rolling 7-word window of the
   corpus is probed against the index; a hit is a block that stands in another document too.
2. Hits are extended by one word after the other while 13 words hold a hit, to
   the windows that may repeat. Of each such window the smallest doc_id that has it is
   found by its 96-bit fingerprint, and neighbouring repeats join into maximal exact repeats.
3. Words covered by a window that also starts in a smaller doc_id go.

Each step moves packed keys or texts once; the steps end in written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm import kernels as K
from quillframe.llm import packed as P
from quillframe.llm.common import buckets, chunks, keyed, map_batches, materialize, own_id

#: Words of a window; of a block: a window holds a whole block if width >= 2 * block - 1.
WIDTH = 13
#: Bytes of a chunk's texts.
CHUNK = 4 << 20
_NO_PLACE = np.uint32((1 << 30) - 1)
_ALIGNED, _MANY = np.uint32(1 << 31), np.uint32(1 << 30)


def _names(t: pa.Table, first: np.ndarray) -> bytes:
    return P.pack(t.column("_id").to_numpy(), t.column("_sum").to_numpy(), first[1:])


_NAME_TYPES = (np.int64, np.int64, np.int64)


def _anchors(docs: DataFrame, width: int, n_parts: int) -> DataFrame:
    """(_id, _sum, runs) of documents in which a block window hits: runs of the first words of such windows."""
    block = (width + 1) // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            w = K.words(data, offsets, K.SPACE)
            n, chunk = len(w.start), numbers.next()
            rows = [P.passing(n_parts, chunk, P.NAMES, _names(t, w.first))]
            g = K.gram_hash(K.word_hash(data, w), block)
            at = np.flatnonzero(K.gram_starts(w.first, block, n))
            doc = w.doc[at] if len(at) else at
            long_enough = np.diff(w.first)[doc] >= width
            at, doc = at[long_enough], doc[long_enough]
            order = np.argsort(g[at])
            at, doc = at[order], doc[order]
            key = g[at]
            b = K.group_bounds(key)[:-1]
            if len(at):
                aligned = (at - w.first[doc]) % block == 0
                any_aligned = np.logical_or.reduceat(aligned, b)
                many = np.minimum.reduceat(doc, b) != np.maximum.reduceat(doc, b)
                size = np.diff(np.append(b, len(at)))
                known = any_aligned & many
                rows.append(P.passing(n_parts, chunk, P.HITS, P.pack(at[np.repeat(known, size)].astype(np.uint32))))
                flags = np.where(any_aligned, _ALIGNED, np.uint32(0)) | np.where(many, _MANY, np.uint32(0))
                ask = np.repeat(~known, size)  # these places wait for an answer; a known key is sent once, without a place
                first_only = np.zeros(len(at), bool)
                first_only[b] = True
                send = ask | first_only
                place = np.where(ask, at.astype(np.uint32), _NO_PLACE) | np.repeat(flags, size)
                part = ((key[send] >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
                low = key[send].astype(np.uint32)
                order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | low)
                rows += P.dealt(n_parts, chunk, part[order], low[order], place[send][order])
            yield P.batch(rows)

    def answer(key: np.ndarray, place: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray]:
        order = np.argsort(key, kind="stable")
        p, c = place[order], chunk[order]
        bounds = K.group_bounds(key[order])
        b, size = bounds[:-1], np.diff(bounds)
        flags = np.bitwise_or.reduceat(p, b)
        hit = (flags & _ALIGNED > 0) & ((flags & _MANY > 0) | (np.minimum.reduceat(c, b) != np.maximum.reduceat(c, b)))
        found = order[np.repeat(hit, size)]
        found = found[(place[found] & _NO_PLACE) != _NO_PLACE]
        place &= _NO_PLACE
        return (found,)

    def gather(places: np.ndarray, _: list, names: list[np.ndarray]) -> pa.Table:
        ids, sums, ends = names
        first = np.concatenate([[0], ends])
        flag = np.zeros(first[-1], bool)
        flag[places] = True
        return P.runs_by_doc(flag, first, ids, sums)

    return P.exchange(map_batches(docs, probe, P.SCHEMA), n_parts, (np.uint32, np.uint32), answer, gather, _NAME_TYPES, P.RUNS)


def _repeats(docs: DataFrame, width: int, n_parts: int) -> DataFrame:
    """(_id, _sum, runs): first words of windows that also start in a smaller doc_id. docs: with the runs of hits."""
    block = (width + 1) // 2

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            w = K.words(data, offsets, K.SPACE)
            n, chunk, ids = len(w.start), numbers.next(), t.column("_id").to_numpy()
            rows = [P.passing(n_parts, chunk, P.NAMES, _names(t, w.first))]
            h = K.word_hash(data, w)
            hit = P.marked(t.column("runs"), w.first, n)
            near = np.concatenate([[0], np.cumsum(hit)])
            begins = np.flatnonzero(K.gram_starts(w.first, width, n))
            at = begins[near[begins + width - block + 1] > near[begins]]  # the window holds a block window that hits
            a, b = K.gram_hash(h, width)[at], K.gram_hash(h, width, 1)[at].astype(np.uint32)
            doc_id = ids[w.doc[at]] if len(at) else np.zeros(0, np.int64)
            order = np.lexsort((doc_id, b, a))
            at, a, b, doc_id = at[order], a[order], b[order], doc_id[order]
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                least = doc_id[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                later = doc_id > least
                rows.append(P.passing(n_parts, chunk, P.HITS, P.pack(at[later].astype(np.uint32))))
                a, b, doc_id, at = a[~later], b[~later], doc_id[~later], at[~later].astype(np.uint32)
                part = (a % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                rows += P.dealt(n_parts, chunk, part[order], a[order], b[order], doc_id[order], at[order])
            yield P.batch(rows)

    def answer(a: np.ndarray, b: np.ndarray, doc_id: np.ndarray, place: np.ndarray, _: np.ndarray) -> tuple[np.ndarray]:
        order = np.lexsort((doc_id, b, a))
        a, b, i = a[order], b[order], doc_id[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = i[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        return (order[i > least],)

    def gather(places: np.ndarray, _: list, names: list[np.ndarray]) -> pa.Table:
        ids, sums, ends = names
        first = np.concatenate([[0], ends])
        flag = np.zeros(first[-1], bool)
        flag[places] = True
        return P.runs_by_doc(flag, first, ids, sums)

    return P.exchange(map_batches(docs, extend, P.SCHEMA), n_parts, (np.uint64, np.uint32, np.int64, np.uint32), answer, gather, _NAME_TYPES, P.RUNS)


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(_id, _sum, runs) of the documents with words to go: first words of their repeated windows, in runs. Written to the shared folder."""
    d = keyed(docs)
    n_parts = buckets(docs)
    hits = materialize(P.united(_anchors(d, width, n_parts)), "anchors")
    return materialize(P.united(_repeats(d.join(hits, ["_id", "_sum"]).sortWithinPartitions("_id", "_sum"), width, n_parts)), "repeats")


def dedup(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words that stay, joined by a space) of each row of docs.

    Null and empty texts have no words. A null doc_id counts as the largest id and stays null. Rows that repeat an id are one
    document as to whose id is smaller: none of them takes words from another. Windows never cross rows. Columns other than doc_id and text
    are not read. Ties cannot arise: only strictly smaller ids count. An empty table gives no rows."""
    found = repeats(docs, width)
    d = keyed(docs).join(found, ["_id", "_sum"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = text.encode().split()
                n.append(len(words))
                if runs:
                    keep = bytearray(b"\1") * len(words)
                    for s, e in zip(runs[::2], runs[1::2], strict=True):
                        keep[s : e + width - 1] = bytes(e + width - 1 - s)
                    words = list(compress(words, keep))
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [b.column("_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            columns += [pa.array([k.decode() for k in kept], pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    out = map_batches(d, cut, "_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return out.withColumn("_id", own_id()).withColumnRenamed("_id", "doc_id")


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """dedup() without the texts."""
    return dedup(docs, width, texts=False)
