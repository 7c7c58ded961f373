"""Benchmark decontamination: an FM-index over each shard of the corpus is searched for the benchmark's phrases.

A shard is some documents of one scan task. Backward search through wavelet
ranks finds the suffixes that start with a phrase, sampled suffix positions
locate them, and the words of all occurrences merge into removal spans. The
corpus is read once and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm import kernels as K
from quillframe.llm.common import chunks, map_batches, whole_row
from quillframe.llm.fm_index import FMIndex

#: Bytes of a shard's texts.
SHARD = 2 << 20
#: Bytes of benchmark texts that are sent to the executors at once; a larger benchmark is searched in blocks.
BLOCK = 8 << 20


@dataclass
class Phrases:
    """Distinct windows of a block of benchmark items, as symbols 1.. of a sorted vocabulary of word hashes."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owner_first: np.ndarray
    owners: np.ndarray
    names: list[str]


def phrases(items: list[tuple[object, str | None]], width: int, unnamed: bool = False) -> Phrases:
    """Windows of `width` words of each item; an item of fewer words is one window. Items without words have none; those without an id have some if unnamed, which nobody owns."""
    rows: dict[tuple[int, ...], set[int]] = {}
    names = sorted({str(i) for i, _ in items if i is not None})
    number = {x: k for k, x in enumerate(names)}
    for item, text in items:
        if (item is None and not unnamed) or not text:
            continue
        data, offsets = K.texts(pa.array([text], pa.large_string()))
        data = K.fold(data)
        h = K.word_hash(data, K.words(data, offsets, K.NOT_ALNUM)).tolist()
        for k in range(max(1, len(h) - width + 1) if h else 0):
            owners = rows.setdefault(tuple(h[k : k + width]), set())
            if item is not None:
                owners.add(number[str(item)])
    vocabulary = np.array(sorted({x for row in rows for x in row}), dtype=np.uint64)
    lengths = np.array([len(row) for row in rows], dtype=np.int64)
    windows = np.zeros((len(rows), width), dtype=np.int64)
    for k, row in enumerate(rows):
        windows[k, : len(row)] = np.searchsorted(vocabulary, np.array(row, dtype=np.uint64)) + 1
    owned = [sorted(s) for s in rows.values()]
    owner_first = np.concatenate([[0], np.cumsum([len(s) for s in owned])]).astype(np.int64)
    return Phrases(vocabulary, windows, lengths, owner_first, np.array([x for s in owned for x in s], dtype=np.int64), names)


def search(data: np.ndarray, offsets: np.ndarray, p: Phrases) -> tuple[K.Words, np.ndarray, list[np.ndarray]]:
    """Words of the shard, which of them are hit, and the items (numbers) that each document holds."""
    w = K.words(data, offsets, K.NOT_ALNUM)
    n_docs, n = len(offsets) - 1, len(w.start)
    none = [np.zeros(0, np.int64)] * n_docs
    if not n or not len(p.windows):
        return w, np.zeros(n, bool), none
    h = K.word_hash(data, w)
    at = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    known = np.where(p.vocabulary[at] == h, at + 1, 0)
    doc = w.doc
    symbols = np.zeros(n + n_docs, dtype=np.int64)  # a 0 ends each document
    symbols[np.arange(n) + doc] = known
    index = FMIndex(symbols, len(p.vocabulary))
    lo, hi = index.search(p.windows, p.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return w, np.zeros(n, bool), none
    many = hi[found] - lo[found]
    which = np.repeat(found, many)
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[which]
    place = index.locate(rows)
    doc_of = np.zeros(n + n_docs, dtype=np.int64)
    doc_of[np.arange(n) + doc] = doc
    d = doc_of[place]
    start = place - d
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + p.lengths[which], -1)
    hit = np.cumsum(edge[:n]) > 0
    pairs = np.unique(d * len(p.windows) + which)
    pd, pw = pairs // len(p.windows), pairs % len(p.windows)
    n_own = p.owner_first[pw + 1] - p.owner_first[pw]
    own = p.owners[np.arange(n_own.sum()) - np.repeat(np.cumsum(n_own) - n_own, n_own) + np.repeat(p.owner_first[pw], n_own)]
    n_names = max(1, len(p.names))
    both = np.unique(np.repeat(pd, n_own) * n_names + own)
    bounds = np.searchsorted(both // n_names, np.arange(n_docs + 1))
    return w, hit, [both[bounds[k] : bounds[k + 1]] % n_names for k in range(n_docs)]


_FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "runs": T.ArrayType(T.LongType()), "spans": T.ArrayType(T.LongType()), "items": T.ArrayType(T.StringType())}


def _ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _without(column: pa.ChunkedArray, spans: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts without their byte spans; nulls stay."""
    texts = column.to_pylist()
    for k in np.flatnonzero(np.diff(bounds)):
        raw, at, kept = texts[k].encode(), 0, []
        for a, b in spans[bounds[k] : bounds[k + 1]].reshape(-1, 2):
            kept.append(raw[at:a])
            at = b
        texts[k] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(texts, pa.string())


def _scan(docs: DataFrame, p: Phrases, cut: bool = False) -> DataFrame:
    """docs (row, text) with what a block's phrases hit, added to what earlier blocks hit (columns `_runs` and `_items`, if there); or with cut, docs without it."""
    fields = [f for f in docs.schema.fields if f.name not in ("_runs", "_items")]
    names = [f.name for f in fields]
    again = "_runs" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, SHARD):
            data, offsets = K.texts(t.column("text"))
            w, hit, found = search(K.fold(data), offsets, p)
            items = [[p.names[i] for i in x] for x in found]
            if again:
                earlier = t.column("_runs").to_pylist()
                for d, (flat, more) in enumerate(zip(earlier, t.column("_items").to_pylist(), strict=True)):
                    for a, b in zip(flat[::2], flat[1::2], strict=True):
                        hit[w.first[d] + a : w.first[d] + b] = True
                    items[d] = sorted({*items[d], *more})
            starts, ends = K.runs(hit, w.first)
            doc = np.searchsorted(w.first, starts, side="right") - 1
            bounds = 2 * np.searchsorted(doc, np.arange(len(offsets)))
            runs = np.stack([starts - w.first[doc], ends - w.first[doc]], axis=1).ravel()
            spans = np.stack([w.start[starts] - offsets[doc], w.end[ends - 1] - offsets[doc]], axis=1).ravel() if len(starts) else runs
            if cut:
                out = [_without(t.column(n), spans, bounds) if n == "text" else t.column(n) for n in names]
                yield from pa.Table.from_arrays(out, names=names).to_batches()
                continue
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first])
            out = [*(t.column(n) for n in names), pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), _ragged(runs, bounds), _ragged(spans, bounds), pa.array(items, pa.list_(pa.string()))]
            yield from pa.Table.from_arrays(out, names=[*names, *_FOUND]).to_batches()

    schema = T.StructType([*fields, *([] if cut else [T.StructField(k, v) for k, v in _FOUND.items()])])
    return map_batches(docs.select(*names, *(["_runs", "_items"] if again else [])), run, schema)


def _blocks(benchmark: DataFrame, block: int) -> list[DataFrame]:
    """The benchmark in blocks of about `block` bytes of text; the size is counted first."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block))
    return [benchmark.filter(F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK, cut: bool = False, unnamed: bool = False) -> DataFrame:
    """row (the columns of docs but the text, as a struct), text, and n_words, n_hit, runs (word places), spans (byte places; start and end in turn) and items of the whole benchmark; or with cut, row and the text without the spans.

    The benchmark (item_id, text) is the stated
    query set: its texts go to the executors in blocks of about `block` bytes, one scan of docs
    for each; a scan adds to what the last found.
    Null and empty texts have no words. Items without words are passed over, those without an id too unless unnamed: then
    their windows count as hits and go into the spans, and only `items` leaves them out. Items that share an id count once. Rows that repeat are each their own.
    Other columns of docs may have any names. An empty table of documents gives no rows, an empty benchmark no hits."""
    out, parts = docs.select(whole_row(docs, ("text",)).alias("row"), "text"), _blocks(benchmark.select("item_id", "text"), block)
    for k, part in enumerate(parts):
        if k:
            out = out.drop("n_words", "n_hit", "spans").withColumnsRenamed({"runs": "_runs", "items": "_items"})
        out = _scan(out, phrases([(r[0], r[1]) for r in part.collect()], width, unnamed), cut and part is parts[-1])
    return out


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK, unnamed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs; a null doc_id stays null."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, width, block, unnamed=unnamed)
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK, unnamed: bool = False) -> DataFrame:
    """docs without the benchmark's passages: each removal span, first to last hit word, goes from the text; no row goes.

    Returns the columns of docs; n_chars, if there, follows the text. Texts without a hit stay as they are, nulls too."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return find(docs, benchmark, width, block, cut=True, unnamed=unnamed).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
