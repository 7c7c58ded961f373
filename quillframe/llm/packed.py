"""Packed exchange of keys between chunks of documents.

A map task handles its documents in chunks. For each chunk it sends every
bucket of keys one row with a blob of arrays (a sorted key part, a place in the
chunk), which takes about 5 to 8 bytes a key instead of a row each. Each chunk sends a
key once at most when it needs no answer, so a key that stands everywhere costs
a bucket no more than one record for each chunk. A bucket's task sees all records of its keys
and answers with places; a last exchange by chunk turns places into document ids.

Rows: part (the bucket), chunk, kind, blob. Rows of kind HITS and NAMES pass
the buckets unchanged; they are dealt over tasks by their chunk.

A chunk's number comes from its task and its turn in it. A task that runs again after a lost executor must
see the same rows in the same order: inputs are scans, or joins whose rows are sorted by what tells them apart (a join
alone may be of another kind, or fetch its rows in another order, when it runs again).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.kernels import planes, unplanes

SCHEMA = "part int, chunk long, kind int, blob binary"
KEYS, HITS, NAMES = 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes; unpack() with their types gives them back."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(map(planes, arrays))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for t in dtypes:
        size = n * np.dtype(t).itemsize
        out.append(unplanes(blob[at : at + size], t))
        at += size
    return out


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, chunk, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "chunk", "kind", "blob"])


class Numbers:
    """Numbers for the chunks of this task."""

    def __init__(self):
        self.at = (TaskContext.get().partitionId() << 24) - 1

    def next(self) -> int:
        self.at += 1
        return self.at


def dealt(n_parts: int, chunk: int, part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """A row for each bucket that has keys; part is sorted and goes with the arrays."""
    bounds = np.searchsorted(part, np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), chunk, KEYS, pack(*(a[bounds[p] : bounds[p + 1]] for a in arrays))


def passing(n_parts: int, chunk: int, kind: int, blob: bytes) -> tuple[int, int, int, bytes]:
    return n_parts + chunk % n_parts, chunk, kind, blob


def exchange(
    mapped: DataFrame,
    n_parts: int,
    dtypes: tuple,
    answer: Callable[..., np.ndarray],
    per_chunk: Callable[[int, np.ndarray, list[np.ndarray]], pa.Table],
    names: tuple,
    schema: str,
    answers: tuple = (),
) -> DataFrame:
    """Rows of `mapped` (SCHEMA) through their buckets and back to their chunks. A table without rows gives none; chunks of null or empty texts send their names alone.

    answer(arrays..., chunk index) -> (record numbers, and if `answers` names types, what goes with each).

    A record's last array is its place in its chunk. per_chunk(places, extras, names) makes the rows of a
    chunk from the places that the buckets and the chunk itself found (kind HITS: places, extras)."""
    kinds = (np.uint32, *answers)

    def bucket(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        rest = t.filter(pa.array(kind != KEYS)).select(["chunk", "kind", "blob"])
        mine = np.flatnonzero(kind == KEYS)
        if not len(mine):
            return rest
        t = t.take(pa.array(mine))
        chunk = t.column("chunk").to_numpy()
        parts = [unpack(b.as_buffer().to_pybytes(), *dtypes) for b in t.column("blob")]
        which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        arrays = [np.concatenate([p[k] for p in parts]) for k in range(len(dtypes))]
        del parts
        found, *more = answer(*arrays, which)
        order = np.argsort(which[found], kind="stable")
        found, more = found[order], [m[order] for m in more]
        bounds = np.searchsorted(which[found], np.arange(len(chunk) + 1))
        full = np.flatnonzero(np.diff(bounds))
        blobs = [pack(arrays[-1][found[bounds[k] : bounds[k + 1]]], *(m[bounds[k] : bounds[k + 1]] for m in more)) for k in full]
        out = pa.Table.from_arrays([pa.array(chunk[full], pa.int64()), pa.array(np.full(len(full), HITS, np.int32)), pa.array(blobs, pa.binary())], names=["chunk", "kind", "blob"])
        return pa.concat_tables([rest.cast(out.schema), out])

    def gather(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        blobs = t.column("blob")
        hits = [unpack(blobs[int(k)].as_buffer().to_pybytes(), *kinds) for k in np.flatnonzero(kind == HITS)]
        arrays = [np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, d) for k, d in enumerate(kinds)]
        about = unpack(blobs[int(np.flatnonzero(kind == NAMES)[0])].as_buffer().to_pybytes(), *names)
        return per_chunk(arrays[0], arrays[1:], about)

    return mapped.groupBy("part").applyInArrow(bucket, "chunk long, kind int, blob binary").groupBy("chunk").applyInArrow(gather, schema)


def ragged(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind or pa.int32()))


def runs_by_doc(flag: np.ndarray, first: np.ndarray, docs: np.ndarray, sums: np.ndarray) -> pa.Table:
    """(_id, _sum, runs) of documents with a flagged place; runs: start and end in turn, counted in the document."""
    from quillframe.llm.kernels import runs

    starts, ends = runs(flag, first)
    d = np.searchsorted(first, starts, side="right") - 1
    flat = np.stack([starts - first[d], ends - first[d]], axis=1).ravel().astype(np.int32)
    own = np.unique(d)
    bounds = 2 * np.concatenate([np.searchsorted(d, own), [len(d)]])
    return pa.Table.from_arrays([pa.array(docs[own]), pa.array(sums[own]), ragged(flat, bounds)], names=["_id", "_sum", "runs"])


def united(found: DataFrame, column: str = "runs") -> DataFrame:
    """_id, _sum and the runs of rows that repeat, each run once: a document's runs are in one row, however many rows it has."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(column) - 1, F.lit(2)), lambda i: F.struct(F.get(column, i).alias("s"), F.get(column, i + 1).alias("e")))
    each = found.filter(F.size(column) > 0).select("_id", "_sum", F.explode(pairs).alias("p")).distinct()
    return each.groupBy("_id", "_sum").agg(F.flatten(F.collect_list(F.array("p.s", "p.e"))).alias(column))


RUNS = "_id long, _sum long, runs array<int>"


def marked(runs: pa.ChunkedArray, first: np.ndarray, total: int) -> np.ndarray:
    """The flags of which runs_by_doc made the runs, for the documents of another chunk."""
    runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
    n = np.diff(runs.offsets.to_numpy()) if not runs.null_count else np.array([0 if r is None else len(r) for r in runs.to_pylist()])
    flat = runs.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
    doc = np.repeat(np.arange(len(n)), n // 2)
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, flat[:, 0] + first[doc], 1)
    np.add.at(edge, np.minimum(flat[:, 1] + first[doc], total), -1)
    return np.cumsum(edge, out=edge)[:total] > 0
