"""Filter interaction audit: what each of five filters removes, alone and behind the others, in every order.

1. Scan: texts of a batch are one byte array. Byte classes and their prefix sums give each document's
   words, code points, capitals and symbols; word hashes, sorted in each document and looked at byte by byte where they are
   equal, give its distinct words. A document comes out as one row of some 50 bytes: the mask of the filters it fails, and a digest of its text.
2. The least doc_id of each digest that repeats says which documents the last filter removes, labels
   say which were good or toxic; documents are counted by part and mask.
3. Masks reduce: all 120 orders of a part are one product of 32 counts with a table of which mask falls at which step.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import kernels as K
from quillframe.llm.common import NULL_ID, map_batches, materialize

FILTERS = "ABCDE"
#: A: fewer words. B: distinct words under this percentage of the words. C: capitals over this percentage of the code points.
LEAST_WORDS, DISTINCT, CAPITALS = 200, 50, 2
#: D: a text that has one of these.
SYMBOLS = b"#$%&*|"

_CAPITAL = K.separators((0x41, 0x5A))
_FOLLOWS = K.separators((0x80, 0xBF))  # bytes that go on with a code point
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document are flagged."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_words(data: np.ndarray, w: K.Words) -> np.ndarray:
    """How many different words each document has.

    Words are sorted by document and hash. Neighbours of one hash are compared byte by byte; a document in which two
    different words share a hash is counted by a set of its words."""
    doc, h = w.doc, K.word_hash(data, w)
    order = np.lexsort((h, doc))
    doc, h, start, size = doc[order], h[order], w.start[order], (w.end - w.start)[order]
    alike = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    n_docs = len(w.first) - 1
    out = np.diff(w.first) - np.bincount(doc[alike], minlength=n_docs)
    wrong = size[alike] != size[alike + 1]
    for at in np.array_split(np.flatnonzero(~wrong), max(1, int(size[alike].sum()) >> 22)):
        n = size[alike[at]]
        first = np.concatenate([[0], np.cumsum(n)])
        step = np.arange(first[-1]) - np.repeat(first[:-1], n)
        differ = data[np.repeat(start[alike[at]], n) + step] != data[np.repeat(start[alike[at] + 1], n) + step]
        if differ.any():
            wrong[at] |= np.add.reduceat(differ, first[:-1]) > 0
    for d in np.unique(doc[alike[wrong]]):
        out[d] = len({data[a:b].tobytes() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)})
    return out


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the bits of the first four filters that it fails."""
    w = K.words(data, offsets, K.SPACE)
    n_words = np.diff(w.first)
    points = np.diff(offsets) - _per_doc(_FOLLOWS[data], offsets)
    fails = [n_words < LEAST_WORDS, 100 * distinct_words(data, w) < DISTINCT * n_words, 100 * _per_doc(_CAPITAL[data], offsets) > CAPITALS * points, _per_doc(_SYMBOL[data], offsets) > 0]
    return sum((f.astype(np.int32) << k for k, f in enumerate(fails)), np.zeros(len(n_words), np.int32))


def scan(docs: DataFrame) -> DataFrame:
    """_id, part, digest (16 bytes of the text), mask (bits of the first four filters) of each row."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.texts(b.column("text"))
            view = memoryview(data)
            digests = [hashlib.blake2b(view[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(masks(data, offsets), pa.int32())], ["_id", "part", "digest", "mask"])

    return map_batches(d, run, "_id long, part string, digest binary, mask int")


def marked(docs: DataFrame) -> DataFrame:
    """_id, part and mask with the bit of the last filter: the text stands in a row with a smaller doc_id too."""
    rows = materialize(scan(docs), "audit-scan")
    # written, so that the join can be split where very many rows share a text
    firsts = materialize(rows.groupBy("digest").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "audit-firsts")
    last = F.lit(1 << FILTERS.index("E"))
    return rows.join(firsts, "digest", "left").select("_id", "part", (F.col("mask") + F.when(F.col("_id") > F.col("first"), last).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just these filters, and how many of them are labelled."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = materialize(known.filter("good = 1 or toxic = 1"), "audit-labels")
    rows = materialize(marked(docs), "audit-masks")
    named = rows.filter(F.col("_id") != NULL_ID).join(known, "_id", "left").select("part", "mask", "good", "toxic")
    unnamed = rows.filter(F.col("_id") == NULL_ID).select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return named.union(unnamed).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


class Orders:
    """Every order of the filters: which masks fall at which step."""

    def __init__(self):
        n = len(FILTERS)
        self.orders = ["".join(p) for p in itertools.permutations(FILTERS)]
        place = np.array([[FILTERS.index(c) for c in o] for o in self.orders])
        bit = 1 << place
        before = np.cumsum(bit, axis=1) - bit
        mask = np.arange(1 << n)
        fails, open_ = (mask & bit[..., None]) > 0, (mask & before[..., None]) == 0
        #: order x step x mask
        self.removed, self.redundant, self.kept = fails & open_, fails & ~open_, (mask & (before + bit)[..., None]) == 0
        self.alone = mask == bit[..., None]
        self.place = place

    def report(self, count: np.ndarray) -> dict[str, np.ndarray]:
        """count: mask x (all, good, toxic). Each of the result: order x step."""
        n, good, toxic = count.T
        out = {name: getattr(self, at) @ n for name, at in (("kept", "kept"), ("removed", "removed"), ("redundant", "redundant"), ("unique_fails", "alone"))}
        out |= {"good_lost": self.removed @ good, "toxic_lost": self.removed @ toxic}
        total = np.bincount(self.place.ravel(), weights=None, minlength=len(FILTERS)) * 0
        np.add.at(total, self.place.ravel(), out["removed"].ravel())
        return out | {"shapley": total[self.place]}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are not read. A part is a source; null and empty sources are one
    part. A null text is empty: it fails A alone, and E behind a smaller doc_id with a null or empty text. Rows
    that share a doc_id are documents of their own, and of equal ones none is a copy of the other. A null doc_id is larger than all others
    and has no label. Of a doc_id with several labels, one that says so is enough. An empty table gives no rows."""
    each = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders()
        names = pa.array(np.repeat(orders.orders, len(FILTERS)))
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders.orders)))
        for b in batches:
            for part, own in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                count = np.zeros((1 << len(FILTERS), 3), np.int64)
                for c in own:
                    count[c["mask"]] = c["n"], c["good"], c["toxic"]
                found = orders.report(count)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.string()), names, steps, *[pa.array(found[c].ravel(), pa.int64()) for c in COLUMNS]], ["part", "filter_order", "step", *COLUMNS])

    return each.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))
