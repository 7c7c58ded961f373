"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. One scan turns each text into some twenty statistics (array passes over whole chunks).
2. cos(x W + b) with Gaussian W approximates a Gaussian kernel over them. Each
   partition of the labelled rows sums its normal equations; the sums are added and solved on the
   driver: their size depends on the features alone.
3. Labelled rows that the fit did not see give an isotonic (monotone, stepwise) map from margin to probability.

Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import kernels as K
from quillframe.llm.common import chunks, map_batches, materialize

CHUNK = 3 << 20
#: Labelled rows that are used at most, about; beyond, a hash of the doc_id decides who is in. This bounds the fit, not the scoring.
LABELLED = 40_000
#: Random features, kernel width (standard deviations times root of the statistics), ridge, and every which labelled row calibrates.
FEATURES, WIDTH, RIDGE, CALIBRATE = 256, 1.0, 1e-3, 5
#: Partitions that the labelled rows are summed in: bounds what comes to the driver.
PARTS = 8
SEED = 7

_CLASSES = {"lower": (97, 122), "upper": (65, 90), "digit": (48, 57), "other": (128, 255), "mark": (33, 47), "mark2": (58, 64), "mark3": (91, 96), "mark4": (123, 126)}
_CLASS = np.zeros(256, np.uint8)
for _k, (_a, _b) in enumerate(_CLASSES.values(), 1):
    _CLASS[_a : _b + 1] = min(_k, 5)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[ord("!")] = 7
_CLASS[ord(".")] = 8
_CLASS[ord(",")] = 9
_CLASS[ord("\n")] = 10
_N_CLASSES = 11
NAMES = ("bytes", "words", "lines", *(f"class{k}" for k in range(_N_CLASSES)), "word_bytes", "word_spread", "distinct", "same_as_last", "repeat8", "line_words", "distinct_lines")


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)[:n]


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each document."""
    key = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount(doc[order][new], minlength=n)[:n]


def class_counts(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """How many bytes of each class a text has, counted a block of bytes after the other."""
    n = len(offsets) - 1
    out = np.zeros(n * _N_CLASSES, np.int64)
    for at in range(0, len(data), block):
        part = data[at : at + block]
        doc = np.repeat(np.arange(n), np.diff(np.clip(offsets, at, at + len(part))))
        out += np.bincount(doc * _N_CLASSES + _CLASS[part], minlength=n * _N_CLASSES)
    return out.reshape(n, _N_CLASSES)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text of a chunk, a row each; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    classes = class_counts(data, offsets)
    w = K.words(data, offsets, K.SPACE)
    h, doc = K.word_hash(data, w), w.doc
    n_words = np.diff(w.first)
    some = np.maximum(n_words, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = _per_doc(length, doc, n) / some
    spread = np.sqrt(np.maximum(_per_doc(length**2, doc, n) / some - mean**2, 0))
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    g = K.gram_hash(h, 8)
    ok = np.flatnonzero(K.gram_starts(w.first, 8, len(h)))
    n_grams = np.bincount(doc[ok], minlength=n)[:n]
    repeat8 = 1 - _distinct(g[ok], doc[ok], n) / np.maximum(n_grams, 1)
    repeat8[n_grams == 0] = 0
    lines = K.words(data, offsets, K.separators((10, 10)))
    n_lines = np.diff(lines.first)
    distinct_lines = _distinct(K.word_hash(data, lines), lines.doc, n) / np.maximum(n_lines, 1)
    columns = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), *(np.sqrt(classes / np.maximum(size, 1)[:, None]).T), mean, spread, _distinct(h, doc, n) / some, _per_doc(same, doc, n) / some, repeat8, np.log1p(n_words / np.maximum(n_lines, 1)), distinct_lines]
    return np.stack(columns, axis=1).astype(np.float32)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x of each row of docs. Written to the shared folder: it holds no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK):
            x = statistics(*K.texts(t.column("text")))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield from pa.Table.from_arrays([t.column("doc_id"), values], names=["doc_id", "x"]).to_batches()

    return materialize(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x array<float>"), "statistics")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    coefficients: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.cos(np.clip((x - self.mean) / self.scale, -4, 4) @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.features(x) @ self.coefficients
        return np.clip(np.interp(margin, self.edges, self.levels), 0, 1)


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone least-squares levels by pooling adjacent violators, at the mean margin of each pool."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, y in zip(margin[order], label[order], strict=True):
        pools.append([float(y), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, m2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2] + m2]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _held_out(column):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(x: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Model from labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Labels without an id or a quality are passed over; of several for an id the largest counts. Without any label every score is 0.5."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("in")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = materialize(x.join(known, "doc_id").withColumn("cal", F.pmod(F.xxhash64("doc_id", F.lit("cal")), F.lit(CALIBRATE)) == 0), "labelled", PARTS)
    d = len(NAMES)
    m = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[k]) for k in range(d)], *[F.stddev_pop(F.col("x")[k]) for k in range(d)]).first()
    rng = np.random.default_rng(SEED)
    weights, phase = rng.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, FEATURES)
    mean = np.array([v or 0.0 for v in m[1 : d + 1]])
    scale = np.maximum(np.array([v or 0.0 for v in m[d + 1 :]]), 1e-6)
    model = Model(mean, scale, weights, phase, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    if not m[0]:
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zy = np.zeros((FEATURES + 1,) * 2), np.zeros(FEATURES + 1)
        for b in batches:
            if b.num_rows:
                z = model.features(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64))
                zz += z.T @ z
                zy += z.T @ b.column("y").to_numpy().astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary())], ["zz", "zy"])

    fold = rows.filter(~F.col("cal"))
    sums = map_batches(fold.select("x", "y").coalesce(PARTS), equations, "zz binary, zy binary").collect()
    zz = sum((np.frombuffer(r["zz"]).reshape((FEATURES + 1,) * 2) for r in sums), np.zeros((FEATURES + 1,) * 2))
    zy = sum((np.frombuffer(r["zy"]) for r in sums), np.zeros(FEATURES + 1))
    coefficients = np.linalg.solve(zz + RIDGE * max(1.0, zz[-1, -1]) / FEATURES * np.eye(FEATURES + 1), zy)
    model = Model(mean, scale, weights, phase, coefficients, np.zeros(1), np.full(1, 0.5))
    held = rows.filter("cal").select("x", "y").collect()  # at most bound / CALIBRATE rows
    if not held:
        return Model(mean, scale, weights, phase, coefficients, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    margin = model.features(np.array([r["x"] for r in held], dtype=np.float64)) @ coefficients
    edges, levels = isotonic(margin, np.array([r["y"] for r in held], dtype=np.float64))
    return Model(mean, scale, weights, phase, coefficients, edges, levels)


def score(x: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("x").flatten().to_numpy().reshape(b.num_rows, len(NAMES)).astype(np.float64)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return map_batches(x, run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Null and empty texts are scored by their zeros. A null doc_id stays null and is not held out. Rows that repeat come out as
    often as they come in. Columns of docs other than doc_id and text, of labels other than doc_id and quality, are not read.
    An empty table of documents gives no rows."""
    x = measured(docs)
    return score(x, fit(x, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), bound)).select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
