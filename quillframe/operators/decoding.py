"""Decoding of recogniser outputs: greedy as columns, beam search in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arrays import ctc_beams


def ctc_greedy(lines: DataFrame, key: str, blank: int = 0, unknown: int = 1) -> DataFrame:
    """key, ids, confidence from probabilities p (array of steps of class probabilities).

    Best class of each step, the first of equals; repeats and blanks go (a blank between two equals keeps both), unknown
    takes a step and gives nothing. Confidence: mean probability of what is given, 0 if nothing."""
    step = F.transform("p", lambda s: F.struct(F.array_max(s).alias("v"), (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("c")))
    d = lines.select(key, step.alias("s"))
    out = F.filter(
        F.transform("s", lambda x, i: F.struct(x["c"].alias("c"), x["v"].alias("v"), F.when(i > 0, F.get("s", i - 1)["c"]).otherwise(F.lit(-1)).alias("b"))),
        lambda x: (x["c"] != blank) & (x["c"] != unknown) & (x["c"] != x["b"]),
    )
    d = d.select(key, out.alias("o"))
    total = F.aggregate("o", F.lit(0.0), lambda a, x: a + x["v"])
    return d.select(key, F.transform("o", lambda x: x["c"]).alias("ids"), F.when(F.size("o") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.size("o")))).otherwise(0.0).alias("confidence"))


def ctc_beam_search(lines: DataFrame, key: str, width: int = 8, lines_at_once: int = 256) -> DataFrame:
    """key, ids, confidence from log-probabilities p (array of steps of classes). Null or empty tables give no ids. Some lines' beams go on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lines_at_once):
                t = whole.slice(at, lines_at_once)
                tables = [np.array(x, float) if x else np.zeros((0, 1)) for x in t.column("p").to_pylist()]
                out = ctc_beams(tables, width=width)
                yield pa.RecordBatch.from_arrays([t.column(key), pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.float64())], [key, "ids", "confidence"])

    return lines.select(key, "p").mapInArrow(run, f"{key} {dict(lines.dtypes)[key]}, ids array<int>, confidence double")
