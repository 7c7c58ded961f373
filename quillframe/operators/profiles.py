"""Per-user learned state as rows: corrections, substitution counts, penalties, vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import blocks
from quillframe.functions.text import strip, user_id


def substitutions(corrections: DataFrame) -> DataFrame:
    """user_id, at, a, b of each one-to-one exchange between original and corrected; at: the correction's place in time.

    Matching blocks of a batch of texts are found at once; an exchange is a gap of one character on both sides between two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            (x, first_x), (y, first_y) = blocks.characters(t.column("x")), blocks.characters(t.column("y"))
            pair, i, j, n = blocks.matching_blocks(x, first_x, y, first_y)
            # the ends of each pair's texts close its last gap
            every = np.arange(t.num_rows)
            by = np.argsort(np.concatenate([pair, every]), kind="stable")
            pair, i, j, n = (np.concatenate(c)[by] for c in ((pair, every), (i, np.diff(first_x)), (j, np.diff(first_y)), (n, np.zeros(t.num_rows, np.int64))))
            same = np.diff(pair, prepend=-1) == 0
            end_i, end_j = (np.where(same, np.concatenate([[0], (k + n)[:-1]]), 0) for k in (i, j))
            at = np.flatnonzero((i - end_i == 1) & (j - end_j == 1))
            a, b = (pa.array([chr(c) for c in s[f[pair[at]] + e[at]]], pa.string()) for s, f, e in ((x, first_x, end_i), (y, first_y, end_j)))
            own = pa.array(pair[at])
            yield pa.RecordBatch.from_arrays([t.column("user_id").take(own), t.column("at").take(own), a, b], ["user_id", "at", "a", "b"])

    asked = corrections.select("user_id", F.col("at").cast("long").alias("at"), strip(F.lower("original")).alias("x"), strip(F.lower("corrected")).alias("y")).filter("x <> y and x <> '' and y <> ''")
    return asked.mapInArrow(run, "user_id string, at long, a string, b string")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """user_id, a, b, n, first: how often each pair was exchanged, and when first."""
    return pairs.groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def top_pairs(counts: DataFrame, top: int = 6) -> DataFrame:
    """The `top` pairs of each user by count; the one learned first of equals."""
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "first", "a", "b")
    return counts.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= top)


def stats(corrections: DataFrame, counts: DataFrame) -> DataFrame:
    """user_id, total_corrections, n_pairs, vocabulary_size: totals count corrections that taught no pair too."""
    y = strip(F.lower("corrected"))
    word = F.when((strip(F.lower("original")) != y) & y.rlike("^\\p{L}{3,}$"), y)
    own = corrections.groupBy("user_id").agg(F.count_if(strip(F.lower("original")) != y).alias("total_corrections"), F.count_distinct(word).alias("vocabulary_size"))
    pairs = counts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return own.join(pairs, "user_id", "left").fillna(0, ["n_pairs"])


def vocabulary(corrections: DataFrame) -> DataFrame:
    y = strip(F.lower("corrected"))
    return corrections.filter((strip(F.lower("original")) != y) & y.rlike("^\\p{L}{3,}$")).groupBy("user_id").agg(F.array_sort(F.collect_set(y)).alias("custom_vocabulary"))


def penalties(counts: DataFrame) -> DataFrame:
    """user_id, a, b, cost of each learned pair in both directions; where both were learned, the one learned last decides."""
    cost = F.greatest(F.lit(0.04), 0.20 - F.least(F.lit(0.16), 0.04 * F.col("n")))
    both = counts.select("user_id", "a", "b", cost.alias("cost"), "first").unionByName(counts.select("user_id", F.col("b").alias("a"), F.col("a").alias("b"), cost.alias("cost"), "first"))
    return both.groupBy("user_id", "a", "b").agg(F.max_by("cost", F.struct("first", -F.col("cost"))).alias("cost"))


def created(names: DataFrame) -> DataFrame:
    """New profiles of display names; names that make one id make one profile."""
    return names.select(user_id(F.col("display_name")).alias("user_id"), "display_name").groupBy("user_id").agg(F.min("display_name").alias("display_name")).withColumn("total_corrections", F.lit(0))


def listed(profiles: DataFrame) -> DataFrame:
    """The default profile first, then by display name."""
    return profiles.orderBy(F.col("user_id") != "default", F.lower("display_name"), "user_id")


def reset(state: DataFrame, users: DataFrame) -> DataFrame:
    return state.join(users.select("user_id"), "user_id", "left_anti")
