"""Recognition metrics and votes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillframe.functions import blocks

#: Up to so many words a lexicon goes to each task, some 20 MB.
SMALL = 200_000


def cer_micro(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of edits among the true characters, over all pairs (found, truth) of a group."""
    return pairs.groupBy(*keys).agg((100.0 * F.sum(F.levenshtein("found", "truth")) / F.sum(F.greatest(F.lit(1), F.length("truth")))).alias("cer"))


def _texts(column: pd.Series) -> pa.Array:
    return pa.array(column, pa.string(), from_pandas=True)


@F.pandas_udf(DoubleType())
def similarity(found: pd.Series, truth: pd.Series) -> pd.Series:
    """Similarity ratio of two texts by matching blocks of characters; a null is empty, and two empty texts are alike."""
    return pd.Series(blocks.ratios(*blocks.characters(_texts(found)), *blocks.characters(_texts(truth))))


@F.pandas_udf(DoubleType())
def word_similarity(found: pd.Series, truth: pd.Series) -> pd.Series:
    """Similarity ratio of two texts' word lists."""
    a, b = blocks.word_numbers(_texts(found), _texts(truth))
    return pd.Series(blocks.ratios(*a, *b))


def ratio_error_macro(pairs: DataFrame, keys: list[str], strip: bool = False, by_word: bool = False) -> DataFrame:
    """Mean of the pairs' ratio errors: not an error rate by edits, see cer_micro."""
    a, b = (F.trim("found"), F.trim("truth")) if strip else (F.col("found"), F.col("truth"))
    error = 1 - (word_similarity if by_word else similarity)(a, b)
    return pairs.select(*keys, error.alias("e")).groupBy(*keys).agg(F.avg("e").alias("error"))


def mean_percent(lines: DataFrame, keys: list[str], value: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.coalesce(F.avg(value) * 100, F.lit(0.0)).alias("percent"))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "high").when(confidence >= 0.55, "medium").otherwise("low")


def consensus(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The winning text of each line among candidates (text, conf, lm): mean confidence, 0.15 for each further vote and 0.04 lm, weighed by length."""
    g = candidates.groupBy(*keys, "text").agg(F.avg("conf").alias("c"), F.count(F.lit(1)).alias("n"), F.max("lm").alias("lm"))
    weight = F.when(F.length("text") >= 3, 1.0).otherwise(0.5)
    g = g.withColumn("score", (F.col("c") + 0.15 * (F.col("n") - 1) + 0.04 * F.col("lm")) * weight)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "text")  # sums of one score in another order are equal
    return g.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "c", "lm")


def domain(texts: DataFrame, key: str, rules: DataFrame, default: str = "general", least: int = 2, most: int = 10_000) -> DataFrame:
    """key, domain, hits: the domain of most keywords contained in the lower-case text, the first listed of equals; rules: domain, ord, keyword.

    Rules are a list that people write: they go into the plan, and more than `most` of them are an error. Each text is asked in its own row."""
    listed = rules.select("domain", "ord", "keyword").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} rules")
    domains = sorted({(r["ord"], r["domain"]) for r in listed})
    counts = [F.struct(sum((F.contains("_t", F.lit(r["keyword"])).cast("int") for r in listed if r["domain"] == d), F.lit(0)).alias("hits"), F.lit(-o).alias("ord"), F.lit(d).alias("domain")) for o, d in domains]
    best = F.array_max(F.array(*counts)) if counts else F.lit(None).cast("struct<hits:int,ord:int,domain:string>")
    got = F.coalesce("b.hits", F.lit(0)).cast("long")
    d = texts.select(key, F.lower("text").alias("_t")).select(key, best.alias("b"))
    return d.select(key, F.when(got >= least, F.col("b.domain")).otherwise(default).alias("domain"), got.alias("hits"))


def lexicon_counts(rows: DataFrame, words: Column, lexicon: DataFrame, keys: list[str], also: Callable[[Column], Column]) -> DataFrame:
    """rows with n_words and n_valid of the array `words`: those of the lexicon (word: no word twice) in lower case, and those that `also` lets pass. keys: what tells the rows apart.

    A lexicon of up to SMALL words goes to each task, so words are looked up where they stand and only sums of rows move. A larger one is joined:
    Spark splits words that very many rows have. How large it is, is counted first, and it is kept for the join."""
    listed = lexicon.select("word", F.lit(True).alias("_in")).persist()
    if listed.count() <= SMALL:
        listed = F.broadcast(listed)
    w = rows.select(*keys, F.explode(words).alias("_w")).withColumn("_pass", also(F.col("_w"))).withColumn("word", F.lower("_w"))
    d = w.join(listed, "word", "left")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("_in") | F.col("_pass")).alias("n_valid"))
    return rows.join(n, keys, "left").fillna(0, ["n_words", "n_valid"])


def hash_split(rows: DataFrame, key: str, buckets: int = 10, train: int = 9) -> DataFrame:
    """rows with split: train or val by a hash of the key, the same in each run and for each order."""
    return rows.withColumn("split", F.when(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets)) < train, "train").otherwise("val"))


def clamped_split(rows: DataFrame, key: str, share: float = 0.05, least: int = 10, most: int = 500) -> DataFrame:
    """rows with split: the first n by hash are val, n the share of all rows within least and most. Only the n smallest hashes are ordered."""
    hashed = rows.withColumn("_h", F.struct(F.md5(F.col(key).cast("string")), F.col(key)))
    n = max(least, min(most, int(rows.count() * share)))
    val = hashed.orderBy("_h").limit(n).select(key, F.lit("val").alias("split"))
    return rows.join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(F.col("split") == "train").alias("train_samples"), F.count_if(F.col("split") == "val").alias("val_samples"))


def annotation_groups(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, w, h, text of each group of word boxes (x0, y0, x1, y1, pos, text): padded box, words from left to right, the order of the source among equals."""
    g = words.filter(F.trim("text") != "").groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sort_array(F.collect_list(F.struct("x0", "pos", "text"))).alias("p"),
    )
    x, y = F.greatest(F.lit(0), F.floor("x0") - 6), F.greatest(F.lit(0), F.floor("y0") - 4)
    d = g.select(*keys, x.alias("x"), y.alias("y"), (F.ceil("x1") + 6 - x).alias("w"), (F.ceil("y1") + 4 - y).alias("h"), F.array_join(F.transform("p", lambda v: v["text"]), " ").alias("text"))
    return d.filter((F.col("w") >= 24) & (F.col("h") >= 10) & (F.length("text") >= 2) & F.col("text").rlike("[\\p{L}\\p{N}]"))


def pseudo_labels(lines: DataFrame, least_confidence: float = 0.90, limit: int | None = None) -> DataFrame:
    """Lines (text, conf, penalty, w, h, key) good enough to train on; a limit, if wanted, takes the first by key."""
    words = F.size(F.filter(F.split("text", "\\s+"), lambda x: x != ""))
    d = lines.filter((F.col("conf") >= least_confidence) & (F.length("text") >= 8) & (words >= 2) & (F.col("penalty") == 0) & (F.col("w") >= 50) & (F.col("h") >= 14) & (F.col("w") >= 1.2 * F.col("h")))
    return d if limit is None else d.orderBy("key").limit(limit)
