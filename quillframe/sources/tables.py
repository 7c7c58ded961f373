"""The test tables and the line frames that are derived from them. Every line is a row (doc_id, pos, text); order is pos, never the partition's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text of each line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def variants(rows: DataFrame) -> DataFrame:
    """Lines with deterministic edits by (doc_id + pos) mod 9, so that each branch of the line operators is met."""
    k = (F.col("doc_id") + F.col("pos")) % 9
    t = F.col("text")
    edited = (
        F.when(k == 0, F.concat(t, F.lit("a-")))
        .when(k == 1, F.concat(F.lit("- "), t))
        .when(k == 2, F.concat(F.lit("1. "), t))
        .when(k == 3, F.concat(t, F.lit(":")))
        .when(k == 4, F.lit(""))
        .when(k == 5, F.concat(F.lower(F.substring(t, 1, 1)), F.expr("substring(text, 2)")))
        .when(k == 6, F.concat(t, F.lit(" of")))
        .when(k == 7, F.concat(F.lit("x = y + "), t))
        .otherwise(F.regexp_replace(t, "\\.+$", ""))
    )
    return rows.withColumn("text", edited)


def words(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with word and its place k, from the letter and digit runs of lower-case text."""
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), 0)).alias("k", "word"))
