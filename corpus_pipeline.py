"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, mixing of sources.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
`documents`; the last returns what the mix takes of each document. run() writes
each stage as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import common, decontaminate, jaccard_join, line_dedup, mixing, quality_rules

#: Tables that an earlier stage of a session made for itself; they go when the next stage starts and does not read them.
_made: list[tuple[SparkSession, str]] = []


def _stage(f):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        common.drop_tables([x for x in _made if x[0] is spark and not any(x[1].rpartition("/")[2] in path for path in read)])
        _made[:] = [x for x in _made if x in common.tables(spark) or x[0] is not spark]
        before = common.tables(spark)
        out = f(spark, docs, sf_dir)
        _made.extend(x for x in common.tables(spark) if x not in before)
        return out

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; the rest stay as they are."""
    return quality_rules.keep_good(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a word that are alike to an earlier one go from the texts; no document goes."""
    return line_dedup.clean(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.75) the smallest doc_id stays."""
    return jaccard_join.keep_first(docs, 5, 75)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten and more words of the benchmark, of items without an id too, go from the texts; no document goes."""
    return decontaminate.remove(docs, common.read(spark, sf_dir, "benchmark"), 10, unnamed=True)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mixture),
]

#: SQL cannot cut spans out of texts as the fourth stage does; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the last one's rows."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
