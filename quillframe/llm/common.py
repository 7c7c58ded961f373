"""What the corpus operators share: reading tables, tables in the shared folder, batching by bytes."""

from __future__ import annotations

import atexit
import itertools
import math
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id orders after all others and never equals one of them.
NULL_ID = (1 << 63) - 1
#: Shuffle files go when the job that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of text that one batch brings to a worker.
BATCH = 8 << 20

_scratch: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Where that is unset, one under /tmp on one machine, as in tests, and one in the warehouse on a cluster, if the warehouse is no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file:///tmp/quillframe-{os.getuid()}"
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", warehouse) is None:
        raise RuntimeError(f"spark.checkpoint.dir is not set, and executors do not share the warehouse at {warehouse}")
    return f"{warehouse.rstrip('/')}/quillframe-{os.getuid()}"


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, frees the shuffle files behind it.

    The folder goes with release() or with the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> list[tuple[SparkSession, str]]:
    """The tables that materialize() has made for this session and that are still there."""
    return [x for x in _scratch if x[0] is spark]


def drop_tables(some: list[tuple[SparkSession, str]]) -> None:
    for item in some:
        spark, path = item
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _scratch.remove(item)


def release(spark: SparkSession) -> None:
    """Delete all tables that materialize() has made for this session; frames that read them end with it."""
    drop_tables(tables(spark))


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _scratch}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for a scan, its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets(df: DataFrame, target: int = 6 << 20, least: int = 24, most: int = 1 << 20) -> int:
    """Into how many buckets packed keys are dealt: follows the size of the input, so that a bucket stays small."""
    return max(least, min(most, math.ceil(estimated_bytes(df) / target)))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(_id, _sum, text, columns): a row's identity is its doc_id and its text, so rows that repeat an id stay apart by text.

    doc_id is nullable and then counts as NULL_ID; a null text counts as empty, and nothing tells it from an empty one."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_sum"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c) for c in columns],
    )


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def whole_row(docs: DataFrame, but: tuple[str, ...] = ()):
    """All columns of docs but some as one struct, so that no name of theirs can clash."""
    kept = [F.col(quoted(c)) for c in docs.columns if c not in but]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("none"))


def own_id(column: str = "_id"):
    return F.when(F.col(column) != F.lit(NULL_ID), F.col(column))


def chunks(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Rows of some batches at a time, so that a chunk's texts have about `limit` bytes. A longer text makes a chunk of its own."""
    held_batches: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at, lengths = 0, pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                held_batches.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held_batches)
                held_batches, size, at = [], 0, i
            size += int(n)
        held_batches.append(batch.slice(at))
    if held_batches and any(b.num_rows for b in held_batches):
        yield pa.Table.from_batches(held_batches)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; rows with a text come in batches of some BATCH bytes of text, a longer text in one of its own."""
    if "text" not in df.columns:
        return df.mapInArrow(f, schema)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b for t in chunks(batches, BATCH) for b in t.to_batches())

    return df.mapInArrow(bounded, schema)


def batched(rows: Iterable, n: int) -> Iterator[list]:
    it = iter(rows)
    while part := list(itertools.islice(it, n)):
        yield part
