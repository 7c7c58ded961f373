"""The two stateful writes of the document model as streams: counts of corrections per user, and replaced children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillframe.sources.files import replace_partitions


def running_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """user_id, a, b, window, n: pair counts by day with a watermark, so that state of past days goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def replace_children_stream(lines: DataFrame, path: str, parent: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the lines of its pages; a batch that runs again writes the same."""
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: replace_partitions(df, path, parent)).start()
