"""Outside services asked from tasks: retries with pauses, one rate for all tasks, keys that make a call safe to repeat, statuses as a column, and answers kept by content."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import json_found, strip
from quillframe.operators.plugins import request_chunks, resolved, study_kit_fallback

#: Calls for a request, seconds of the first pause, and words of a refusal that say that the quota is used up.
TRIES, PAUSE = 2, 2.5
SPENT = ("free-models-per-day", "daily", "credits")
CORRECTIONS = "corrections array<struct<line_index:int,line:int,corrected_text:string,corrected:string>>"
KIT = "flashcards array<struct<question:string,answer:string>>"
RESULT = "key string, status string, reply string, attempts int, waited double"


@dataclass(frozen=True)
class Reply:
    """code as HTTP has it; wait: the seconds that the service asks for."""

    code: int
    text: str = ""
    wait: float | None = None


class Service(Protocol):
    """Made once for each task. The same key always comes with the same request, so a service can pass over a call that it has answered."""

    def ask(self, request: str, key: str) -> Reply: ...


def asked(service: Service, request: str, key: str, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None, int, float]:
    """status, reply, attempts and seconds waited of one request.

    success; limited: refused as too often each time, with a pause, longer each time or as long as the service asks, behind each; quota_exhausted: refused for good;
    failed: any other code, or an error; empty: a blank request is not sent."""
    if not request.strip():
        return "empty", None, 0, 0.0
    waited = 0.0
    for attempt in range(1, tries + 1):
        try:
            reply = service.ask(request, key)
        except Exception as e:  # whatever a service's client raises is that row's status, not the job's end
            return "failed", f"{type(e).__name__}: {e}", attempt, waited
        if reply.code == 200:
            return "success", reply.text, attempt, waited
        if reply.code != 429:
            return "failed", reply.text, attempt, waited
        if any(x in reply.text for x in SPENT):
            return "quota_exhausted", reply.text, attempt, waited
        rest = max(pause * attempt, reply.wait or 0.0)
        sleep(rest)
        waited += rest
    return "limited", reply.text, tries, waited


def called(requests: DataFrame, make: Callable[[], Service], tries: int = TRIES, pause: float = PAUSE, tasks: int = 8, rate: float | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, status, reply, attempts, waited of requests (key, request; a null one is blank); see asked().

    tasks calls go on at a time; rate: calls a second of all of them together, so each keeps a gap of tasks / rate between its own. Once the quota is used up a task sends nothing more.
    A task that runs again sends the same keys again."""
    gap = tasks / rate if rate else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, spent, free_at = make(), False, 0.0
        for b in batches:
            rows = []
            for key, request in zip(b.column("key").to_pylist(), b.column("request").to_pylist(), strict=True):
                if spent:
                    rows.append((key, "quota_exhausted", None, 0, 0.0))
                    continue
                if gap and request and request.strip():
                    now = time.monotonic()
                    sleep(max(0.0, free_at - now))
                    free_at = max(now, free_at) + gap
                rows.append((key, *asked(service, request or "", key, tries, pause, sleep)))
                spent = rows[-1][1] == "quota_exhausted"
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "status", "reply", "attempts", "waited"])

    return requests.select("key", "request").repartition(tasks, "key").mapInArrow(run, RESULT)


def answered(requests: DataFrame, store: str, make: Callable[[], Service], **how) -> DataFrame:
    """requests (with request) with status, reply and from_store. Requests of one content are one call, and none is sent whose answer is in `store`, a folder all executors see.

    Each run's answers are written to the store before they are used, so nothing is sent twice for being read twice; only successes count in later runs. how: see called()."""
    spark = requests.sparkSession
    with_key = requests.withColumn("_key", F.sha2(F.coalesce("request", F.lit("")), 256))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    every = spark.read.schema(RESULT).parquet(f"{store}/*") if there else spark.createDataFrame([], RESULT)
    known = every.filter("status = 'success'").groupBy("key").agg(F.min("reply").alias("reply"))
    new = with_key.select(F.col("_key").alias("key"), "request").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    run = f"{store}/{uuid.uuid4().hex}"
    called(new, make, **how).write.parquet(run)
    fresh = spark.read.schema(RESULT).parquet(run).select("key", "status", "reply", F.lit(False).alias("from_store"))
    both = known.select("key", F.lit("success").alias("status"), "reply", F.lit(True).alias("from_store")).join(fresh.select("key"), "key", "left_anti").unionByName(fresh)
    return with_key.join(both.withColumnRenamed("key", "_key"), "_key").drop("_key")


def chunk_requests(lines: DataFrame, group: str, order: str, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """lines with chunk and place, and group, chunk, request: the numbered lines of each chunk, one call's content."""
    chunks = request_chunks(lines, group, order, size)
    numbered = F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(order).alias("at"), "text"))), lambda x: F.concat(F.lit("[Line "), x["at"].cast("string"), F.lit("]: "), strip(F.coalesce(x["text"], F.lit("")))))
    return chunks, chunks.groupBy(group, "chunk").agg(F.array_join(numbered, "\n").alias("request"))


def corrected(lines: DataFrame, first: DataFrame, results: DataFrame, chunks: DataFrame, group: str = "page_id", order: str = "line_index") -> DataFrame:
    """group, order, corrected_text, changed, confidence, mode, status of lines (group, order, text, confidence).

    first: what the heuristic pass made of each line (group, order, corrected_text, changed, confidence); chunks and results: what a service was sent of that and its
    answers (see chunk_requests; group, chunk, status, reply). Where all of a page's calls went well (or were passed over as too many) its corrections hold: changed is against the line as it was
    read, and raises the confidence by 0.12 to 0.98; mode is hybrid. Else the heuristic's lines stay: status is fallback_success if a call failed, success if the quota was used up.
    A reply without JSON corrects nothing."""
    reply = json_found(F.coalesce("reply", F.lit("")), CORRECTIONS)
    found = results.filter("status = 'success'").select(group, "chunk", F.posexplode(reply["corrections"]).alias("pos", "c"))
    text = F.coalesce(F.when(strip(F.col("c.corrected_text")) != "", F.col("c.corrected_text")), F.when(strip(F.col("c.corrected")) != "", F.col("c.corrected")))
    found = found.select(group, "chunk", "pos", F.coalesce("c.line_index", "c.line").alias("raw"), text.alias("corrected_text")).filter("corrected_text is not null")
    fixes = resolved(found, chunks.withColumn("line_index", F.col(order)), [group, "chunk"]).select(group, F.col("line_index").alias(order), F.col("corrected_text").alias("_fix"))
    pages = results.groupBy(group).agg(F.max((F.col("status") == "failed").cast("int")).alias("_failed"), F.max((F.col("status") == "quota_exhausted").cast("int")).alias("_spent"))
    d = lines.select(group, order, "text", F.col("confidence").alias("_raw")).join(first, [group, order]).join(pages, group, "left").join(fixes, [group, order], "left")
    hybrid = (F.col("_failed") == 0) & (F.col("_spent") == 0)
    new = F.coalesce("_fix", "corrected_text")
    differs = F.lower(strip(new)) != F.lower(strip(F.col("text")))
    return d.select(
        group, order,
        F.when(hybrid, new).otherwise(F.col("corrected_text")).alias("corrected_text"),
        F.when(hybrid, differs).otherwise(F.col("changed")).alias("changed"),
        F.when(hybrid & differs, F.least(F.lit(0.98), F.col("confidence") + 0.12)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hybrid, "hybrid").otherwise("heuristic").alias("mode"),
        F.when(F.coalesce(F.col("_failed"), F.lit(0)) == 1, "fallback_success").otherwise("success").alias("status"),
    )


def page_statuses(pages: DataFrame, corrected_lines: DataFrame, group: str = "page_id") -> DataFrame:
    """group, status, total_lines, corrected_count of pages (group; one row each); a page without lines is empty."""
    n = corrected_lines.groupBy(group).agg(F.first("status").alias("status"), F.count(F.lit(1)).alias("total_lines"), F.count_if("changed").alias("corrected_count"))
    return pages.select(group).join(n, group, "left").select(group, F.coalesce("status", F.lit("empty")).alias("status"), F.coalesce("total_lines", F.lit(0)).alias("total_lines"), F.coalesce("corrected_count", F.lit(0)).alias("corrected_count"))


def _whole(lines: DataFrame, group: str, order: str) -> DataFrame:
    """group, request: a document's lines as one text."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return lines.groupBy(group).agg(F.array_join(parts, "\n").alias("request"))


def guides(lines: DataFrame, store: str, make: Callable[[], Service], group: str = "doc_id", order: str = "pos", **how) -> DataFrame:
    """group, guide: what a service writes of each document, kept by its text; documents that it does not answer or answers blank have no row. exports.guide_export() takes it from there."""
    out = answered(_whole(lines, group, order), store, make, **how).filter("status = 'success'")
    return out.select(group, strip(F.regexp_replace("reply", "^\\s*```(?:markdown)?|```\\s*$", "")).alias("guide")).filter("guide <> ''")


def study_kits(lines: DataFrame, store: str, make: Callable[[], Service], group: str = "doc_id", order: str = "pos", **how) -> DataFrame:
    """group, question, answer, made_by: the flashcards that a service writes of each document's text, kept by that text; the stand-in's card where it does not answer or writes none."""
    out = answered(_whole(lines, group, order), store, make, **how)
    cards = F.filter(json_found(F.coalesce("reply", F.lit("")), KIT)["flashcards"], lambda c: (c["question"] != "") & (c["answer"] != ""))
    written = out.filter("status = 'success'").select(group, F.explode(cards).alias("c")).select(group, "c.question", "c.answer", F.lit("service").alias("made_by"))
    left = study_kit_fallback(lines, group, order).join(written.select(group).distinct(), group, "left_anti")
    return written.unionByName(left.select(group, "question", "answer", F.lit("stand-in").alias("made_by")))
