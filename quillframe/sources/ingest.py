"""Uploads written file by file in two phases, and the status of each document as a stream.

A file comes as rows of some bytes each, so no task holds one whole. A task writes what it gets to a staging folder of the job, counts as it writes, and
drops what grows too large. Only when all tasks are done are files moved to their place; if one fails, the staging folder goes, and with it what lost
tasks left behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillframe.functions.text import file_name
from quillframe.sources.files import CAP, EXTENSIONS

#: Bytes of a row.
PART = 64 * 1024
PARTS = "document_id string, name string, part int, bytes binary"
MANIFEST = "document_id string, path string, size long, status string, reason string"


def parts(files: DataFrame, size: int = PART) -> DataFrame:
    """document_id, name, part, bytes of files (document_id, name, content): each content cut into rows, an empty one into one."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / size)).cast("int")
    cut = files.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("document_id", "name", "part", F.expr(f"substring(content, part * {size} + 1, {size})").alias("bytes"))


@dataclass
class Written(WriterCommitMessage):
    #: document, staged file, final name, size
    files: list[tuple[str, str, str, int]] = field(default_factory=list)
    #: document, name, reason
    refused: list[tuple[str, str, str]] = field(default_factory=list)


class UploadWriter(DataSourceWriter):
    def __init__(self, target: str, cap: int, kinds: tuple[str, ...]):
        self.target, self.cap, self.kinds = target.rstrip("/"), cap, kinds
        self.staging = f"{self.target}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, staging = pafs.FileSystem.from_uri(self.staging)
        fs.create_dir(staging)
        out, done, current, stream, at, total = Written(), set(), None, None, "", 0

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                out.files.append((current, at, kind, total))
            stream = None

        try:
            for row in iterator:
                if row.document_id != current:
                    close()
                    if row.document_id in done:
                        raise ValueError(f"the rows of {row.document_id} do not stand together")
                    current, total = row.document_id, 0
                    done.add(current)
                    kind = row.name.rpartition(".")[2].lower() if "." in row.name else ""
                    if kind not in self.kinds:
                        out.refused.append((current, row.name, "extension"))
                        continue
                    at = f"{staging}/{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(at)
                if stream is None:
                    continue
                total += len(row.bytes)
                if total > self.cap:
                    stream.close()
                    stream = None
                    fs.delete_file(at)
                    out.refused.append((current, row.name, "size"))
                    continue
                stream.write(bytes(row.bytes))
            close()
        except Exception:
            if stream is not None:
                stream.close()
            for _, staged, _, _ in out.files:
                fs.delete_file(staged)
            if at and fs.get_file_info(at).is_file:
                fs.delete_file(at)
            raise
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """Moves what tasks wrote to its place, and writes a manifest of it. Doing it again for a document replaces its file."""
        fs, target = pafs.FileSystem.from_uri(self.target)
        rows = []
        for m in messages:
            for document, staged, kind, size in m.files if m is not None else ():
                fs.create_dir(f"{target}/{document}")
                fs.move(staged, f"{target}/{document}/raw_source.{kind}")
                rows.append({"document_id": document, "path": f"{self.target}/{document}/raw_source.{kind}", "size": size, "status": "UPLOADED", "reason": None})
            for document, name, reason in m.refused if m is not None else ():
                rows.append({"document_id": document, "path": name, "size": None, "status": "REFUSED", "reason": reason})
        fs.create_dir(f"{target}/_manifest")
        with fs.open_output_stream(f"{target}/_manifest/{time.time_ns():020}.json") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, staging = pafs.FileSystem.from_uri(self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class Uploads(DataSource):
    """Format `uploads`: writes PARTS rows that stand together by document and in order; options path (a folder as a URI), cap, kinds."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def writer(self, schema, overwrite: bool) -> UploadWriter:
        o = self.options
        return UploadWriter(o["path"], int(o.get("cap", CAP)), tuple(o.get("kinds", ",".join(EXTENSIONS)).split(",")))


def save_uploads(spark: SparkSession, files: DataFrame, path: str, cap: int = CAP, tasks: int = 8, size: int = PART) -> DataFrame:
    """Writes files (document_id, name, content) to path/<document_id>/raw_source.<kind> and returns the manifest of this and earlier runs: MANIFEST.

    Names are made safe, and a document_id that would leave the folder is an error. Files beyond the cap or of another kind are refused, each for itself. path is a URI that pyarrow can open."""
    spark.dataSource.register(Uploads)
    safe = files.select(F.when(F.col("document_id").rlike("^[A-Za-z0-9-]+$"), F.col("document_id")).otherwise(F.raise_error("a document_id of other characters than letters, digits and hyphens")).cast("string").alias("document_id"), file_name(F.col("name")).alias("name"), "content")
    rows = parts(safe, size).repartition(tasks, "document_id").sortWithinPartitions("document_id", "part")
    rows.write.format("uploads").option("path", path).option("cap", cap).mode("append").save()
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/_manifest")


#: A document's states, and which may follow which.
FOLLOWS = {None: ("UPLOADED",), "UPLOADED": ("PROCESSING", "FAILED"), "PROCESSING": ("COMPLETED", "FAILED"), "FAILED": ("PROCESSING",), "COMPLETED": ("PROCESSING",)}
STATUS = "document_id string, status string, message string, changed_at timestamp"


def document_statuses(events: DataFrame, stuck: int = 3600) -> DataFrame:
    """document_id, status, message, changed_at: each change of a document's state (STATUS), from a stream of events (document_id, status, message, ts).

    Events of a batch are taken in the order of their time. One that may not follow the state is passed over, as is one that is older than it. A
    document that is in PROCESSING for `stuck` seconds of the stream's time without another event has FAILED. The state is two values for each document that is
    under way; a COMPLETED one's goes after as long."""
    order = {s: k for k, s in enumerate(("UPLOADED", "PROCESSING", "FAILED", "COMPLETED"))}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        document, out = key[0], []
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            if status == "PROCESSING":
                out.append((document, "FAILED", "no answer", pd.Timestamp(at + stuck * 10**6, unit="us")))
                state.update(("FAILED", at + stuck * 10**6))
        else:
            status, at = state.get if state.exists else (None, -1)
            rows = pd.concat(list(batches))
            times = rows["ts"].astype("datetime64[us]").astype("int64")
            for when, new, message in sorted(zip(times, rows["status"], rows["message"], strict=True), key=lambda x: (x[0], order.get(x[1], 9))):
                if new in FOLLOWS[status] and when >= at:
                    status, at = new, int(when)
                    out.append((document, new, message, pd.Timestamp(at, unit="us")))
            if status is not None:
                state.update((status, at))
                state.setTimeoutTimestamp(max(at // 1000 + stuck * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["document_id", "status", "message", "changed_at"])

    d = events.withWatermark("ts", "1 minute").select("document_id", "status", "message", "ts")
    return d.groupBy("document_id").applyInPandasWithState(step, STATUS, "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)
