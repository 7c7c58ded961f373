"""Calls to services, uploads in two phases, statuses as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillframe.operators import exports, services
from quillframe.sources import ingest


def scripted(folder):
    """Makes services that answer a request by what it says, and count calls in a folder that all tasks see."""

    class Scripted:
        def ask(self, request, key):
            n = len([f for f in os.listdir(folder) if f.startswith(key)])
            open(f"{folder}/{key}-{n}", "w").close()
            if "raise" in request:
                raise TimeoutError("late")
            if "spent" in request:
                return services.Reply(429, "credits are used up")
            if "busy" in request or ("once" in request and n == 0):
                return services.Reply(429, "slow down", 4.0 if "once" in request else None)
            if "broken" in request:
                return services.Reply(500, "oh")
            return services.Reply(200, json.dumps({"flashcards": [{"question": "q", "answer": request}]}) if "kit" in request else request.upper())

    return Scripted


def test_one_call_at_a_time():
    slept = []

    class One:
        def __init__(self, *replies):
            self.replies = list(replies)

        def ask(self, request, key):
            return self.replies.pop(0)

    R = services.Reply
    assert services.asked(One(R(200, "ok")), "x", "k") == ("success", "ok", 1, 0.0)
    assert services.asked(One(R(429), R(200, "ok")), "x", "k", sleep=slept.append) == ("success", "ok", 2, 2.5) and slept == [2.5]
    assert services.asked(One(R(429, "", 9.0), R(429)), "x", "k", sleep=slept.append)[0::3] == ("limited", 14.0)
    assert services.asked(One(R(429, "daily limit")), "x", "k") == ("quota_exhausted", "daily limit", 1, 0.0)
    assert services.asked(One(R(500, "no")), "x", "k")[0] == "failed" and services.asked(One(), "x", "k")[0] == "failed"
    assert services.asked(One(), " \n", "k") == ("empty", None, 0, 0.0)


def test_statuses_and_store(spark, tmp_path):
    calls, store = tmp_path / "calls", f"file://{tmp_path}/store"
    calls.mkdir()
    make = scripted(str(calls))
    requests = [(1, "hello"), (2, "hello"), (3, "once"), (4, "busy"), (5, "broken"), (6, "raise"), (7, None), (8, "other")]
    df = spark.createDataFrame(requests, "id int, request string")
    how = {"pause": 0.0, "sleep": lambda s: None, "tasks": 3}
    got = {r.id: r for r in services.answered(df, store, make, **how).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "success", 2: "success", 3: "success", 4: "limited", 5: "failed", 6: "failed", 7: "empty", 8: "success"}
    assert got[1].reply == got[2].reply == "HELLO" and not got[1].from_store
    n = len(os.listdir(calls))
    assert n == 1 + 2 + 2 + 1 + 1 + 1
    again = {r.id: r for r in services.answered(df, store, make, **how).collect()}
    assert again[1].from_store and again[3].from_store and not again[5].from_store
    assert len(os.listdir(calls)) == n + 2 + 1 + 1  # only what had no success
    spent = services.called(spark.createDataFrame([(f"k{k}", "spent") for k in range(20)], "key string, request string"), make, tasks=1, **{k: v for k, v in how.items() if k != "tasks"}).collect()
    assert {r.status for r in spent} == {"quota_exhausted"} and sum(r.attempts for r in spent) == 1


def test_a_rate_for_all_tasks(spark):
    class Fast:
        def ask(self, request, key):
            return services.Reply(200, "")

    import time

    df = spark.range(12).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("request"))
    began = time.monotonic()
    assert services.called(df, Fast, tasks=2, rate=10).filter("status = 'success'").count() == 12
    assert time.monotonic() - began > 0.8  # six and more calls of one task with a gap of 0.2


def test_pages_are_corrected_or_fall_back(spark):
    lines = spark.createDataFrame([(p, k, f"raw {p} {k}", 0.5) for p in (1, 2, 3) for k in range(3)] + [(4, 7, "only", 0.9)], "page_id int, line_index int, text string, confidence double")
    first = lines.select("page_id", "line_index", F.concat("text", F.lit("!")).alias("corrected_text"), F.lit(True).alias("changed"), (F.col("confidence") + 0.1).alias("confidence"))
    chunks, requests = services.chunk_requests(first.withColumnRenamed("corrected_text", "text"), "page_id", "line_index", 2)
    sent = {(r.page_id, r.chunk): r.request for r in requests.collect()}
    assert sent[(1, 0)] == "[Line 0]: raw 1 0!\n[Line 1]: raw 1 1!" and sent[(1, 1)] == "[Line 2]: raw 1 2!"
    good = json.dumps({"corrections": [{"line_index": 1, "corrected_text": "fixed"}, {"line": 0, "corrected": "RAW 1 0"}, {"line_index": 0, "corrected_text": " "}]})
    results = spark.createDataFrame([(1, 0, "success", f"```json\n{good}\n```"), (1, 1, "limited", "slow"), (2, 0, "success", good), (2, 1, "failed", None), (3, 0, "quota_exhausted", "x"), (3, 1, "success", "no json"), (4, 0, "success", "{}")], "page_id int, chunk int, status string, reply string")
    out = services.corrected(lines, first, results, chunks)
    got = {(r.page_id, r.line_index): (r.corrected_text, r.changed, round(r.confidence, 2), r.mode, r.status) for r in out.collect()}
    assert got[(1, 1)] == ("fixed", True, 0.72, "hybrid", "success")
    assert got[(1, 0)] == ("RAW 1 0", False, 0.6, "hybrid", "success")
    assert got[(1, 2)] == ("raw 1 2!", True, 0.72, "hybrid", "success")
    assert got[(2, 1)] == ("raw 2 1!", True, 0.6, "heuristic", "fallback_success") and got[(3, 1)][3:] == ("heuristic", "success")
    assert got[(4, 7)] == ("only!", True, 0.98, "hybrid", "success")
    pages = {r.page_id: (r.status, r.total_lines, r.corrected_count) for r in services.page_statuses(spark.createDataFrame([(1,), (2,), (9,)], "page_id int"), out).collect()}
    assert pages == {1: ("success", 3, 2), 2: ("fallback_success", 3, 3), 9: ("empty", 0, 0)}


def test_study_kits_are_kept_by_content(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    lines = spark.createDataFrame([(1, 0, "kit"), (1, 1, "b"), (2, 0, "kit"), (2, 1, "b"), (3, 0, "broken")], "doc_id int, pos int, text string")
    for _ in range(2):
        got = sorted((r.doc_id, r.answer, r.made_by) for r in services.study_kits(lines, f"file://{tmp_path}/kits", scripted(str(calls))).collect())
        assert got == [(1, "kit\nb", "service"), (2, "kit\nb", "service"), (3, "broken", "stand-in")]
    assert len(os.listdir(calls)) == 3  # one for the text of 1 and 2, and one in each run for 3


def test_guides_of_a_service(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    lines = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "broken"), (3, 0, " ")], "doc_id int, pos int, text string")
    out = services.guides(lines, f"file://{tmp_path}/guides", scripted(str(calls)))
    assert [(r.doc_id, r.guide) for r in out.collect()] == [(1, "A\nB")]
    made = {(r.doc_id, r.export_format): r.content for r in exports.guide_export(lines, out, "T").collect()}
    assert made[(1, "TXT")] == made[(1, "MARKDOWN")] == "A\nB" and "broken" in made[(2, "TXT")] and exports.NO_TEXT in made[(3, "TXT")]


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if "_manifest" not in d and not f.endswith(".crc"))


def test_uploads_in_two_phases(spark, tmp_path):
    big = bytes(range(256)) * 40
    rows = [("a1", "../x/Scan 1.PNG", big), ("a2", "b.jpg", b""), ("a3", "c.exe", b"x"), ("a4", "d.png", big * 3), ("a5", "noend", b"x")]
    df = spark.createDataFrame(rows, "document_id string, name string, content binary")
    path = f"file://{tmp_path}/up"
    got = {r.document_id: r for r in ingest.save_uploads(spark, df, path, cap=20_000, tasks=3, size=1000).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {"a1": ("UPLOADED", None), "a2": ("UPLOADED", None), "a3": ("REFUSED", "extension"), "a4": ("REFUSED", "size"), "a5": ("REFUSED", "extension")}
    assert files(tmp_path / "up") == ["a1/raw_source.png", "a2/raw_source.jpg"] and (tmp_path / "up/a1/raw_source.png").read_bytes() == big
    parts = ingest.parts(df, 1000)
    assert parts.filter("document_id = 'a1'").count() == 11 and parts.filter("document_id = 'a2'").count() == 1
    with pytest.raises(Exception, match="document_id"):
        ingest.save_uploads(spark, spark.createDataFrame([("../x", "a.png", b"x")], df.schema), path).count()


def test_a_failed_upload_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(ingest.Uploads)
    rows = [("a", "a.png", 0, b"x"), ("b", "b.png", 0, b"y"), ("a", "a.png", 1, b"x")]  # the rows of one document do not stand together
    df = spark.createDataFrame(rows, ingest.PARTS).coalesce(1)
    with pytest.raises(Exception, match="stand together"):
        df.write.format("uploads").option("path", f"file://{tmp_path}/up").mode("append").save()
    assert files(tmp_path / "up") == []
    writer = ingest.UploadWriter(f"file://{tmp_path}/direct", 10, ("png",))
    from pyspark.sql import Row

    message = writer.write(iter([Row(document_id="a", name="a.png", part=0, bytes=b"12345")]))
    assert len(files(tmp_path / "direct")) == 1
    writer.abort([message, None])
    assert files(tmp_path / "direct") == []


def test_statuses_of_documents_as_a_stream(spark, tmp_path):
    source, out = tmp_path / "events", {}
    source.mkdir()
    schema = "document_id string, status string, message string, ts timestamp"

    def put(k, rows):
        (source / f"{k}.json").write_text("".join(json.dumps(dict(zip(("document_id", "status", "message", "ts"), r))) + "\n" for r in rows))

    put(1, [("a", "PROCESSING", None, "2024-01-01T10:01:00"), ("a", "UPLOADED", None, "2024-01-01T10:00:00"), ("b", "UPLOADED", None, "2024-01-01T10:00:00"), ("c", "COMPLETED", None, "2024-01-01T10:00:00")])
    put(2, [("a", "COMPLETED", "done", "2024-01-01T10:05:00"), ("a", "FAILED", "late news", "2024-01-01T10:00:30"), ("b", "PROCESSING", None, "2024-01-01T10:02:00")])
    put(3, [("z", "UPLOADED", None, "2024-01-02T10:00:00")])
    put(4, [("z", "PROCESSING", None, "2024-01-02T10:00:01")])
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))

    def keep(df, batch):
        for r in df.collect():
            out.setdefault(r.document_id, []).append((r.status, r.message))

    q = ingest.document_statuses(events, stuck=600).writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert out["a"] == [("UPLOADED", None), ("PROCESSING", None), ("COMPLETED", "done")]
    assert out["b"] == [("UPLOADED", None), ("PROCESSING", None), ("FAILED", "no answer")]
    assert "c" not in out and out["z"] == [("UPLOADED", None), ("PROCESSING", None)]
