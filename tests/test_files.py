import json

from quillframe.operators import pages, relational as R
from quillframe.sources import files as S
from quillframe.streaming import counters


def test_readers(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.JPG").write_bytes(b"x" * 10)
    (tmp_path / "up/b.exe").write_bytes(b"x")
    good, bad = S.uploads(spark, str(tmp_path / "up"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "lex.txt").write_text("Cat\n dog \n\ncat\n")
    assert {r.word for r in S.lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {"cat", "dog"}
    assert S.lexicon(spark, str(tmp_path / "none.txt")).count() == 0
    coco = {"images": [{"id": 1, "file_name": "p.png"}], "annotations": [
        {"image_id": 1, "group_id": 7, "attributes": {"translation": " hi "}, "segmentation": [[0, 1, 9, 1, 9, 8]]},
        {"image_id": 2, "group_id": 7, "attributes": {"translation": "lost"}, "segmentation": [[0, 1, 9, 1, 9, 8]]},
        {"image_id": 1, "group_id": 8, "attributes": {"translation": "thin"}, "segmentation": [[0, 1]]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    got = S.annotations(spark, str(tmp_path / "c.json")).collect()
    assert [(r.text, r.x0, r.y1) for r in got] == [("hi", 0.0, 8.0)]
    (tmp_path / "m.json").write_text(json.dumps({"train": [{"image_path": "a", "text": "t", "source": "s"}], "val": []}))
    assert S.manifest(spark, str(tmp_path / "m.json")).first().split == "train"
    (tmp_path / "p.json").write_text(json.dumps({"user_id": "u"}))
    row = S.profiles(spark, str(tmp_path / "p.json")).first()
    assert row.display_name == "u" and row.total_corrections == 0 and row.custom_vocabulary == []


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc int, content string")
    S.write_texts(rows, str(tmp_path / "t"), "doc")
    assert {r.text.strip() for r in S.whole_texts(spark, str(tmp_path / "t")).collect()} == {"a\nb", "c"}
    lines = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "page int, k int, text string")
    path = str(tmp_path / "lines")
    S.replace_partitions(lines, path, "page")
    S.replace_partitions(lines.filter("page = 1").withColumn("k", lines.k + 5), path, "page")
    assert {(r.page, r.k) for r in spark.read.parquet(path).collect()} == {(1, 5), (2, 0)}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "page int, k int, text string").write.parquet(src)
    stream = spark.readStream.schema("page int, k int, text string").parquet(src)
    counters.replace_children_stream(stream, str(tmp_path / "out"), "page", str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    ev = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01' ts, 'u' user_id, 'a' a, 'b' b").write.parquet(ev)
    counts = counters.running_counts(spark.readStream.schema("ts timestamp, user_id string, a string, b string").parquet(ev))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").first().n == 1


def test_uploads_become_documents_once(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/note 1.JPG").write_bytes(b"x" * 10)
    (tmp_path / "up/b.exe").write_bytes(b"x")
    good, _ = S.uploads(spark, str(tmp_path / "up"))
    empty = [spark.createDataFrame([], R.SCHEMAS[t]) for t in ("documents", "pages")]
    documents, rows = pages.ingest(good, *empty)
    one, page = documents.collect()[0], rows.collect()[0]
    assert (one.title, one.mime_type, one.status, one.file_size_bytes, one.author) == ("note 1", "image/jpeg", "UPLOADED", 10, "default")
    assert page.document_id == one.id and page.page_number == 1 and page.raw_image_path == one.file_path
    again = pages.ingest(good, documents, rows)
    assert again[0].count() == 1 and again[1].count() == 1
