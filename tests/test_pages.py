from pyspark.sql import functions as F

from quillframe.operators import distance, exports, pages, plugins, relational, sequence

LINES = "page_id int, line_index int, text string, confidence double"


def test_page_chain(spark):
    old = pages.Tables(
        spark.createDataFrame([(1, 0, "old", 0.5), (2, 0, "other", 0.5)], LINES),
        spark.createDataFrame([(1, "TXT", "x")], "page_id int, export_format string, content string"),
        spark.createDataFrame([(1, "PROCESSING"), (2, "UPLOADED")], "page_id int, status string"),
    )
    lexicon = spark.createDataFrame([("some",), ("words",), ("here",)], "word string")
    new = spark.createDataFrame([(1, 0, "some words here", 0.9), (1, 1, "?", 0.9), (1, 2, "42", 0.9)], LINES)
    out = pages.finish(new, old, lexicon)
    got = {(r.page_id, r.line_index): r for r in out.lines.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[(1, 1)].text == "42"
    assert abs(got[(1, 0)].confidence - 0.9) < 1e-9
    assert {r.page_id: r.status for r in out.pages.collect()} == {1: "COMPLETED", 2: "UPLOADED"}
    assert out.exports.count() == 2 and "some words here" in out.exports.filter("export_format = 'MARKDOWN'").first().content
    again = pages.finish(new, out, lexicon)
    assert sorted(map(tuple, again.lines.collect())) == sorted(map(tuple, out.lines.collect()))


def test_suggestions(spark):
    lines = spark.createDataFrame([(1, 0, "the kottle boils.", 0.5), (1, 1, "fine here", 0.5)], LINES)
    lexicon = spark.createDataFrame([("the",), ("boils",), ("fine",), ("here",)], "word string")
    got = {r.line_index: r for r in pages.suggest(lines, spark.createDataFrame([("kettle",)], "word string"), lexicon).collect()}
    assert got[0].corrected_text == "the kettle boils." and got[0].changed and abs(got[0].confidence - 0.6) < 1e-9
    assert not got[1].changed
    fixed = pages.apply_corrections(lines, spark.createDataFrame([(1, 0, "new"), (1, 1, " ")], "page_id int, line_index int, corrected_text string"))
    assert {r.line_index: r.text for r in fixed.collect()} == {0: "new", 1: "fine here"}


def test_snapping(spark):
    tokens = spark.createDataFrame([(1, 0, "Kottle,"), (1, 1, "abc"), (1, 2, "teh1"), (1, 3, "xylophone"), (1, 4, "recieve")], "d int, k int, token string")
    vocabulary = spark.createDataFrame([("kettle",), ("receive",), ("relieve",)], "word string")
    fixed = spark.createDataFrame([("recieve", "receive")], "word string, replacement string")
    out = {r.k: r.token for r in distance.snapped(tokens, vocabulary, fixed, ["d"]).collect()}
    assert out == {0: "Kettle,", 1: "abc", 2: "teh1", 3: "xylophone", 4: "receive"}


def test_replies_find_their_lines(spark):
    lines = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (0, 2, 1), (1, 0, 20)], "chunk int, place int, line_index int")
    replies = [(0, 0, 11, "by index"), (0, 1, 0, "by place"), (0, 2, 99, "by its own place"), (0, 3, 99, "lost"), (0, 4, 1, "index before place"), (1, 0, None, "no number"), (2, 0, 20, "no such chunk")]
    out = plugins.resolved(spark.createDataFrame(replies, "chunk int, pos int, raw int, corrected_text string"), lines, ["chunk"])
    assert {(r.chunk, r.line_index): r.corrected_text for r in out.collect()} == {(0, 11): "by index", (0, 10): "by place", (0, 1): "index before place", (1, 20): "no number"}


def test_migration_adds_only(spark):
    d = spark.createDataFrame([(1, "a")], "id int, Title string")
    out = relational.migrated(d, relational.SCHEMAS["documents"], author=F.lit("default"))
    row = out.first()
    assert out.columns[:2] == ["id", "Title"] and row.id == 1 and row.Title == "a" and row.author == "default" and row.status is None
    assert relational.migrated(out, relational.SCHEMAS["documents"]).columns == out.columns


def test_first_of_each_key(spark):
    rows = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 1), (None, 2)], "key string, area int")
    out = sequence.top(rows, ["key"], [F.desc("area")], 5)
    assert {(r.key, r["rank"], r.area) for r in out.collect()} == {("a", k, 9 - k) for k in range(1, 6)} | {("b", 1, 1), (None, 1, 2)}


def test_guides_or_what_stands_for_them(spark):
    lines = spark.createDataFrame([(1, 0, "some words"), (2, 0, "other words"), (3, 0, "more words")], "doc_id int, pos int, text string")
    guides = spark.createDataFrame([(1, "# Guide"), (2, "  ")], "doc_id int, guide string")
    out = {(r.doc_id, r.export_format): r.content for r in exports.guide_export(lines, guides, "Notes").collect()}
    assert len(out) == 6 and out[(1, "MARKDOWN")] == out[(1, "TXT")] == "# Guide"
    assert "other words" in out[(2, "TXT")] and out[(3, "TXT")] == out[(3, "MARKDOWN")]
