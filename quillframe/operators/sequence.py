"""Operators over ordered rows: each takes the columns that partition and order, and never relies on the order of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import CONNECTORS, capitalize_sentences, clean_noise, strip
from quillframe.operators.language_model import gibberish_penalty

DASH_END, LETTER_START = "\\p{L}+[-–—=]$", "^\\p{L}"
#: A word and the dash or full stop that breaks it at a line's end.
WORD_BREAK = "([\\p{L}\\p{N}\\p{M}_]+)[-.]$"


def _greedy_pairs(rows: DataFrame, group: str, order: str, edge: Column) -> DataFrame:
    """rows with take: greedy choice, from the first row on, of neighbouring pairs whose `edge` (about the row and `nxt`) holds; each row is in one pair at most.

    Runs of edges are islands; of an island every other edge, from its first, is taken."""
    w = Window.partitionBy(group).orderBy(order)
    d = rows.withColumn("nxt", F.lead("text").over(w)).withColumn("edge", F.coalesce(edge, F.lit(False)))
    d = d.withColumn("isl", F.coalesce(F.sum((~F.col("edge")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group, "isl").orderBy(order))
    d = d.withColumn("take", F.col("edge") & (place % 2 == 1))
    return d.withColumn("used", F.coalesce(F.lag("take").over(w), F.lit(False))).drop("edge", "isl")


def stitch_hyphens(rows: DataFrame, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """A line that ends in letters and a dash takes the next line, if that starts with a letter; a joined line is not asked again."""
    rows = rows.withColumn("text", strip(F.col("text")))
    d = _greedy_pairs(rows, group, order, F.col("text").rlike(DASH_END) & F.col("nxt").rlike(LETTER_START))
    joined = F.concat(F.regexp_replace("text", "[-–—=]$", ""), F.col("nxt"))
    return d.filter(~F.col("used")).withColumn("text", F.when(F.col("take"), joined).otherwise(F.col("text"))).drop("nxt", "take", "used")


def bind_connectors(rows: DataFrame, group: str = "doc_id", order: str = "pos", connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """A connector at a line's end moves to the next line if that starts in lower case or with a digit. `sub` orders the rows a line makes."""
    rows = rows.withColumn("text", strip(F.col("text")))
    last = F.regexp_extract("text", "(\\S+)$", 1)
    d = _greedy_pairs(rows, group, order, F.lower(last).isin(*connectors) & F.col("nxt").rlike("^[\\p{Ll}0-9]"))
    head = F.regexp_replace("text", "\\s*\\S+$", "")
    bound = F.concat(last, F.lit(" "), F.col("nxt"))
    made = F.when(F.col("take"), F.filter(F.array(head, bound), lambda x: x != "")).otherwise(F.array("text"))
    kept = [c for c in rows.columns if c != "text"]
    return d.filter(~F.col("used")).select(*kept, F.posexplode(made).alias("sub", "text"))


def merge_sentences(rows: DataFrame, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """Lines that go on a sentence join the line before; blank lines go. Rows: group, first `order` of each sentence as pos, text."""
    w = Window.partitionBy(group).orderBy(order)
    own = "^([-*•–—]\\s+|\\d+[.)]\\s+|#|\\$\\$)|:$"
    d = rows.withColumn("text", strip(F.col("text"))).withColumn("prev", F.lag("text").over(w))
    goes_on = (
        (F.col("prev") != "") & ~F.col("text").rlike(own) & ~F.col("prev").rlike("(:|\\$\\$)$") & ~F.col("prev").rlike("^\\$\\$") & ~F.col("prev").rlike("[.!?:]$") & F.col("text").rlike("^\\p{Ll}")
    )
    d = d.withColumn("grp", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w)).filter("text <> ''")
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return d.groupBy(group, "grp").agg(F.min(order).alias("pos"), parts.alias("p")).select(group, "pos", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def document_text(rows: DataFrame, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """The chain: stitch, bind, merge, capitalise."""
    bound = bind_connectors(stitch_hyphens(rows, group, order), group, order)
    flat = bound.withColumn(order, F.struct(F.col(order).alias("a"), F.col("sub").alias("b"))).drop("sub")
    merged = merge_sentences(flat, group, order)
    return merged.select(group, F.col("pos.a").alias("pos"), F.col("pos.b").alias("sub"), capitalize_sentences(F.col("text")).alias("text"))


#: Broken words that are known (start of the first part, start of the second, the whole word, whether the rest of
#: the next line is a line of its own), and starts of a joined word that stand for a known one.
BROKEN_WORDS = (("общ", "тва", "общества.", True), ("общес", "твен", "общества.", True), ("ответ", "ответ", "ответственность.", False))
WHOLE_WORDS = (("общ", "общества"), ("становлен", "становления"))


def _once(rows: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """keep, and value by that name. The optimizer copies a projected expression into the filters and projections that use it; what a generator makes is made once."""
    return rows.select(*keep, F.explode_outer(F.array(value)).alias(name))


def dewrap(
    rows: DataFrame, lexicon: DataFrame, trigrams: DataFrame, group: str = "doc_id", order: str = "pos",
    broken: tuple[tuple[str, str, str, bool], ...] = BROKEN_WORDS, whole: tuple[tuple[str, str], ...] = WHOLE_WORDS,
) -> DataFrame:
    """group, pos (from 0), text: lines cleaned of noise, blank ones dropped, with words that a dash or full stop breaks at a line's end put together.

    A known broken word becomes the whole one; what is left of the next line stays a line, which can break again, or goes. A next line of one word of up to five
    letters ends the word and gets a full stop. Otherwise the two parts join if they make a lexicon word (lexicon: word), or one of six letters and more whose trigrams
    (trigrams: tri, n) bear no penalty, and the rest of the next line follows on the same line.

    A line is whole, or without its first word, or used up by the line before: which, only the branch of the line before says. So a line's branch does not depend on
    its own state, lines that use up the next one alternate in runs, and windows over a group state the fold. The words that are asked are joined with
    the lexicon once each."""
    w = Window.partitionBy(group).orderBy(order)
    d = _once(rows.select(group, order, "text"), clean_noise(F.col("text")), "text", group, order).filter("text <> ''").withColumn("nxt", F.lead("text").over(w))
    prefix = F.when(F.col("nxt").isNotNull(), F.lower(F.regexp_extract(F.substring_index("text", " ", -1), WORD_BREAK, 1)))
    first = F.regexp_replace(F.lower(F.regexp_extract("nxt", "^(\\S*)", 1)), "[.,;:!?]+$", "")
    parts = F.struct(prefix.alias("prefix"), first.alias("first"), F.regexp_extract("nxt", "^\\S*\\s(.*)$", 1).alias("rem"))
    d = _once(d, F.when(F.col("nxt").isNotNull(), parts), "at", group, order, "text").select(group, order, "text", "at.*")
    breaks = F.coalesce(F.col("prefix") != "", F.lit(False))
    known = F.lit(None).cast("struct<word:string,keep:boolean>")
    for a, b, word, keep in reversed(broken):
        known = F.when(F.col("prefix").startswith(a) & F.col("first").startswith(b), F.struct(F.lit(word).alias("word"), F.lit(keep).alias("keep"))).otherwise(known)
    d = d.withColumn("known", F.when(breaks, known))
    short = breaks & F.col("known").isNull() & (F.col("rem") == "") & (F.length("first") <= 5)
    joined = F.concat("prefix", "first")
    d = d.withColumn("short", F.coalesce(short, F.lit(False))).withColumn("asked", F.when(breaks & F.col("known").isNull() & ~F.col("short"), joined))
    asked = d.filter("asked is not null").select(group, "asked")
    words = gibberish_penalty(asked.select(F.col("asked").alias("word")).distinct(), trigrams)
    words = words.join(lexicon.select("word", F.lit(True).alias("listed")).distinct(), "word", "left").filter("listed or length(word) >= 6 and penalty = 0")
    good = asked.join(words.select(F.col("word").alias("asked")), "asked")
    good = good.groupBy(group).agg(F.collect_set("asked").alias("good"))  # of one group's own lines
    d = d.join(good, group, "left").withColumn("good", F.coalesce(F.array_contains("good", F.col("asked")), F.lit(False)))
    keeps = F.coalesce(F.col("known.keep") & (F.col("rem") != ""), F.lit(False))
    d = d.withColumn("keeps", keeps).withColumn("uses", ~keeps & (F.col("known").isNotNull() | F.col("short") | F.col("good")))
    d = d.withColumn("isl", F.coalesce(F.sum((~F.col("uses")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("take", F.col("uses") & (F.row_number().over(Window.partitionBy(group, "isl").orderBy(order)) % 2 == 1))
    d = d.withColumn("used", F.coalesce(F.lag("take").over(w), F.lit(False))).withColumn("cut", F.coalesce(F.lag(F.col("keeps") & ~F.col("used")).over(w), F.lit(False)))
    stem = joined
    for a, word in reversed(whole):
        stem = F.when(joined.startswith(a), F.lit(word)).otherwise(stem)
    ending = F.when(F.col("known").isNotNull(), F.col("known.word")).when(F.col("short"), F.concat(stem, F.lit("."))).when(F.col("good"), F.concat(joined, F.when(F.col("rem") != "", F.concat(F.lit(" "), "rem")).otherwise("")))
    own = F.when(F.col("cut"), F.regexp_extract("text", "^\\S*\\s(.*)$", 1)).otherwise(F.col("text"))
    text = F.when(ending.isNotNull(), F.concat(F.regexp_replace(own, WORD_BREAK, ""), ending)).otherwise(own)
    return d.filter(~F.col("used")).select(group, (F.row_number().over(w) - 1).cast("int").alias("pos"), text.alias("text"))


def carry_forward(rows: DataFrame, value: str, group: list[str], order: list[str], out: str = "carried") -> DataFrame:
    """The last value before a row that is not null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in this order. A window over the key's rows; each key's pre-sorted top is kept as the shuffle allows."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows of each key in this order, with their rank from 1. A task hands on no more than n rows of a key, so a hot key is small after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def merge_intervals(rows: DataFrame, group: str, start: str, end: str, gap: float, least: float = 0.0) -> DataFrame:
    """Intervals of a group that overlap or lie closer than gap become one; short ones go."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rows.withColumn("_new", F.coalesce(F.col(start) - before >= gap, F.lit(True)).cast("int"))
    d = d.withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(group, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).filter(F.col("end") - F.col("start") >= least).drop("_g")


def gap_clusters(rows: DataFrame, group: str, at: str, gap: float) -> DataFrame:
    """Clusters of a group's places: a gap of more than `gap` starts a new one."""
    w = Window.partitionBy(group).orderBy(at)
    d = rows.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(group, F.col("_g").alias("cluster")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def renumbered(rows: DataFrame, keep: Column, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """Rows that stay, with line_index 0 .. n-1 in each group."""
    return rows.filter(keep).withColumn("line_index", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("int"))


def side_by_side(rows: DataFrame, group: str, order: list[str], left: Column) -> DataFrame:
    """Two-column table: rows of either side by rank, the shorter side filled with empty text. The side with a rank alone still has a row."""
    w = Window.partitionBy(group, "_side").orderBy(*order)
    d = rows.withColumn("_side", left).withColumn("rank", F.row_number().over(w).cast("int"))
    a = d.filter("_side").select(group, "rank", F.col("text").alias("left_text"))
    b = d.filter("not _side").select(group, "rank", F.col("text").alias("right_text"))
    return a.join(b, [group, "rank"], "full").select(group, "rank", F.coalesce("left_text", F.lit("")).alias("left_text"), F.coalesce("right_text", F.lit("")).alias("right_text"))

