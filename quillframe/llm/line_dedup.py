"""Line dedup by a deletion-neighbourhood join, in native columns, windows and joins.

A line is its words. Two lines are alike if they have the same words, or, with 8 (`near`) and more
words each, if one word put in, left out or replaced makes them equal. A line goes if
an earlier one (doc_id, then place) is alike, whether that one stays or not.

1. Equal lines become one with its earliest place; the others go.
2. One edit leaves the first or the last L words of a line as they are, L the largest power of two up to half its words.
   Only lines that share such an end with another line go on, which loses no pair.
3. Each of them emits the hash of the line without word i, for every i: with i (replaced in the
   same place) and without (left out, to meet the whole line of the other). Prefix sums of word hashes give all n variants in n steps.
4. Equal keys join through the least line of each key: pre-aggregated, then joined back, so no
   pairs of a group are made. What is found is verified on the words, and the earliest line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import NULL_ID, keyed, materialize, whole_row
from quillframe.llm.quality_rules import let, words_of

#: Lines of fewer words always stay (those without a word); lines of so many words may differ by one edit.
LEAST, NEAR = 1, 8
#: Bits of a word's hash in the sums: 2**23 words of a line do not overflow them.
_BITS = 24


def _lines(docs: DataFrame) -> DataFrame:
    """_id, _sum, pos, s (the line's words, a space between two), n (words). Most lines stand like that already, so they are neither split nor joined."""
    lines = docs.select("_id", "_sum", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    spaced = line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        spaced = spaced | F.contains(line, F.lit(c))
    lines = lines.select("_id", "_sum", "pos", F.when(spaced, F.array_join(words_of(line), " ")).otherwise(line).alias("s"))
    return lines.withColumn("n", F.when(F.col("s") == "", 0).otherwise(F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1))


def _weights(shift: int, seed: int) -> Column:
    """Hash of the word `word` at place k - shift."""
    return F.shiftrightunsigned(F.xxhash64(F.col("k") - shift, F.col("word"), F.lit(seed)), _BITS)


def _ends(near: int) -> Column:
    """Hashes of the ends that a line (s, n) and one of its length or a word longer have in common if one edit tells them apart."""

    def both(length: Column) -> list[Column]:
        return [F.xxhash64(F.lit(k), F.call_function("substring_index", F.col("s"), F.lit(" "), sign * length)) for k, sign in ((0, 1), (1, -1))]

    n = F.col("n")
    half = F.pow(F.lit(2), F.floor(F.log2(n / 2))).cast("int")
    whole_power = (half * 2 == n) & (n > near)  # a line one word shorter has ends half as long
    shorter = F.greatest(F.lit(1), F.floor(half / 2).cast("int"))
    return F.when(n < near, F.array().cast("array<bigint>")).when(whole_power, F.array(*both(half), *both(shorter))).otherwise(F.array(*both(half)))


REPLACED, LEFT_OUT, WHOLE = 0, 1, 2


def _variants(lines: DataFrame) -> DataFrame:
    """(key, kind, lid): the keys of each line (lid, w). A line's words stay in its partition."""
    line = Window.partitionBy("lid")
    before = line.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lines.repartition(parts, "lid").select("lid", F.posexplode("w").alias("k", "word"))
    d = d.select("lid", "k", *[_weights(shift, s).alias(f"{x}{s}") for s in (1, 2) for shift, x in ((0, "f"), (1, "g"))])
    for s in (1, 2):
        without = F.coalesce(F.sum(f"f{s}").over(before), F.lit(0)) + F.sum(f"g{s}").over(line) - F.coalesce(F.sum(f"g{s}").over(before), F.lit(0)) - F.col(f"g{s}")
        d = d.withColumn(f"v{s}", without).withColumn(f"t{s}", F.sum(f"f{s}").over(line))
    replaced = F.struct(F.xxhash64("v1", "v2", "k").alias("key"), F.lit(REPLACED).alias("kind"))
    left_out = F.struct(F.xxhash64("v1", "v2").alias("key"), F.lit(LEFT_OUT).alias("kind"))
    as_it_is = F.struct(F.xxhash64("t1", "t2").alias("key"), F.lit(WHOLE).alias("kind"))
    keys = F.when(F.col("k") == 0, F.array(replaced, left_out, as_it_is)).otherwise(F.array(replaced, left_out))
    return d.select("lid", F.explode(keys).alias("x")).select("x.key", "x.kind", "lid")


def _one_edit(x: Column, y: Column) -> Column:
    """Whether two word lists differ by one word put in, left out or replaced."""

    def longer(a: Column, b: Column) -> Column:
        """a has one word more: with the first difference left out, b is left."""
        at = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.coalesce(z["a"] != z["b"], F.lit(True))), True)
        return let(at.cast("int"), lambda i: F.concat(F.slice(a, 1, i - 1), F.slice(a, i + 1, F.size(a))) == b)

    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda d: d)) <= 1
    return F.when(F.size(x) == F.size(y), same).when(F.size(x) == F.size(y) + 1, longer(x, y)).when(F.size(y) == F.size(x) + 1, longer(y, x)).otherwise(F.lit(False))


def _near(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """o: earliest places of lines that are one edit away from an earlier line. firsts: (o, ends) of distinct lines."""
    ends = firsts.select("o", F.explode("ends").alias("end"))
    several = ends.groupBy("end").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("end")
    places = ends.join(several, "end").select("o").distinct().select("o._id", "o._sum", "o.pos").groupBy("_id", "_sum").agg(F.collect_set("pos").alias("some"))
    picked = docs.join(places, ["_id", "_sum"]).select(
        "_id", "_sum", F.explode(let(F.split("text", "\n"), lambda all_: F.transform("some", lambda i: F.struct(i.alias("pos"), all_[i].alias("line"))))).alias("l")
    )
    picked = picked.select(F.struct("_id", "_sum", "l.pos").alias("o"), words_of(F.col("l.line")).alias("w")).dropDuplicates(["o"])
    # numbers that grow with the place
    lines = materialize(picked.orderBy("o").withColumn("lid", F.monotonically_increasing_id()), "close-lines")
    keys = _variants(lines.select("lid", "w"))
    least = keys.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("lid"))).alias(f"m{k}") for k in (REPLACED, LEFT_OUT, WHOLE)], F.count(F.lit(1)).alias("n"))
    least = materialize(least.filter("n > 1").drop("n"), "shared-keys")
    # replaced meets replaced; left out meets whole, and the other way round
    first = F.when(F.col("kind") == REPLACED, F.col(f"m{REPLACED}")).when(F.col("kind") == LEFT_OUT, F.col(f"m{WHOLE}")).otherwise(F.col(f"m{LEFT_OUT}"))
    pairs = keys.join(least, "key").select("lid", first.alias("first")).filter(F.col("first") < F.col("lid")).distinct()
    words = lines.select(F.col("lid").alias("first"), F.col("w").alias("u"))
    return pairs.join(lines, "lid").join(words, "first").filter(_one_edit(F.col("w"), F.col("u"))).select("o").distinct()


def dropped(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """_id, _sum, gone (places of lines to drop) of the keyed documents that lose lines: of lines of `least` words and more (one at least). near is 2 at least. Written to the shared folder."""
    all_lines = _lines(docs).filter(F.col("n") >= least)
    lines = materialize(all_lines.select(F.struct("_id", "_sum", "pos").alias("o"), *[F.xxhash64(F.lit(k), "s").alias(f"h{k}") for k in (1, 2)], _ends(near).alias("ends")), "lines")
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(F.struct("o", "ends")).alias("m"), F.count(F.lit(1)).alias("k")).select("h1", "h2", "m.o", "m.ends", "k"), "distinct-lines")
    close = _near(docs, firsts)
    equal = lines.join(firsts.filter("k > 1").select("h1", "h2", F.col("o").alias("first")), ["h1", "h2"]).filter(F.col("o") != F.col("first")).select("o")
    gone = close.unionByName(equal).groupBy("o._id", "o._sum").agg(F.collect_set("o.pos").alias("gone"))
    return materialize(gone, "gone-lines")


def _rebuilt(text: Column, gone: Column) -> Column:
    """text without the lines at these places."""
    return let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: x[i]), "\n"))


def dedup(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """row (all columns of a row of docs, as a struct), kept (its text without its repeated lines), gone (how many lines went).

    Null texts have no lines and stay null. Null doc_ids order last. Rows equal in doc_id and text are one document and keep the same lines.
    A text none of whose lines stays becomes empty; no row goes. Columns other than doc_id and text pass through, whatever their names. An
    empty table gives no rows."""
    found = dropped(keyed(docs), least, near)
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_sum")]
    joined = docs.select(whole_row(docs).alias("row"), F.col("text").alias("_text"), *ids).join(found, ["_id", "_sum"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(_rebuilt(F.col("_text"), F.col("gone")))
    return joined.select("row", kept.alias("kept"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("gone"))


def report(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each row of docs; a null text counts as empty, with one empty line."""
    text = F.coalesce("row.text", F.lit(""))
    return dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, near).select(
        "row.doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.col("gone").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


def clean(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """docs with its texts deduplicated by line; n_chars, if there, follows the text."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return dedup(docs, least, near).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
