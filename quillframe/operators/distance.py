"""Weighted edit distance with a cost table of look-alike letters, and candidates within two edits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import blocks
from quillframe.functions.text import capital, first_rule, let, strip

#: Letters that look alike in handwriting; the cost of exchanging two of one group.
LOOKALIKES = ("aoec", "iljt", "mnuw", "bhk", "gqy", "rvs", "dp")
LOOKALIKE_COST = 0.20


def cost_table(spark: SparkSession) -> DataFrame:
    """a, b, cost of each ordered pair of look-alikes."""
    return spark.createDataFrame([(a, b, LOOKALIKE_COST) for g in LOOKALIKES for a, b in permutations(g, 2)], "a string, b string, cost double")


def substitution_cost(a: Column, b: Column) -> Column:
    """0 equal, 0.20 look-alikes whatever their case, else 1; a difference of case alone costs 1."""
    la, lb = F.lower(a), F.lower(b)
    alike = F.lit(False)
    for g in LOOKALIKES:
        alike = alike | (la.isin(*g) & lb.isin(*g) & (la != lb))
    return F.when(a == b, 0.0).when(alike, LOOKALIKE_COST).otherwise(1.0)


def weighted_distance(s: Column, t: Column, most: float = 3.0) -> Column:
    """Edit distance with those costs, 1 for an insertion or a deletion; null beyond `most`. One array of a row's costs is folded over s."""

    def whole(a: Column, b: Column) -> Column:
        def row(prev: Column, ca: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(1), F.size(b)),
                F.array(prev[0] + 1.0),
                lambda acc, j: F.array_append(acc, F.least(F.element_at(acc, -1) + 1.0, prev[j] + 1.0, prev[j - 1] + substitution_cost(ca, b[j - 1]))),
            )

        first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("double"))
        return F.element_at(F.aggregate(a, first, row), -1)

    value = F.when(F.length(s) == 0, F.length(t).cast("double")).when(F.length(t) == 0, F.length(s).cast("double"))
    value = value.otherwise(let(F.struct(F.split(s, "").alias("a"), F.split(t, "").alias("b")), lambda x: whole(x["a"], x["b"])))
    return F.when(F.abs(F.length(s) - F.length(t)) <= most, let(value, lambda v: F.when(v <= most, v)))


def folded(word: Column) -> Column:
    """Lower case, each look-alike as the first of its group: words within a weighted distance below 3 are within two plain edits when folded."""
    return F.translate(F.lower(word), "".join(g[1:] for g in LOOKALIKES), "".join(g[0] * (len(g) - 1) for g in LOOKALIKES))


#: Words up to so many letters meet by the letters that two deletions leave; longer ones by thirds, of which two edits leave one as it is.
SHORT = 20


def _deletions(w: Column) -> Column:
    """The word, and what is left when one or two of its letters go."""

    def less(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))

    def whole(x: Column) -> Column:
        one = F.when(F.length(x) > 0, less(x)).otherwise(F.array().cast("array<string>"))
        return let(one, lambda o: F.array_distinct(F.concat(F.array(x), o, F.flatten(F.transform(F.filter(o, lambda y: F.length(y) > 0), less)))))

    return let(w, whole)


def _third(x: Column, length: Column, k: int, shift: Column | int = 0) -> Column:
    """The k-th third of a word of that length, cut out of x so many letters further on."""
    size = F.floor(length / 3).cast("int")
    return F.concat_ws(":", length.cast("string"), F.lit(str(k)), F.substr(x, F.lit(1) + size * k + shift, length - 2 * size if k == 2 else size))


def near_pairs(words: DataFrame, vocabulary: DataFrame, fold: bool = False) -> DataFrame:
    """word, candidate pairs that hold all within two edits (of the folded words, with fold), and some more: an equi-join on keys that two edits leave in common.

    Keys are selective whatever a word's length, so no length is a hot group."""
    key = folded(F.col("word")) if fold else F.col("word")
    asked, known = (d.select("word").distinct().withColumn("x", key) for d in (words, vocabulary))
    n = F.length("x")
    none = F.array().cast("array<string>")
    deleted = F.when(n <= SHORT, _deletions(F.col("x"))).otherwise(none)
    own = F.when(n > SHORT - 2, F.array(*[_third(F.col("x"), n, k) for k in range(3)])).otherwise(none)
    lengths = F.sequence(n - 2, n + 2)
    shifts = F.sequence(F.lit(-2), F.lit(2))
    reach = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(shifts, lambda s: F.array(*[_third(F.col("x"), m, k, s) for k in range(3)])))))
    reached = F.when(n > SHORT - 2, F.array_distinct(reach)).otherwise(none)
    a = asked.select("word", F.explode(F.concat(deleted, reached)).alias("key"))
    b = known.select(F.col("word").alias("candidate"), F.explode(F.concat(deleted, own)).alias("key"))
    return a.join(b, "key").select("word", "candidate").distinct()


def candidates(words: DataFrame, vocabulary: DataFrame, top: int = 3, most: float = 2.2, bonus: Column | None = None) -> DataFrame:
    """word, rank, candidate, score, dist: the best `top` of each distinct word of three and more characters.

    `most` is below 3: near_pairs() has all candidates within that. A word of the vocabulary has itself alone, score 1. Order: score, then nearness, then word, all descending."""
    asked = words.select("word").distinct().filter(F.length("word") >= 3)
    known = asked.join(vocabulary.select("word").distinct(), "word", "left_semi").select("word", F.col("word").alias("candidate"), F.lit(1.0).alias("score"), F.lit(0.0).alias("dist"))
    new = asked.join(vocabulary.select("word").distinct(), "word", "left_anti")
    near = near_pairs(new, vocabulary, fold=True).withColumn("dist", weighted_distance(F.col("word"), F.col("candidate"), most)).filter("dist is not null")
    score = F.greatest(F.lit(0.0), 1 - F.col("dist") / F.greatest(F.lit(1), F.length("candidate"))) + (F.lit(0.0) if bonus is None else bonus)
    near = near.select("word", "candidate", score.alias("score"), "dist")
    w = Window.partitionBy("word").orderBy(F.desc("score"), F.asc("dist"), F.desc("candidate"))
    ranked = near.union(known).withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= top)
    return ranked.select("word", "rank", "candidate", F.bround("score", 3).alias("score"), F.bround("dist", 2).alias("dist"))


def corrected_lines(tokens: DataFrame, vocabulary: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, changed: each token that is not in the lexicon takes its best candidate if that is near (1.6) or scores 0.70.

    tokens: keys, k, token. Tokens with formula marks, short capitals and tokens that are no words stay. Edge marks come back."""
    body = F.regexp_replace("token", "^[^\\p{L}]+|[^\\p{L}]+$", "")
    plain = ~F.col("token").rlike("[$\\\\]") & ~((F.col("token") == F.upper("token")) & (F.length("token") <= 3)) & body.rlike("^\\p{L}+$")
    t = tokens.withColumn("word", F.when(plain, F.lower(body)))
    asked = t.filter("word is not null").select("word").distinct().join(lexicon, "word", "left_anti")
    best = candidates(asked, vocabulary, 1).filter((F.col("dist") <= 1.6) | (F.col("score") >= 0.70)).select("word", "candidate")
    t = t.join(best, "word", "left")
    shown = F.when(F.substring(body, 1, 1) == capital(F.substring(body, 1, 1)), F.concat(capital(F.substring("candidate", 1, 1)), F.substr("candidate", F.lit(2)))).otherwise(F.col("candidate"))
    edges = F.concat(F.regexp_extract("token", "^([^\\p{L}]*)", 1), shown, F.regexp_extract("token", "([^\\p{L}]*)$", 1))
    t = t.withColumn("new", F.coalesce(edges, "token"))
    parts = F.sort_array(F.collect_list(F.struct("k", "new", "token")))
    joined = t.groupBy(*keys).agg(parts.alias("p"))
    text, old = F.array_join(F.transform("p", lambda x: x["new"]), " "), F.array_join(F.transform("p", lambda x: x["token"]), " ")
    return joined.select(*keys, text.alias("text"), (F.lower(text) != F.lower(old)).alias("changed"))


#: Words of a block that meets other blocks, words of it that are compared at a time, and the most letters (with their counts) that words are compared by: more share places.
BLOCK, SLICE, PLACES = 4_000, 500, 1_024


def _bags(words: pa.Array, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the words; and of each letter its word, and its number with how many times it stood up to there."""
    letters, first = blocks.characters(words)
    word = np.repeat(np.arange(len(words)), np.diff(first))
    order = np.lexsort((letters, word))
    word, letters = word[order], letters[order].astype(np.int64)
    new = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(letters, prepend=-1) != 0))
    place = np.arange(len(word)) - np.repeat(new, np.diff(new, append=len(word)))
    return np.diff(first), word, letters * base + place


def _similar(asked: pa.Array, known: pa.Array, least: float) -> Iterator[pa.RecordBatch]:
    """word, candidate, r of two blocks of words. Letters in common, each as often as both have it, bound the ratio: one product for all words of a slice; matching blocks decide."""
    base = 1 + int(max(pc.max(pc.utf8_length(w)).as_py() for w in (asked, known)))
    (len_a, word_a, bag_a), (len_b, word_b, bag_b) = (_bags(w, base) for w in (asked, known))
    shared = np.intersect1d(bag_a, bag_b)

    def matrix(n: int, word: np.ndarray, bag: np.ndarray) -> np.ndarray:
        in_both = np.isin(bag, shared)
        out = np.zeros((n, max(1, min(len(shared), PLACES))), np.float32)
        np.add.at(out, (word[in_both], np.searchsorted(shared, bag[in_both]) % PLACES), 1)
        return out

    a, b = matrix(len(asked), word_a, bag_a), matrix(len(known), word_b, bag_b).T
    for at in range(0, len(asked), SLICE):
        i, j = np.nonzero(2.0 * (a[at : at + SLICE] @ b) >= least * (len_a[at : at + SLICE, None] + len_b) - 1e-6)
        for to in range(0, len(i), 50_000):
            word, candidate = asked.take(pa.array(i[to : to + 50_000] + at)), known.take(pa.array(j[to : to + 50_000]))
            r = blocks.ratios(*blocks.characters(candidate), *blocks.characters(word))
            full = pa.array(r >= least)
            yield pa.RecordBatch.from_arrays([word.filter(full), candidate.filter(full), pa.array(r).filter(full)], ["word", "candidate", "r"])


def similar_pairs(words: DataFrame, vocabulary: DataFrame, least: float) -> DataFrame:
    """word, candidate, r: pairs whose matching-block ratio is `least` (over 0.5) and more; words of three letters and more.

    A ratio that high bounds how much longer one word may be, so words meet by levels of length, each level in blocks of some BLOCK words. Pairs of blocks are
    dealt to tasks, whatever their level; a pair of words never moves before its letters in common allow the ratio."""
    if least <= 0.5:
        raise ValueError("a ratio of one half and less needs no two letters in common")
    span = least / (2 - least)
    step = max(math.log(1 / span), 0.05)
    level = lambda n: F.ln(n) / step
    asked, known = (d.select("word").distinct().filter(F.length("word") >= 3) for d in (words, vocabulary))
    n = F.length("word")
    reach = F.sequence(F.floor(level(n * span) - 1e-9), F.floor(level(n / span) + 1e-9))

    def packed(d: DataFrame, name: str) -> DataFrame:
        shards = d.groupBy("level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shards"))  # a row for each level
        dealt = d.join(F.broadcast(shards), "level").groupBy("level", F.pmod(F.xxhash64("word"), "shards").alias("shard"))
        return dealt.agg(F.collect_list("word").alias(name)).select("level", name)  # of some BLOCK words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from _similar(*(b.column(c).slice(k, 1).flatten().cast(pa.string()) for c in ("asked", "known")), least)

    met = packed(asked.select(F.explode(reach).alias("level"), "word"), "asked").join(packed(known.select(F.floor(level(n)).alias("level"), "word"), "known"), "level")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.select("asked", "known").repartition(parts).mapInArrow(run, "word string, candidate string, r double")


_WORD = "\\p{L}\\p{N}\\p{M}_"


def snapped(tokens: DataFrame, vocabulary: DataFrame, replacements: DataFrame, keys: list[str], least: float = 0.72) -> DataFrame:
    """keys, k, token: each word's fixed replacement, else the vocabulary word most similar to it at `least` and more, the last in order of equals.

    A word is a token's letters, digits and hyphens in lower case; under four characters it stays. A token that starts with a capital gets one, and marks at its edges
    come back. Each distinct word is asked once."""
    clean = F.lower(F.regexp_replace("token", f"[^{_WORD}-]", ""))
    t = tokens.withColumn("word", F.when(F.length(clean) >= 4, clean))
    asked = t.filter("word is not null").select("word").distinct()
    fixed = asked.join(replacements.select("word", F.col("replacement").alias("best")), "word")
    free = asked.join(fixed.select("word"), "word", "left_anti")
    # only the word itself has a ratio of 1
    known = vocabulary.select("word").distinct()
    own = free.join(known, "word", "left_semi").select("word", F.col("word").alias("best"))
    near = similar_pairs(free.join(known, "word", "left_anti"), known, least)
    best = fixed.unionByName(own).unionByName(near.groupBy("word").agg(F.max_by("candidate", F.struct("r", "candidate")).alias("best")))
    named = t.filter("word is not null").join(best, "word", "left")
    first = F.substring("token", 1, 1)
    shown = F.when((first == capital(first)) & (first != F.lower(first)), F.concat(capital(F.substring("best", 1, 1)), F.lower(F.substr("best", F.lit(2))))).otherwise(F.col("best"))
    edges = F.concat(F.regexp_extract("token", f"^([^{_WORD}]*)", 1), shown, F.regexp_extract("token", f"([^{_WORD}]*)$", 1))
    return named.select(*keys, "k", F.coalesce(edges, "token").alias("token")).union(t.filter("word is null").select(*keys, "k", "token"))


#: A single letter with a full stop, or question marks, which recognition makes of noise.
DEBRIS = "(?<![\\p{L}\\p{N}_])(\\p{L}\\.|\\?\\?+)(?=[\\p{L}\\p{N}_])"


def _tidy(t: Column, debris: str) -> Column:
    """Debris and quotation marks off, bars off both ends and doubled ones to one, repeated marks to one; a line of one letter or digit and less is blank, unless it is a number."""
    s = F.regexp_replace(F.regexp_replace(t, debris, ""), "[\"'«»]", "")
    s = F.regexp_replace(F.regexp_replace(s, "\\s*\\|\\s*$", ""), "^\\s*\\|\\s*", "")
    s = F.regexp_replace(s, "\\s*\\|\\s*\\|\\s*", " | ")
    for mark in (",", "\\.", ":", ";"):
        s = F.regexp_replace(s, f"\\s*{mark}\\s*{mark}+", mark[-1])
    s = strip(F.regexp_replace(s, "\\s+", " "))
    return F.when((F.length(F.regexp_replace(s, f"[^{_WORD}]", "")) <= 1) & ~s.rlike("^\\p{Nd}+$"), "").otherwise(s)


def bound_lines(lines: DataFrame, vocabulary: DataFrame, replacements: DataFrame, phrases: list[tuple[str, str]], keys: list[str], least: float = 0.72, debris: str = DEBRIS) -> DataFrame:
    """keys, text: the first phrase rule (pattern, from the start of the line; phrase) that a line without debris matches, else the line with its words snapped and its marks tidied.

    keys tell lines apart. A null or blank line is blank. Lines with a phrase are not asked word by word."""
    s = strip(F.regexp_replace(F.coalesce("text", F.lit("")), debris, ""))
    d = lines.select(F.struct(*keys).alias("_line"), s.alias("s")).withColumn("phrase", first_rule(F.col("s"), [(f"^(?:{p})", r) for p, r in phrases], F.lit(None).cast("string")))
    tokens = d.filter("phrase is null and s <> ''").select("_line", F.posexplode(F.split("s", "\\s+")).alias("k", "token"))
    parts = F.sort_array(F.collect_list(F.struct("k", "token")))  # of one line
    joined = snapped(tokens, vocabulary, replacements, ["_line"], least).groupBy("_line").agg(F.array_join(F.transform(parts, lambda x: x["token"]), " ").alias("words"))
    return d.join(joined, "_line", "left").select("_line.*", F.coalesce("phrase", _tidy(F.coalesce("words", F.lit("")), debris)).alias("text"))
