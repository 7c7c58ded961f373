"""Quality rules as a short-circuit cascade of native column expressions.

Each rule says which documents it rejects. A bounded sample gives each rule's
cost (time over the sample) and selectivity (share rejected); the cascade asks
the rule with the most rejections per cost first, and a document that one rule
rejects is not asked again. The order changes the cost only, never the verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialize

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window, and the share of words in repeated windows, in hundredths, beyond which a text fails.
WINDOW, MOST_REPEATED, LEAST_WORDS = 8, 30, 20
#: Rows of the sample on which rules are measured, about, and how often each is timed after a warm-up.
SAMPLE, TIMINGS = 1000, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between spaces, tabs and line breaks. Splitting at a single character needs no pattern matching; texts with tabs and the like, which few have, are split by pattern."""
    rare = F.lit(False)
    for c in "\t\x0b\f\r":
        rare = rare | F.contains(text, F.lit(c))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(rare, F.split(text, SPACES)).otherwise(plain), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def count_symbols(text: Column) -> Column:
    """Symbols are single bytes, so the bytes that go with them count them."""
    left = text
    for c in SYMBOLS:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def with_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def count_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), with_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(grams: Column, width: int) -> Column:
    """Words inside the windows whose hash stands twice or more: sort (hash, place), keep equal neighbours, then add up the gaps."""

    def places(s: Column) -> Column:
        last = F.size(s) - 1

        def repeated(x: Column, k: Column) -> Column:
            return ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"]))

        return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def total(p: Column) -> Column:
        last = F.size(p) - 1
        gaps = F.transform(p, lambda x, k: F.when(k < last, F.least(F.lit(width), p[F.least(k + 1, last)] - x)).otherwise(F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    s = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(s, places), total)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in `width`-word windows that the list has twice or more, the first included. O(n log n) in the words."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))

    def repeats(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g, width))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < width + 1, F.lit(0)).otherwise(let(windows(h), repeats))).cast("long")


@dataclass(frozen=True)
class Facts:
    """What rules ask about a document: expressions, each computed only where a rule asks for it, or columns that are there."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


def facts(text: Column, words: Column) -> Facts:
    return Facts(text, F.size(words).cast("long"), word_chars(words), count_symbols(text), count_dup_lines(text), repeat_words(words))


@dataclass(frozen=True)
class Rule:
    """rejects(facts) is true for a document to go. base rules are part of every verdict."""

    name: str
    rejects: Callable[[Facts], Column]


def _text_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), with_word))


RULES = (
    Rule("few_words", lambda f: f.n_words < LEAST_WORDS),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > MOST_REPEATED * f.n_words),
    Rule("symbols", lambda f: 100 * f.n_symbols > 20 * f.n_words),
    Rule("capitals", lambda f: 2 * F.length(F.regexp_replace(f.text, "[^\\p{Lu}]+", "")) > f.word_chars),
    Rule("dup_lines", lambda f: let(_text_lines(f.text), lambda n: (n > 3) & (100 * f.n_dup_lines > 50 * n))),
    Rule("word_length", lambda f: let(f.word_chars, lambda c: (c > 30 * f.n_words) | (10 * c < 15 * f.n_words))),
)
BASE = ("few_words", "repeats")


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float


def sampled(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """text, words of about `rows` rows from all over docs, which a hash of the doc_id picks; all rows if there are no more. Rows without an id are in with one in `rows` chance each by their text's length."""
    share = max(1, math.ceil(docs.count() / rows))
    picked = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.octet_length("text").cast("string"), F.lit("")).alias("k"))
    picked = picked.filter(F.pmod(F.xxhash64("k", F.lit("rules")), F.lit(share)) == 0).limit(2 * rows)
    return materialize(picked.select("text", words_of(F.col("text")).alias("words")), "rule-sample", 1)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE) -> list[Measured]:
    """Cost in seconds and share rejected of each rule on the sample, best ratio first. Words are split before, once for all rules; the first of a rule's runs compiles it and is not timed."""
    sample = sampled(docs, rows)
    asked = facts(F.col("text"), F.col("words"))

    def timed(reject: Column) -> tuple[float, float]:
        query = sample.agg(F.count(F.lit(1)), F.sum(reject.cast("long")))
        took = []
        for _ in range(TIMINGS + 1):
            began = time.perf_counter()
            n, out = query.first()
            took.append(time.perf_counter() - began)
        return median(took[1:]), (out or 0) / max(n, 1)

    empty = timed(F.size("words") < 0)[0]
    found = []
    for rule in rules:
        took, share = timed(rule.rejects(asked))
        found.append(Measured(rule, max(took - empty, 1e-3), share))
    return sorted(found, key=lambda m: -(m.rejected / m.cost))


def _passes(order: list[Measured], f: Facts) -> Column:
    out = None
    for m in order:
        hit = m.rule.rejects(f)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def cascade(order: list[Measured], text: Column) -> Column:
    """True for documents that no rule rejects; the first rule that rejects ends the questions. The text is split into words once."""
    return let(words_of(text), lambda w: _passes(order, facts(text, w)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that every rule lets pass, all columns as they are.

    A null text counts as empty and fails by its words. Rows that repeat share their verdict."""
    return docs.filter(cascade(measure(docs, rules), F.coalesce("text", F.lit(""))))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of docs.

    Null text: as empty, so 0 throughout and base_failed. A null doc_id stays null. Rows that repeat come
    out as often as they come in. An empty table gives no rows. Other columns are not read."""
    text = F.col("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counts = let(words_of(text), lambda w: F.struct(*[getattr(facts(text, w), n).alias(n) for n in names]))
    counted = own.select("doc_id", "text", counts.alias("c"))
    known = Facts(text, *[F.col(f"c.{n}") for n in names])
    rest = measure(docs, tuple(r for r in rules if r.name not in BASE))
    base = (known.n_words < LEAST_WORDS) | (100 * known.n_repeat_words > MOST_REPEATED * known.n_words)
    return counted.select("doc_id", *[F.col(f"c.{n}").alias(n) for n in names], base.alias("base_failed"), F.when(base, F.lit(False)).otherwise(_passes(rest, known)).alias("kept"))
