"""Column functions over the text of a line: no UDF, so code generation stays on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a formula, a heading word, and a connector that should not end a line.
MATH_MARKS = ("=", "+", "^", "√", "∑", "∫", "≤", "≥", "≠", "≈", "π", "∞", "→")
HEADINGS = ("chapter", "section", "theme", "lecture", "kapitel", "chapitre", "capítulo")
CONNECTORS = ("of", "the", "and", "de", "la", "und", "der", "et", "y")
#: Margin noise that is cut off line ends, in this order.
NOISE = ("^[|/\\\\]+", "[|/\\\\]+$", "^[.,;]+", "^[_~]+", "[_~]+$", "^\\d{1,2}\\s*\\|")
#: What a text starts and ends with where strip() or one of those finds something: at the end also what a pattern's end may stand before.
NOISE_FIRST, NOISE_LAST = "[\\s|/\\\\.,;_~\\d]", "[\\s|/\\\\_~\\x{85}\\x{2028}\\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an outer expression inside a lambda is computed for each element, and a repeated one each time."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def strip(t: Column) -> Column:
    """Without white space at both ends, as a language's strip() would, not spaces alone."""
    return F.regexp_replace(t, "^\\s+|\\s+$", "")


def count_contained(t: Column, marks: tuple[str, ...]) -> Column:
    """How many of the marks the text contains, each counted once."""
    total = F.lit(0)
    for m in marks:
        total = total + F.when(F.contains(t, F.lit(m)), 1).otherwise(0)
    return total


def line_type(t: Column, height: Column, average: Column) -> Column:
    """empty, math, h1, h2, bullet or paragraph; the first that holds."""
    s = strip(t)
    marks = count_contained(s, MATH_MARKS)
    return (
        F.when(s == "", "empty")
        .when((marks >= 2) | ((marks >= 1) & (F.contains(s, F.lit("=")) | F.contains(s, F.lit("^")))), "math")
        .when((height > average * 1.35) & (F.length(s) < 60), "h1")
        .when(F.lower(s).rlike(f"^({'|'.join(HEADINGS)})([^\\p{{L}}]|$)") | s.rlike("^\\d+(\\.\\d+)*\\s+\\p{Lu}"), "h2")
        .when(s.endswith(":") & (F.length(s) < 50), "h2")
        .when(s.rlike("^[-*•–—]\\s+") | s.rlike("^\\d+[.)]\\s+") | s.rlike("^\\p{L}[.)]\\s+"), "bullet")
        .otherwise("paragraph")
    )


def indent(x: Column, least_x: Column, step: int = 35, most: int = 4) -> Column:
    return F.least(F.floor(F.greatest(x - least_x, F.lit(0)) / step), F.lit(most)).cast("int")


def informative(t: Column) -> Column:
    """Not blank, and more than one letter or digit unless it is all digits."""
    s = strip(t)
    return (s != "") & ((F.length(F.regexp_replace(s, "[^\\p{L}\\p{N}]", "")) > 1) | s.rlike("^\\p{Nd}+$"))


def clean_noise(t: Column) -> Column:
    """Margin noise off both ends, doubled bars to one, white space to single spaces."""

    def cut(x: Column) -> Column:
        x = strip(x)
        for pattern in NOISE:
            x = strip(F.regexp_replace(x, pattern, ""))
        return x

    def spaced(x: Column) -> Column:
        bars = strip(F.regexp_replace(F.regexp_replace(x, "\\s*\\|\\s*\\|\\s*", " | "), "\\s+", " "))
        return F.when(F.contains(x, F.lit("|")), bars).when(x.rlike("[^\\S ]|  "), F.regexp_replace(x, "\\s+", " ")).otherwise(x)

    # a text is gone over again only if an end of it, or a mark in it, can be noise
    ends = lambda x: F.substring(x, 1, 1).rlike(NOISE_FIRST) | F.substring(x, -1, 1).rlike(NOISE_LAST)
    return let(t, lambda x: let(F.when(ends(x), cut(x)).otherwise(x), spaced))


#: Letters whose upper case is several letters, and the one letter that stands for it: itself, if there is none.
_SEVERAL = "".join(c for c in map(chr, range(0x110000)) if len(c.upper()) > 1)
_ONE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL)


def capital(c: Column) -> Column:
    """Upper case of one character, as one character: that of ß is ẞ, not SS."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, _SEVERAL, _ONE)).otherwise(F.upper(c))


def capitalize_sentences(t: Column) -> Column:
    """First letter, and first letter after a full stop, exclamation or question mark and white space, to upper case."""
    parts = F.split(t, "(?<=[.!?]\\s)")
    return F.array_join(F.transform(parts, lambda p: F.concat(capital(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def repetitive(t: Column) -> Column:
    """Three equal words in a row (the last triple is not asked), or a piece of two and more characters four times on end."""
    def triple(w: Column) -> Column:
        n = F.size(w)
        run = F.exists(F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0))), lambda i: (w[i] == w[i + 1]) & (w[i] == w[i + 2]))
        return F.when(n >= 4, run).otherwise(F.lit(False))

    return let(F.filter(F.split(strip(t), "\\s+"), lambda x: x != ""), triple) | t.rlike("(\\S{2,})\\1{3,}")


def edge_stripped_words(t: Column) -> Column:
    words = F.transform(F.split(strip(t), "\\s+"), lambda w: F.regexp_replace(w, "^[.,;:!?()\\-\"']+|[.,;:!?()\\-\"']+$", ""))
    return F.filter(words, lambda w: w != "")


def calibrated(t: Column, confidence: Column, n_words: Column, n_valid: Column) -> Column:
    """Confidence by the share of valid words, less penalties for junk, in 0.10 .. 0.99; without words 0.10 .. 0.35; blank 0."""
    ratio = n_valid / F.greatest(n_words, F.lit(1))
    dots = F.length(t) - F.length(F.replace(t, F.lit(".")))
    penalty = (
        F.when(t.rlike("[|/\\\\]"), 0.15).otherwise(0.0)
        + F.when(F.contains(t, F.lit("I.")), 0.15).otherwise(0.0)
        + F.when((dots >= 3) & (n_words >= 3) & (dots / F.greatest(n_words, F.lit(1)) > 0.35), 0.20).otherwise(0.0)
        + F.when(ratio < 0.4, 0.25).otherwise(0.0)
    )
    value = F.greatest(F.lit(0.10), F.least(F.lit(0.99), confidence * 0.25 + confidence * 0.75 * ratio - penalty))
    return F.when(strip(t) == "", 0.0).when(n_words == 0, F.greatest(F.lit(0.10), F.least(F.lit(0.35), confidence * 0.4))).otherwise(value)


def valid_shape(w: Column) -> Column:
    """Words that count as valid without a lexicon: digits, single characters, and formula-like ones of three and more."""
    return w.rlike("^\\p{Nd}+$") | (F.length(w) == 1) | ((F.length(w) >= 3) & w.rlike("[$=+\\-_^{}()\\\\/]"))


def arbitrate(a: Column, ca: Column, b: Column, cb: Column, loop_a: Column, loop_b: Column, valid_a: Column, total_a: Column, valid_b: Column, total_b: Column) -> Column:
    """struct(text, conf, reason) of two recognisers' readings, in strict order of the eight cases."""
    a, b = strip(a), strip(b)
    ra, rb = valid_a / F.greatest(total_a, F.lit(1)), valid_b / F.greatest(total_b, F.lit(1))

    def out(text: Column, conf: Column, reason: str) -> Column:
        return F.struct(text.alias("text"), conf.cast("double").alias("conf"), F.lit(reason).alias("reason"))

    return (
        F.when((a == "") & (b != ""), out(b, cb, "second_only"))
        .when((b == "") & (a != ""), out(a, ca, "first_only"))
        .when((a == "") & (b == ""), out(F.lit(""), F.lit(0.0), "both_empty"))
        .when(loop_a & ~loop_b, out(b, F.greatest(cb, F.lit(0.75)), "first_loops"))
        .when(ca >= 0.88, out(a, ca, "first_confident"))
        .when((rb > ra + 0.35) & (valid_b >= 2) & (cb >= 0.65), out(b, ca * 0.3 + cb * 0.7, "second_lexical"))
        .when(F.lower(a) == F.lower(b), out(a, F.least(F.lit(0.98), F.greatest(ca, cb) + 0.06), "agreement"))
        .otherwise(out(F.when(ca * 0.65 >= cb * 0.35, a).otherwise(b), ca * 0.6 + cb * 0.4, "weighted"))
    )


def user_id(name: Column) -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(strip(name), "[^\\p{L}\\p{N}_-]", "_")), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "user").otherwise(s)


def file_name(path: Column, default: str = "file") -> Column:
    s = F.regexp_extract(F.regexp_replace(path, "\\\\", "/"), "([^/]*)$", 1)
    s = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]", "_"), "^\\.+", "")
    return F.when(s == "", default).otherwise(s)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def allowed_extension(path: Column, allowed: tuple[str, ...]) -> Column:
    return extension(path).isin(*allowed)


def under_root(path: Column, root: str) -> Column:
    """Whether a normalised path lies under root: no step up, and root or a child of it."""
    return ~path.rlike("(^|/)\\.\\.(/|$)") & ((path == root) | F.startswith(path, F.lit(root.rstrip("/") + "/")))


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def clean_transcription(t: Column) -> Column:
    return strip(F.regexp_replace(t, "\\s+", " "))


def keep_characters(t: Column, vocabulary: str) -> Column:
    """Only the characters of the vocabulary."""
    known = F.array(*[F.lit(c) for c in vocabulary])
    return F.array_join(F.filter(F.split(t, ""), lambda c: F.array_contains(known, c)), "")


def encode(t: Column, vocabulary: str, unknown: int = 1) -> Column:
    """Ids of the characters: 0 is blank, 1 unknown, then the vocabulary's from 2 on."""
    whole = F.lit(vocabulary)
    ids = F.transform(F.split(t, ""), lambda c: F.when(F.position(c, whole) > 0, F.position(c, whole) + 1).otherwise(unknown))
    return F.when(t == "", F.array().cast("array<int>")).otherwise(ids)


def decode(ids: Column, vocabulary: str) -> Column:
    """Characters of ids; blank, unknown and ids out of range have none."""
    known = F.array(F.lit(""), F.lit(""), *[F.lit(c) for c in vocabulary])
    return F.array_join(F.transform(ids, lambda i: F.get(known, i)), "")


def normalized(t: Column) -> Column:
    """Lower case, letters, digits and single spaces only: what token metrics compare."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " "))


def metric_tokens(t: Column, least: int = 3) -> Column:
    return F.filter(F.split(normalized(t), " "), lambda w: F.length(w) >= least)


def token_recall(truth: Column, found: Column) -> Column:
    a, b = F.array_distinct(metric_tokens(truth)), F.array_distinct(metric_tokens(found))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def highlighted(t: Column, uncertain: Column) -> Column:
    """Words of the list in marks."""
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.when(F.array_contains(uncertain, w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")


def tidy_page(t: Column) -> Column:
    """Rules collapsed, lines of up to three marks or digits dropped, runs of blank lines squeezed to one."""
    s = F.regexp_replace(t, "[_=~-]{3,}", " ")
    kept = F.filter(F.split(s, "\n"), lambda l: ~F.regexp_like(l, F.lit("^[^A-Za-z_]{1,3}$")))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / (1024 * 1024), 1).cast("string"), F.lit(" MB")))


def saved_percent(original: Column, one: Column, other: Column) -> Column:
    """Percent that the smaller of two encodings saves, 0 at least."""
    return F.greatest(F.lit(0.0), (1 - F.least(one, other) / F.nullif(original, F.lit(0))) * 100)


def rewrite(t: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered pattern rules; what one gives feeds the next."""
    for pattern, replacement in rules:
        t = F.regexp_replace(t, pattern, replacement)
    return t


def first_rule(t: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The replacement of the first rule whose pattern is found."""
    out = None
    for pattern, replacement in rules:
        out = (F if out is None else out).when(t.rlike(pattern), F.lit(replacement))
    return otherwise if out is None else out.otherwise(otherwise)


def columns_bound(t: Column) -> Column:
    """Parts of a line between bars, those of two letters and fewer dropped, each cleaned."""
    parts = F.filter(F.split(t, "\\s\\s\\|\\s\\s"), lambda p: F.length(F.regexp_replace(p, "[^\\p{L}]", "")) > 2)
    return F.array_join(F.transform(parts, clean_noise), "  |  ")


def json_found(t: Column, schema: str) -> Column:
    """The JSON object in a reply: the whole, else a fenced block, else the widest braces."""
    whole = F.regexp_extract(t, "^\\s*(\\{[\\s\\S]*\\}|\\[[\\s\\S]*\\])\\s*$", 1)
    fenced = F.regexp_extract(t, "```(?:json)?\\s*([\\s\\S]*?)```", 1)
    braces = F.regexp_extract(t, "(\\{[\\s\\S]*\\})", 1)
    candidates = F.filter(F.array(whole, fenced, braces), lambda x: (x != "") & F.expr("true"))
    good = F.filter(candidates, lambda x: F.try_parse_json(x).isNotNull())
    return F.from_json(F.try_element_at(good, F.lit(1)), schema)


def artifact_url(root: str, document: Column, page: Column, name: str) -> Column:
    """Address of a page's artifact, from ids alone."""
    return F.concat(F.lit(root.rstrip("/") + "/"), document.cast("string"), F.lit("/pages/"), page.cast("string"), F.lit("/" + name))


def replace_subject_terms(t: Column, subject: Column, rules: dict[str, list[tuple[str, str]]]) -> Column:
    """Ordered rules of a line's subject; lines of a subject without rules stay."""
    out = None
    for name, own in rules.items():
        out = (F if out is None else out).when(subject == name, rewrite(t, own))
    return t if out is None else out.otherwise(t)


def bound(t: Column, phrases: list[tuple[str, str]]) -> Column:
    """Noise off; the first phrase rule that matches gives the whole line; else marks are spaced, and a line of one character is blank."""
    s = clean_noise(t)
    spaced = strip(F.regexp_replace(F.regexp_replace(s, "\\s+([.,;:!?])", "$1"), "([,;])(\\p{L})", "$1 $2"))
    return first_rule(s, phrases, F.when(F.length(spaced) <= 1, "").otherwise(spaced))
