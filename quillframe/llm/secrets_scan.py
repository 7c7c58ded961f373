"""Secret scans: fixed patterns, and a randomness test battery for all other opaque strings.

Patterns give spans of the kinds assign, access and hex. Every run of 20
and more characters of an encoding alphabet in what they leave over is a candidate, and so are
the runs in it of each base64 alphabet and of letters and digits alone: a key in a path or URL is tested
without the path. Of found spans the outermost stay. A candidate's encoding is
inferred from its letters and digits, and the tests that apply to it compare it with what structured
text of its length would give:

* chi-squared distance of its letters from a uniform use of the alphabet,
* runs of character classes (letters and digits, and capitals after small letters), where the alphabet has several,
* serial correlation: how likely each letter is after the one before.

What structured text is, the corpus says: neighbouring letters are counted over all texts first, and give
the letters' frequencies and the mean and spread of the serial test. Fixed words of a few languages weigh in, for corpora that say little.

Each test gives a p-value under the hypothesis "structured text", so a small one speaks for randomness; Stouffer's
method combines them. Structured text of short strings is close to uniform by
chance, which the tests' spread by length carries. Candidates of like
length and encoding form classes, and in each class the Benjamini-Hochberg step-up rule over all candidates of the
corpus holds the false-discovery rate. P-values are compared by bins of their
exponent, so the rule needs one bounded table of counts and no sort.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm import kernels as K
from quillframe.llm.common import chunks, keyed, map_batches, materialize, own_id

#: Fixed patterns, in the order of their kinds; the least length of what must be long enough.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: What is tested besides a whole candidate.
PIECES = tuple(re.compile(rf"[{x}]{{20,}}={{0,2}}") for x in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))

#: Alphabets by name: inferred in this order, the smallest that holds all letters and digits.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Under structured text without counts: excess of the squared frequencies over uniform times the alphabet's size (letters of one case: in words), and the correlation of neighbours' places.
STRUCTURED_EXCESS, ONE_CASE_EXCESS, STRUCTURED_CORRELATION = 2.4, 0.7, 0.35
#: The chance that a neighbour is of another class: where capitals may begin words, and otherwise.
CHANGE_MIXED, CHANGE = 0.17, 0.12
#: Alphabets of one case: no classes to run by.
ONE_CASE = ("lower", "upper")
#: Words run together and names are less regular than words: share of the serial test's mean, times its spread; bounds of one letter's score in bits.
RUN_TOGETHER, WIDER, SCORE = 0.75, 1.5, 4.0
#: How many neighbours of each letter are those of text at large; with so few counted pairs the spread is twice as wide.
SMOOTH, FEW = 10.0, 2000.0
#: Words that weigh in with the corpus (common ones of English, German, French and Spanish).
COMMON = (
    "about after again because before between could different during every first found great house little might never other people place should small something still their there these thing think those three through under water where which while without work world would write "
    "aber alles auch durch einen gegen haben immer jetzt kein leben machen nach nicht noch oder ohne sein schon sehr sich sind viele wenn werden zeit zwischen "
    "alors autre avant avec beaucoup bien comme dans depuis encore entre faire grand homme leur maison monde nous petit peut pour quand sans sous temps toujours tout vous "
    "ahora antes bueno cada cuando desde donde ella entonces entre esta hacer hombre mismo mucho nada otro para pero poco porque siempre sobre tiempo todo vida"
).split()
#: False-discovery rate, and length classes' growth: a class holds lengths of a factor of 2.
RATE = 0.001
_BINS = 60
CHUNK = 4 << 20


@dataclass(frozen=True)
class Structure:
    """Counts of neighbouring letters (26 by 26) of structured text; None: fixed guesses stand in."""

    pairs: np.ndarray | None = None

    def among(self, letters: str) -> tuple[np.ndarray, float, float, np.ndarray]:
        """Of some letters: scores of each pair (bits over a uniform next letter), their mean and spread in the text, and the letters' frequencies."""
        at = [ord(c) - 97 for c in letters]
        n = self.pairs[np.ix_(at, at)] + 0.01
        n = n + SMOOTH * n.sum(axis=0) / n.sum()  # a letter after a rare one: as letters are in general
        score = np.clip(np.log2(n / n.sum(axis=1, keepdims=True) * len(at)), -SCORE, SCORE)
        share = n / n.sum()
        mean = float((share * score).sum())
        spread = math.sqrt(max(float((share * score**2).sum()) - mean**2, 0.05)) * (1 + math.sqrt(FEW / max(float(self.pairs.sum()), 1.0)))
        return score, mean, spread, n.sum(axis=1) / n.sum()


def prior() -> np.ndarray:
    n = np.zeros((26, 26))
    for word in COMMON:
        for a, b in zip(word, word[1:], strict=False):
            n[ord(a) - 97, ord(b) - 97] += 1
    return n


def encoding(s: str) -> str | None:
    chars = set(s)
    return next((k for k, a in ALPHABETS.items() if chars <= set(a)), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _uniform(counts: np.ndarray, n: int, excess: float, spread: float = 0.5) -> float:
    """z of the chi-squared distance from uniform under structured text whose distance grows by `excess` a character."""
    size = len(counts)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    shift = n * excess * spread
    return (size - 1 + shift - chi) / math.sqrt(2 * (size - 1) + 4 * shift)


def _runs(kind: list[int], expected: float, initials: bool) -> float:
    """z of the changes of class (0 small letters, 1 capitals, 2 digits); with initials a small letter may follow a capital without a change."""
    n = len(kind) - 1
    changes = sum(a != b and not (initials and a == 1 and b == 0) for a, b in zip(kind, kind[1:], strict=False))
    return (changes - 0.5 - n * expected) / math.sqrt(n * expected * (1 - expected))


def tests(s: str, name: str, structure: Structure) -> list[float]:
    """z of each test that applies to a string of letters and digits of this encoding; large for a random one."""
    alphabet = ALPHABETS[name]
    letters = "".join(sorted({c.lower() for c in alphabet if c.isalpha()}))
    if structure.pairs is None:
        at = np.array([alphabet.index(c) for c in s], dtype=np.float64)
        counts = np.bincount(at.astype(int), minlength=len(alphabet))
        if name in ONE_CASE:
            return [_uniform(counts, len(s), ONE_CASE_EXCESS)]
        r = float(np.corrcoef(at[:-1], at[1:])[0, 1]) if at[:-1].std() and at[1:].std() else 1.0
        return [_runs([0 if c.islower() else 1 if c.isupper() else 2 for c in s], CHANGE, False), _uniform(counts, len(s), STRUCTURED_EXCESS), (STRUCTURED_CORRELATION - r) * math.sqrt(len(s) - 1)]
    mixed = name.startswith("base64")
    zs = [] if name in ONE_CASE else [_runs([2 if c.isdigit() else 1 if mixed and c.isupper() else 0 for c in s], CHANGE_MIXED if mixed else CHANGE, True)]
    score, mean, spread, share = structure.among(letters)
    at = np.array([letters.index(c.lower()) if c.isalpha() else -1 for c in s])
    inside = at[at >= 0]
    if len(inside) >= 2 * len(letters) ** 0.5:
        zs.append(_uniform(np.bincount(inside, minlength=len(letters)), len(inside), len(letters) * float((share**2).sum()) - 1, 1.0))
    # a capital after a small letter starts a word
    next_to = (at[:-1] >= 0) & (at[1:] >= 0) & ~np.array([a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)], dtype=bool)
    k = int(next_to.sum())
    if k >= 4:
        total = float(score[at[:-1][next_to], at[1:][next_to]].sum())
        zs.append((RUN_TOGETHER * mean * k - total) / (WIDER * spread * math.sqrt(k)))
    return zs


def combined(s: str, structure: Structure = Structure()) -> tuple[str, float] | None:  # noqa: B008
    """Encoding of a candidate and its combined p-value; None if it has fewer than 8 different characters or letters and digits of no alphabet, or digits alone (numbers are not secrets)."""
    body = s.rstrip("=")
    if len(set(body)) < 8 or not any(c.isalpha() for c in body):
        return None
    plain = re.sub("[+/_-]", "", body)
    name = encoding(plain)
    if name is None or len(plain) < 8:
        return None
    zs = tests(plain, name, structure)
    return name, _upper(sum(zs) / math.sqrt(len(zs))) if zs else 1.0


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """How often each two letters follow each other within words of all texts (keyed rows), case aside; a capital after a small letter starts a word, and longer runs of one letter are not counted. 676 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(676, np.int64)
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            folded = K.fold(data)
            letter = (folded >= 97) & (folded <= 122)
            ok = letter[:-1] & letter[1:]
            ok &= ~((data[:-1] >= 97) & (data[1:] < 97))
            ok[1:] &= ~((folded[1:-1] == folded[:-2]) & (folded[1:-1] == folded[2:]))
            edge = offsets[1:-1] - 1
            ok[edge[(edge >= 0) & (edge < len(ok))]] = False
            at = np.flatnonzero(ok)
            n += np.bincount((folded[at].astype(np.int64) - 97) * 26 + folded[at + 1] - 97, minlength=676)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["pair", "n"])

    out = np.zeros(676)
    for r in map_batches(docs.select("text"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(26, 26)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; kind by its place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]], structure: Structure = Structure()) -> list[tuple[int, int, str, int]]:  # noqa: B008
    """(start, end, class, bin) of the opaque strings in what the fixed patterns leave over, and of their pieces. bin: -log2 of the p-value."""
    free, at = [], 0
    for a, _, b in base:
        if a > at:
            free.append((at, a))
        at = max(at, b)
    free.append((at, len(text)))
    spans = {}
    for a, b in free:
        for m in CANDIDATE.finditer(text, a, b):
            spans[m.span()] = None
            for piece in PIECES:
                spans |= dict.fromkeys(x.span() for x in piece.finditer(text, *m.span()))
    out = []
    for s, e in spans:
        got = combined(text[s:e], structure)
        if got:
            out.append((s, e, f"{got[0]}:{(e - s).bit_length()}", min(_BINS, int(-math.log2(max(got[1], 1e-300))))))
    return out


_SCANNED = "_id long, _sum long, base array<struct<s:int,k:int,e:int>>, more array<struct<s:int,e:int,c:string,b:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """_SCANNED rows, one for each row of docs. Written to the shared folder: it holds no texts."""
    rows = keyed(docs)
    structure = Structure(letter_pairs(rows) + prior())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("c", pa.string()), ("b", pa.int32())]))]
        for b in chunks(batches, CHUNK):
            texts = b.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = [candidates(t, x, structure) for t, x in zip(texts, base, strict=True)]
            columns = [
                b.column("_id"),
                b.column("_sum"),
                pa.array([[dict(zip("ske", x, strict=True)) for x in row] for row in base], kinds[0]),
                pa.array([[dict(zip("secb", x, strict=True)) for x in row] for row in more], kinds[1]),
            ]
            yield from pa.Table.from_arrays(columns, names=["_id", "_sum", "base", "more"]).to_batches()

    return materialize(map_batches(rows, run, _SCANNED), "secret-scan")


def thresholds(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """c, least_bin of each class with discoveries: candidates of that bin and higher are random. At most some 40 classes of some 60 bins.

    Step-up: the widest set of top bins whose largest p-value, times the class's candidates, is within rate times the set's size."""
    bins = scanned.select(F.explode("more").alias("m")).groupBy("m.c", "m.b").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("c").orderBy(F.col("b").desc())
    whole = Window.partitionBy("c")
    return bins.withColumn("found", F.sum("n").over(top)).withColumn("all", F.sum("n").over(whole)).filter(F.pow(F.lit(2.0), -F.col("b")) * F.col("all") <= rate * F.col("found")).groupBy("c").agg(F.min("b").alias("least_bin"))


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base, found (spans of the battery) of each row of docs.

    Null texts are empty and have no spans; a null doc_id stays null; rows that repeat come out as often as they come in, and count
    as often among the candidates. Columns other than doc_id and text are not read. An empty table gives no rows."""
    scanned = scan(docs)
    classes = {r["c"]: r["least_bin"] for r in thresholds(scanned, rate).collect()}  # bounded: alphabets x length classes
    least = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]) if classes else None
    found = F.filter("more", lambda m: m["b"] >= F.coalesce(F.try_element_at(least, m["c"]), F.lit(_BINS + 1))) if classes else F.filter("more", lambda m: F.lit(False))
    # of spans one in another the outer one
    scanned = scanned.withColumn("found", found)
    found = F.filter("found", lambda m: ~F.exists("found", lambda o: (o["s"] <= m["s"]) & (o["e"] >= m["e"]) & ((o["s"] < m["s"]) | (o["e"] > m["e"]))))
    return scanned.select(own_id().alias("doc_id"), "base", F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(3).alias("k"), m["e"].alias("e"))).alias("found"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))))


def report(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs; see find()."""

    def n(kind: int):
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    return find(docs, rate).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"))
