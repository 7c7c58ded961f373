"""Phrase collocations by language from generalised suffix automata of shards.

1. A first pass counts words, pairs and triples by 32 bits of their hash, added up over all shards. Which
   counters reach the least count is a bitmap of a fixed 16 MB; a phrase whose bit is not set is too rare to be a
   candidate or a candidate's part. Phrases that share a counter only let more through.
2. A second pass builds a suffix automaton of each shard over what the bitmap lets through, and puts out every substring
   of its states with the state's number of end positions. Counts are added up over the shards by language and phrase, as strings, so they are exact.
3. Candidates, their cuts and what subsumes them are joins on phrases: a longer phrase's suffix link and the state
   before its last word name the shorter phrases inside it.

The automaton's link tree is the trie of the pieces read backwards, so it is made by sorting end positions by the words that stand
before them; nodes with one set of end positions are one state. Substrings are read off states and links, so transitions are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm import kernels as K
from quillframe.llm import packed as P
from quillframe.llm.common import buckets, chunks, materialize

#: Words of a candidate at most, and how often it must stand.
WORDS, LEAST = 3, 10
#: Percent of a candidate's count from which a longer one subsumes it.
SUBSUMED = 50
TOP = 2000
#: Bits of the hash that name a counter, and of those that name a bit of the map.
COUNTER, MAP = 32, 27
#: Bytes of text of a shard. A longer text is cut between pieces.
SHARD = 5 << 20
SALTS = 64
UNKNOWN = "und"

_PIECE = K.separators((0x0A, 0x0D), *[(ord(c),) * 2 for c in ".,;:!?"])
_BLANK = _PIECE | K.separators((0x20, 0x20), (0x09, 0x09))


@dataclass
class Shard:
    """Words of some texts. code: a word's language by its place in the shard's list; lang: by a number that is the same in all shards; before: how many words stand before a word in its piece, WORDS - 1 at most."""

    data: np.ndarray
    words: K.Words
    code: np.ndarray
    lang: np.ndarray
    before: np.ndarray

    def keys(self) -> list[np.ndarray]:
        """For each number of words d + 1, the hash of those that end at each word, with the language. Where fewer stand before, it means nothing."""
        seed = K.mix(self.lang.astype(np.uint64) + K.PLACE[50])
        h = [K.mix(K.word_hash(self.data, self.words) ^ seed)]
        for d in range(1, WORDS):
            more = h[-1].copy()
            more[d:] = K.mix(h[-1][d:] * K.PLACE[51] + h[0][:-d] * K.PLACE[51 + d])
            h.append(more)
        return h


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """data, offsets, first and last document of stretches of some SHARD bytes; a text beyond that is cut where a piece ends, and a longer piece stays whole."""
    if len(data) <= 2 * SHARD:
        yield data, offsets, 0, len(offsets) - 1
        return
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            to = min(at + SHARD, end)
            while to < end:
                near = np.flatnonzero(_PIECE[data[to : to + SHARD]])
                if len(near):
                    to += int(near[0])
                    break
                to = min(to + SHARD, end)
            yield data[at:to], np.array([0, to - at]), i, i + 1
            at = to


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list[str]]]:
    """Shards with the names of their languages."""
    for t in chunks(batches, SHARD):
        data, offsets = K.texts(t.column("text"))
        coded = t.column("lang").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        # a number that a name has in every shard
        number = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
        for part, off, a, b in _cuts(data, offsets):
            part = K.fold(part)
            w = K.words(part, off, _BLANK)
            piece = np.cumsum(_PIECE[part], dtype=np.int32)[w.start] if len(w.start) else np.zeros(0, np.int32)
            doc = w.doc
            follows = np.zeros(len(w.start), bool)
            follows[1:] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
            before, run = np.zeros(len(w.start), np.int8), follows
            for _ in range(1, WORDS):
                before += run
                run = follows & np.concatenate([[False], run[:-1]]) if len(run) else run
            of = code[a:b][doc] if len(doc) else np.zeros(0, np.int64)
            yield Shard(part, w, of, number[of] if len(of) else np.zeros(0, np.uint64), before), names


def _map(docs: DataFrame, least: int) -> np.ndarray:
    """The bitmap of counters that reach `least` (or 255, if that is less): 2**MAP bits, whatever the input's size."""
    least = min(least, 255)  # a shard's counts go as bytes
    n_parts = buckets(docs, 8 << 20)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for shard, _ in _shards(batches):
            keys = np.concatenate([h[shard.before >= d] >> np.uint64(64 - COUNTER) for d, h in enumerate(shard.keys())]).astype(np.uint32)
            keys.sort()
            b = K.group_bounds(keys)
            count, keys = np.minimum(np.diff(b), least).astype(np.uint8), keys[b[:-1]]
            part = (keys.astype(np.uint64) * np.uint64(n_parts)) >> np.uint64(COUNTER)
            if len(keys):
                yield P.batch(list(P.dealt(n_parts, numbers.next(), part.astype(np.int64), keys, count)))

    def bucket(t: pa.Table) -> pa.Table:
        parts = [P.unpack(b.as_buffer().to_pybytes(), np.uint32, np.uint8) for b in t.column("blob")]
        key, count = (np.concatenate([p[k] for p in parts]) for k in range(2))
        both = key.astype(np.uint64) << np.uint64(8) | count
        del parts, key, count
        both.sort()
        b = K.group_bounds(both >> np.uint64(8))
        full = both[b[:-1]][np.add.reduceat((both & np.uint64(255)).astype(np.int64), b[:-1]) >= least]
        bits = np.unique(full >> np.uint64(8 + COUNTER - MAP))
        first = int(bits[0]) // 8 if len(bits) else 0
        own = np.zeros(8 * (int(bits[-1]) // 8 + 1 - first) if len(bits) else 0, bool)
        own[bits.astype(np.int64) - 8 * first] = True
        return pa.table({"first": pa.array([first], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (MAP - 3), np.uint8)
    # stretches of one bitmap: all together they are its size, and a byte more for each
    for r in docs.mapInArrow(scan, P.SCHEMA).groupBy("part").applyInArrow(bucket, "first long, bits binary").collect():
        own = np.frombuffer(r.bits, np.uint8)
        out[r.first : r.first + len(own)] |= own
    return out


@dataclass
class SuffixAutomaton:
    """States of the automaton of many strings, to a depth: the longest and (by the link) the shortest of a state's substrings, one end position, and the number of end positions."""

    length: np.ndarray
    link: np.ndarray
    end: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, depth: np.ndarray) -> SuffixAutomaton:
        """symbols: of all strings, one after the other; depth[p]: how many symbols that end at p are to be read, 0 to WORDS."""
        ends = np.flatnonzero(depth > 0)
        deep = depth[ends].astype(np.int64)
        # rank of each context by its last symbols, most significant first; a context that is too short is 0
        columns = []
        rank = np.zeros(len(ends), np.uint64)
        for d in range(WORDS):
            symbol = np.where(deep > d, symbols[np.maximum(ends - d, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            rank = np.unique((rank << np.uint64(32)) | symbol, return_inverse=True)[1].astype(np.uint64)
            columns.append(rank)
        order = np.argsort(rank, kind="stable")
        ends, deep = ends[order], deep[order]
        # a group at depth d: neighbours with the same last d symbols
        length, end, count, parent = [], [], [], []
        above = np.zeros(len(ends), np.int64)  # the state of each end position's group one level up, 0: the root
        above_count = np.full(len(ends), -1, np.int64)
        n_states = 1
        length.append(np.zeros(1, np.int64))
        end.append(np.zeros(1, np.int64))
        count.append(np.zeros(1, np.int64))
        parent.append(np.full(1, -1, np.int64))
        longest = {}
        for d in range(WORDS):
            has = np.flatnonzero(deep > d)
            if not len(has):
                break
            key = columns[d][order][has]
            b = K.group_bounds(key)
            size = np.diff(b)
            first = has[b[:-1]]
            merged = above_count[first] == size  # all end positions of the shorter substring: the same state
            number = np.where(merged, above[first], 0)
            fresh = np.flatnonzero(~merged)
            number[fresh] = n_states + np.arange(len(fresh))
            longest[d + 1] = number[merged]
            length.append(np.full(len(fresh), d + 1, np.int64))
            end.append(ends[first[fresh]])
            count.append(size[fresh])
            parent.append(above[first[fresh]])
            n_states += len(fresh)
            above, above_count = above.copy(), np.full(len(ends), -1, np.int64)
            above[has], above_count[has] = np.repeat(number, size), np.repeat(size, size)
        out = cls(*(np.concatenate(x) for x in (length, parent, end, count)))
        for d, states in longest.items():
            out.length[states] = d
        return out

    def substrings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End position, length and count of each different substring: those of a state are longer than its link's."""
        shortest = np.where(self.link >= 0, self.length[self.link], 0)
        n = self.length - shortest
        n[0] = 0
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return self.end[which], shortest[which] + 1 + step, self.count[which]


def _copy(source: np.ndarray, at: np.ndarray, target: np.ndarray, to: np.ndarray, size: np.ndarray) -> None:
    """source[at : at + size] to target[to : to + size], for all stretches, some at a time."""
    for k in range(0, len(size), 1 << 17):
        n = size[k : k + (1 << 17)]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        target[np.repeat(to[k : k + len(n)], n) + step] = source[np.repeat(at[k : k + len(n)], n) + step]


def _substrings(shard: Shard, bits: np.ndarray) -> pa.Table:
    """code, n_words, phrase, f of the shard's phrases that the bitmap lets through."""

    def through(h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - MAP)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    w = shard.words
    ok, depth = None, np.zeros(len(w.start), np.int8)
    for d, h in enumerate(shard.keys()):
        here = through(h) & (shard.before >= d)
        if d:  # both parts of d words must be there
            both = np.zeros(len(here), bool)
            both[1:] = ok[1:] & ok[:-1]
            here &= both
        depth[here] = d + 1
        ok = here
    # texts of the words that stay, one blank behind each, so that a phrase is one slice; a phrase's words all stay
    at = np.flatnonzero(depth > 0)
    start, size = w.start[at], (w.end - w.start)[at]
    first = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(first[-1]), 0x20, np.uint8)
    _copy(shard.data, start, flat, first, size)
    symbols = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(first), pa.py_buffer(flat)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    code = shard.code[at].astype(np.int64)
    symbols = symbols * (int(code.max(initial=0)) + 1) + code
    if len(symbols) and symbols.max() >= 1 << 31:
        symbols = np.unique(symbols, return_inverse=True)[1]
    automaton = SuffixAutomaton.of(symbols, depth[at])
    end, length, count = automaton.substrings()
    lo, hi = first[end - length + 1], first[end + 1] - 1
    out = np.concatenate([[0], np.cumsum(hi - lo)])
    text = np.empty(int(out[-1]), np.uint8)
    _copy(flat, lo, text, out, hi - lo)
    phrase = pa.Array.from_buffers(pa.large_string(), len(end), [None, pa.py_buffer(out), pa.py_buffer(text)])
    return pa.table({"code": code[end], "n_words": pa.array(length, pa.int32()), "phrase": phrase, "f": pa.array(count, pa.int64())})


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, n_words, phrase, f: each phrase of 1 to WORDS words with f >= least; a row with n_words 0 has the number of all words of lang."""
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = d.sparkSession.sparkContext.broadcast(_map(d, least).tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for shard, names in _shards(batches):
            langs = pa.array(names, pa.string())
            n = np.bincount(shard.code, minlength=len(names)) if len(shard.code) else np.zeros(len(names), np.int64)
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(names)), pa.int32()), pa.array([""] * len(names)), pa.array(n, pa.int64())], ["lang", "n_words", "phrase", "f"])
            if not len(shard.code):
                continue
            t = _substrings(shard, known)
            for b in t.to_batches(1 << 17):
                yield pa.RecordBatch.from_arrays([langs.take(b.column("code")), b.column("n_words"), b.column("phrase").cast(pa.string()), b.column("f")], ["lang", "n_words", "phrase", "f"])

    each = d.mapInArrow(scan, "lang string, n_words int, phrase string, f long")
    return each.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("n_words") == 0))


def _inner(phrase: str, n_words: str):
    """The two shorter phrases in one of three words: its suffix link's, and the one before its last word."""
    return F.array(F.expr(f"substring_index({phrase}, ' ', {n_words} - 1)"), F.expr(f"substring_index({phrase}, ' ', 1 - {n_words})"))


def scored(table: DataFrame) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of each candidate: the cut with the lowest score, the first among equals."""
    candidates = table.filter("n_words > 1").withColumnRenamed("f", "a")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.expr(f"substring_index(phrase, ' ', {k})").alias("left"), F.expr(f"substring_index(phrase, ' ', {k} - n_words)").alias("right"))
    cuts = F.explode(F.filter(F.array(*[cut(k) for k in range(1, WORDS)]), lambda c: c["k"] < F.col("n_words")))
    each = candidates.withColumn("cut", cuts).select("lang", "phrase", "n_words", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        known = table.filter("n_words > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        each = materialize(each.join(known, ["lang", side]).drop(side), f"phrases-{side}")
    whole = lambda c: F.col(c).cast("decimal(14,0)")
    score = F.expr("div(a_ * a_ * cast(1000000 as decimal(7,0)), l_ * r_)")
    each = each.select("*", *[whole(c).alias(f"{c}_") for c in "alr"]).withColumn("score", score.cast("long"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return each.groupBy("lang", "phrase", "n_words", "a").agg(best).select("lang", "phrase", "n_words", "a", "best.l", "best.r", "best.score")


def subsumed(table: DataFrame) -> DataFrame:
    """lang, phrase, longer: of phrases inside a longer candidate, the largest count of those."""
    inner = table.filter(f"n_words = {WORDS}").select("lang", "f", F.explode(_inner("phrase", "n_words")).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` candidates of each language.

    docs: text and lang; other columns are not read. A null text is empty; a null lang is `und`, together with rows that say so. Rows count
    as often as they stand. Candidates that tie in all but the phrase go by its bytes. Counts are exact below 10**14. A language without candidates, and an empty table, give no rows."""
    table = materialize(counts(docs, least), "phrases")
    out = scored(table).join(subsumed(table), ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {SUBSUMED} * a")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then of those, so that no task ranks a whole language
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).filter(F.col("rank") <= top)
    n = table.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
