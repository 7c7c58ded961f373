"""Ordered operators against sequential restatements of their rules on random lines."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillframe.functions import neighbours, text as T
from quillframe.operators import language_model as lm, sequence as S

POOL = ["one wo-", "rd two", "Three.", "", "- item", "1. first", "head:", "go of", "3 things", "und so", "x-", "über das", "$$a$$", "end of"]
SCHEMA = "doc_id int, pos int, text string"


def groups(seed, n=60):
    rng = random.Random(seed)
    return {g: [rng.choice(POOL) for _ in range(rng.randint(1, 12))] for g in range(n)}


def frame(spark, data):
    return spark.createDataFrame([(g, i, t) for g, ls in data.items() for i, t in enumerate(ls)], SCHEMA).repartition(3)


def collected(df, *order):
    out = {}
    for r in sorted(df.collect(), key=lambda r: tuple(r[o] for o in ("doc_id", *order))):
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def test_stitch(spark):
    data = groups(1)
    want = {}
    for g, lines in data.items():
        out, i = [], 0
        while i < len(lines):
            a = lines[i]
            if i + 1 < len(lines) and re.search(r"[^\W\d_]+[-–—=]$", a) and re.match(r"[^\W\d_]", lines[i + 1]):
                out.append(a[:-1] + lines[i + 1])
                i += 2
            else:
                out.append(a)
                i += 1
        want[g] = out
    assert collected(S.stitch_hyphens(frame(spark, data)), "pos") == want


def test_bind(spark):
    data = groups(2)
    want = {}
    for g, lines in data.items():
        out, i = [], 0
        while i < len(lines):
            words = lines[i].split()
            if words and i + 1 < len(lines) and words[-1].lower() in S.CONNECTORS and re.match(r"[a-zü0-9]", lines[i + 1]):
                head = re.sub(r"\s*\S+$", "", lines[i])
                out += [head] * bool(head) + [f"{words[-1]} {lines[i + 1]}"]
                i += 2
            else:
                out.append(lines[i])
                i += 1
        want[g] = out
    assert collected(S.bind_connectors(frame(spark, data)), "pos", "sub") == want


def test_merge(spark):
    data = groups(3)
    own = re.compile(r"^([-*•–—]\s+|\d+[.)]\s+|#|\$\$)|:$")
    want = {}
    for g, lines in data.items():
        out, prev = [], None
        for t in lines:
            goes_on = prev and not own.search(t) and not re.search(r"(:|\$\$)$", prev) and not prev.startswith("$$") and prev[-1] not in ".!?:" and t[:1].islower()
            if t:
                if goes_on:
                    out[-1] += " " + t
                else:
                    out.append(t)
            prev = t
        if out:
            want[g] = out
    assert collected(S.merge_sentences(frame(spark, data)), "pos") == want


def test_chain_and_fold(spark):
    df = spark.createDataFrame([(1, 0, "we see wo-"), (1, 1, "rds. then"), (1, 2, "go on.")], SCHEMA)
    assert [r.text for r in S.document_text(df).orderBy("pos", "sub").collect()] == ["We see words. Then go on."]


def test_dewrap(spark):
    rng = random.Random(6)
    parts = ["gar-", "den.", "den", "words", "общ-", "общес.", "тва.", "тва", "твен", "ответ-", "ответственность", "Ab", "x", "re-", "re.", "verylongpart", "to", "!!", "становлен-", "ния", "||"]
    data = [(g, p, " ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 1, 2, 3])))) for g in range(60) for p in range(rng.randint(0, 12))]
    lexicon, tri = {"garden", "reto", "denwords", "reverylongpart"}, {"^^g": 5, "gar": 3, "den": 900000}
    data += [(99, 0, "a gar-"), (99, 1, "den of re-"), (99, 2, "to"), (100, 0, "alone re-"), (101, 0, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = S.dewrap(df, spark.createDataFrame([(w,) for w in lexicon], "word string"), spark.createDataFrame(list(tri.items()), "tri string, n long"))
    total = sum(tri.values())

    def penalty(word):
        if not re.search("[a-z]", word):
            return 0
        padded = f"^^{word}$$"
        m = sum(math.log(max(1e-12, (tri.get(padded[i : i + 3], 0) + 0.01) / (total + 50))) for i in range(len(word) + 2)) / (len(word) + 2)
        return (m + 9) * 2.5 if m < -9 else 0

    def noise(t):
        t = re.sub(r"^[|/\\]+|[|/\\]+$", "", (t or "").strip()).strip()
        return re.sub(r"\s+", " ", re.sub(r"\s*\|\s*\|\s*", " | ", re.sub(r"^[.,;]+", "", t).strip())).strip()

    want = {}
    for g in {x[0] for x in data}:
        lines = [t for t in (noise(t) for x, _, t in sorted(data, key=lambda r: r[:2]) if x == g) if t]
        out, i = [], 0
        while i < len(lines):
            line, step = lines[i], 1
            broke = re.search(r"(\b\w+)[-.]$", line)
            if broke and i + 1 < len(lines):
                nxt = lines[i + 1].split()
                a, b, rest = broke[1].lower(), nxt[0].lower().rstrip(".,;:!?"), " ".join(nxt[1:])
                head = line[: broke.start()]
                if (a.startswith("общ") and b.startswith("тва")) or (a.startswith("общес") and b.startswith("твен")):
                    line, step = head + "общества.", 1 if rest else 2
                    lines[i + 1] = rest
                elif a.startswith("ответ") and b.startswith("ответ"):
                    line, step = head + "ответственность.", 2
                elif len(nxt) == 1 and len(b) <= 5:
                    whole = "общества" if (a + b).startswith("общ") else "становления" if (a + b).startswith("становлен") else a + b
                    line, step = head + whole + ".", 2
                elif a + b in lexicon or (len(a + b) >= 6 and penalty(a + b) == 0):
                    line, step = (head + a + b + " " + rest).rstrip(), 2
            out.append(line)
            i += step
        if out:
            want[g] = out
    assert collected(got, "pos") == want and want[99] == ["a garden of re-", "to"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_intervals_and_clusters(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 4), ("a", 12, 20), ("a", 50, 51)], "g string, s long, e long")
    assert {(r.start, r.end, r.n) for r in S.merge_intervals(df, "g", "s", "e", 4, 2).collect()} == {(0, 20, 3)}
    assert {(r.first, r.last) for r in S.gap_clusters(df, "g", "s", 10).collect()} == {(0, 12), (50, 50)}


def test_texts_are_cut_once_for_their_ngrams(spark, tmp_path):
    """No filter below the generator makes a text's words anew to ask how many they are."""
    spark.createDataFrame([("a b c b c",), ("a",), ("",), (None,)], "text string").write.parquet(str(tmp_path / "t"))
    d = lm.ngram_counts(spark.read.parquet(str(tmp_path / "t")), 2)
    assert {(r.w1, r.w2, r.n) for r in d.collect()} == {("a", "b", 1), ("b", "c", 2), ("c", "b", 1)}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_scores_are_looked_up_once(spark):
    """Each word in its context is scored once: the plan of a score has no second copy of that for the penalties or for broken words."""
    rows = [(1, 0, "the cat sat-"), (1, 1, "down the mat"), (1, 2, "!"), (1, 3, " "), (2, 0, "the cat")]
    c = spark.createDataFrame(rows, "g int, o int, text string")
    counts = lm.orders(lm.context_counts(lm.contexts(c, ["g", "o"])))
    d = lm.score_lines(c, "g", "o", *counts, lm.weighted_trigrams(counts[0]))
    got = {(r.g, r.o): r.score for r in d.collect()}
    assert set(got) == {(g, o) for g, o, _ in rows} and got[1, 2] == -5 and got[1, 3] == -10
    assert d._jdf.queryExecution().optimizedPlan().toString().count("AS logp#") <= 1


def test_noise_is_looked_for_where_it_can_be(spark):
    """a text is cleaned the same as by every pattern in turn, and a line's text is cleaned once, not once for each filter and branch."""
    rng = random.Random(12)
    marks = ["a", "b", "é", "7", " ", "  ", "\t", "\n", "\u0085", " ", " ", "|", "/", "\\", ".", ",", ";", "_", "~", "12 |", "||"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 7))) for _ in range(4000)] + [None]
    df = spark.createDataFrame([(g % 50, g, t) for g, t in enumerate(texts)], SCHEMA)

    def plain(t):
        s = S.strip(t)
        for p in T.NOISE:
            s = S.strip(F.regexp_replace(s, p, ""))
        return S.strip(F.regexp_replace(F.regexp_replace(s, "\\s*\\|\\s*\\|\\s*", " | "), "\\s+", " "))

    assert df.filter(~T.clean_noise(F.col("text")).eqNullSafe(plain(F.col("text")))).count() == 0
    lexicon, tri = spark.createDataFrame([("ab",)], "word string"), spark.createDataFrame([("^^a", 1)], "tri string, n long")
    plan = S.dewrap(df, lexicon, tri)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\d{1,2}") <= 3  # of the lines, of those whose words are asked, and of the words


def test_own_log_probabilities_move_each_word_once(spark, monkeypatch):
    texts = ["a b a b c", "a", "", None, "a b", "b  a-b a", "the the the the", "c c", "É é x1 _ y"] * 3 + ["only once here"]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, pos int, text string")
    general = lm.word_log_prob(lm.contexts(df, ["doc_id", "pos"])).select("doc_id", "pos", "k", "logp")
    want = sorted((*r[:3], round(r[3], 9)) for r in general.collect())
    for most in (lm.COMMON, 3):  # 3: most words are no common ones, so they are joined
        monkeypatch.setattr(lm, "COMMON", most)
        out = lm.own_log_prob(df, ["doc_id", "pos"])
        assert sorted((*r[:3], round(r[3], 9)) for r in out.collect()) == want
        assert lm.own_log_prob(df.limit(0), ["doc_id", "pos"]).count() == 0
    monkeypatch.setattr(lm, "COMMON", 1_000_000)
    plan = lm.own_log_prob(df, ["doc_id", "pos"])._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_words_go_to_their_neighbours_in_a_few_bytes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common, texts = [f"w{i}" for i in range(40)], []
    for k in range(600):
        words = [common[int(i)] if i < 40 else f"x{int(i)}" for i in rng.zipf(1.3, rng.integers(0, 30)).clip(0, 10**9) - 1]
        texts.append(" ".join(["w0 w1 w0"] * (k % 5 == 0) + words))
    rows = [(None if k % 50 == 0 else k // 2 - 2**40, k % 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string").repartition(4)
    keys = ["doc_id", "pos"]
    want = Counter((*r[:3], round(r[3], 9)) for r in lm.word_log_prob(lm.contexts(df, keys)).select(*keys, "k", "logp").collect())
    asked = {c: k for c, k in zip(keys, (pa.int64(), pa.int32()))}
    for most, hot, share, chunk in ((lm.COMMON, 10**9, 1 << 20, 1 << 21), (lm.COMMON, 20, 200, 500), (12, 60, 100, 70), (1, 1, 50, 10**6)):
        for name, value in (("COMMON", most), ("HOT", hot), ("SHARE", share)):
            monkeypatch.setattr(lm, name, value)
        monkeypatch.setattr(neighbours, "CHUNK", chunk)
        out = lm.own_log_prob(df, keys)
        assert out.schema["doc_id"].dataType.simpleString() == "bigint" and out.schema["pos"].dataType.simpleString() == "int"
        assert Counter((*r[:3], round(r[3], 9)) for r in out.collect()) == want
    # other keys than whole numbers go the general way
    named = df.selectExpr("concat('d', doc_id) as doc_id", "pos", "text")
    assert lm.own_log_prob(named, keys).count() == sum(want.values())
    # one exchange, of blobs; no window looks at rows of words
    monkeypatch.undo()
    plan = lm.own_log_prob(df, keys)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange hashpartitioning(part") == 1 and "Window" not in plan
    words = pa.array([[f"w{int(i)}" for i in rng.zipf(1.3, 30).clip(0, 5000)] for _ in range(3000)])
    known = neighbours.Common(pa.array([f"w{i}" for i in range(5001)]), np.full(5001, 18), 90_000, 1 << 20, 1 << 21)
    lines = pa.RecordBatch.from_arrays([pa.array(np.arange(3000) // 9), pa.array(np.arange(3000) % 9), words], names=[*keys, "w"])
    dealt = list(neighbours.deal(known, keys)(iter([lines])))
    assert sum(b.column("blob").nbytes for b in dealt) < 10 * 90_000
    parts = pa.Table.from_batches(dealt)
    assert sum(b.num_rows for k in range(parts.num_rows) for b in neighbours.scored(known, asked, 1e5)(iter(parts.slice(k, 1).to_batches()))) == 90_000
    # a word that stands often goes to the cells of a square, and so does what stands beside it
    square = neighbours.Common(pa.array(["a", "b"]), np.array([90, 10]), 100, 10, 10)
    assert list(square.side) == [1, 3, 1] and square.first[1] == square.parts
