"""Filter audit, embedding near-duplicates and phrase mining against plain restatements: nulls, ties, repeated rows, long texts, empty tables, clashing columns."""

import itertools
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from quillframe.llm import filter_audit, kernels, phrase_mining, vector_dedup  # noqa: E402


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# filter audit


def audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = brute.WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": t in least and (i is None or least[t] < i)}
        parts.setdefault(s or "", []).append((i, {f for f, x in fails.items() if x}))
    out = []
    for part, own in parts.items():
        found = {}
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                fails = [d for d, (_, x) in enumerate(own) if f in x]
                fresh = [d for d in fails if d not in gone]
                redundant = len(fails) - len(fresh)
                gone |= set(fresh)
                found["".join(order), k + 1, f] = [len(own) - len(gone), len(fresh), redundant, sum(x == {f} for _, x in own), sum(own[d][0] in good for d in fresh), sum(own[d][0] in toxic for d in fresh)]
        for (order, k, f), x in found.items():
            out.append((part, order, k, *x, sum(y[1] for (_, _, g), y in found.items() if g == f)))
    return sorted(out, key=repr)


def audit_docs():
    rng = random.Random(3)
    v = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    docs = []
    for k in range(90):
        t = " ".join(rng.choice(v[: rng.choice([40, 300])]) for _ in range(rng.choice([3, 199, 200, 201, 400])))
        t = t.upper() if rng.random() < 0.2 else t
        t += rng.choice(["", "", " #", "|", " Ab", "\x0b\x0cX"])
        docs.append((k, t, rng.choice(["a", "b", "", None])))
    docs += [(k + 100, docs[5][1], rng.choice(["a", "b"])) for k in range(30)]
    docs += [(None, docs[5][1], "a"), (None, "one of a kind", "b"), (None, "one of a kind", "b"), (7, docs[7][1], "a"), (200, None, None), (201, "", "a"), (202, "  \n", "b"), (203, "x " * 200_000, "b"), (204, "A" * 50 + "a" * 2450, "a"), (205, "A" * 51 + "a" * 2449, "a")]
    rng.shuffle(docs)
    return docs


def test_audit(spark):
    docs = audit_docs()
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 130, 3)] + [(3, 0, 1), (9, None, None), (None, 1, 1), (10**9, 1, 1)]
    df = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in docs], "doc_id long, text string, source string, part string, mask int, _id int").repartition(5)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert rows(filter_audit.audit(df, known)) == audit(docs, labels)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(filter_audit.audit(df, known)) == []
    assert filter_audit.audit(spark.createDataFrame([(1, None, None)], df.schema), known).count() == 600


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = ["a b c a", "", "d d d", "aa bb aa cc", "e"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    w = kernels.words(data, offsets, kernels.SPACE)
    want = [len(set(t.split())) for t in texts]
    assert filter_audit.distinct_words(data, w).tolist() == want
    monkeypatch.setattr(filter_audit.K, "word_hash", lambda data, w: np.zeros(len(w.start), np.uint64))
    assert filter_audit.distinct_words(data, w).tolist() == want


# embeddings


def near(vectors, cosine=0.9):
    """vectors: (id, list or None), ids differ."""
    ok = {i: np.array(v, float) / max(map(abs, v)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    parent = {i: i for i, _ in vectors}
    count = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(ok.items(), 2):
        if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
            count[a] += 1
            count[b] += 1
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return sorted(((i, count[i], find(i), find(i) == i) for i, _ in vectors), key=repr)


def clouds(seed, n=260, dim=16):
    """Groups of near vectors of all tightness, chains, equal and scaled copies, and far ones."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(n // 4)]
    for spread in (1e-9, 1e-3, 0.02, 0.08, 0.1, 0.12, 0.2):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [c + rng.normal(size=dim) * spread for _ in range(n // 12)]
    chain = rng.normal(size=dim)
    for _ in range(20):
        chain = chain + rng.normal(size=dim) * 0.15
        out.append(chain)
    out += [out[3]] * 9 + [out[3] * 4] + [np.eye(dim)[0], -np.eye(dim)[0], np.eye(dim)[1]]
    a, b = np.eye(dim)[2], np.eye(dim)[3]
    out += [a, (0.9 + 1e-12) * a + np.sqrt(1 - (0.9 + 1e-12) ** 2) * b, (0.9 - 1e-12) * a - np.sqrt(1 - (0.9 - 1e-12) ** 2) * b]
    return [x.tolist() for x in out]


@pytest.mark.parametrize("block,centres", [(4096, 2048), (40, 12), (7, 1)])
def test_vectors(spark, block, centres):
    some = clouds(block)
    vectors = list(enumerate(some)) + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + some[0][1:]), (1004, [None] + some[0][1:]), (1005, some[0][:3]), (1006, some[0][:3]), (1007, [-0.0] * 16), (1008, [1e308] * 16), (1009, [1e-300] * 16), (1010, [float("inf")] * 16)]
    random.Random(1).shuffle(vectors)
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], "vec_id long, embedding array<double>, dim int, set string, rep int").repartition(6)
    assert rows(vector_dedup.join(df, block=block, centres=centres)) == near(vectors)


def test_vectors_repeated_and_unnamed(spark):
    a, b, c = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    df = spark.createDataFrame([(5, a), (5, a), (None, a), (None, None), (3, b), (9, c), (9, a), (11, c)], "vec_id long, embedding array<float>")
    # 5, 3 and 9 by a and b; 11 by 9's other vector, and 9 is one component; a of 5 and of 9 and b are three vectors
    assert rows(vector_dedup.join(df)) == sorted([(5, 2, 3, False), (5, 2, 3, False), (None, 0, None, True), (None, 0, None, True), (3, 2, 3, True), (9, 1, 3, False), (9, 2, 3, False), (11, 1, 3, False)], key=repr)
    empty = spark.createDataFrame([], df.schema)
    assert rows(vector_dedup.join(empty)) == []


@pytest.mark.parametrize("kind", ["one point", "copies", "sphere", "two groups"])
def test_cover_trees_and_their_join(kind):
    rng = np.random.default_rng(4)
    x = {"one point": rng.normal(size=(1, 5)), "copies": np.ones((50, 5)), "sphere": rng.normal(size=(700, 3)), "two groups": np.concatenate([np.eye(4)[:1] + rng.normal(size=(300, 4)) * 0.03, np.eye(4)[1:2] + rng.normal(size=(300, 4)) * 0.2])}[kind]
    x = vector_dedup.unit(x)
    order, top = vector_dedup.CoverTree.build(x)
    assert sorted(order) == list(range(len(x))) and top[0] == 0
    x = x[order]
    tree = vector_dedup.CoverTree(x, top)
    for level in range(tree.levels()):
        start, end, radius = tree.nodes(level)
        assert start[0] == 0 and end[-1] == len(x) and (start[1:] == end[:-1]).all()
        for s, e, r in zip(start, end, radius):
            assert np.linalg.norm(x[s:e] - x[s], axis=1).max() <= min(r, 2 / 2**level) + 1e-6
        far = 1 - x[start] @ x[start].T
        assert len(start) == 1 or far[~np.eye(len(start), dtype=bool)].min() >= 0
    weight = rng.integers(1, 4, len(x))
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    count, group = vector_dedup.DualJoin(tree, None, weight, 0.9).run()
    assert (count == linked @ weight).all()
    for a, b in np.argwhere(linked):
        assert group[a] == group[b]
    assert len(set(group)) == components(linked)
    cut = len(x) // 3
    parts = [x[:cut], x[cut:]]
    orders = [vector_dedup.CoverTree.build(p) for p in parts]
    trees = [vector_dedup.CoverTree(p[o], t) for p, (o, t) in zip(parts, orders)]
    both = np.concatenate([orders[0][0], cut + orders[1][0]])
    count, _ = vector_dedup.DualJoin(*trees, weight[both], 0.9).run()
    cross = linked.copy()
    cross[:cut, :cut] = cross[cut:, cut:] = False
    assert (count == (cross @ weight)[both]).all()


def test_trees_of_several_roots_and_teams_of_blocks(spark):
    rng = np.random.default_rng(5)
    x = vector_dedup.unit(np.concatenate([rng.normal(size=(400, 24)), np.eye(24)[:1] + rng.normal(size=(150, 24)) * 0.06, np.eye(24)[1:2] + rng.normal(size=(50, 24)) * 0.005])[rng.permutation(600)])
    weight = rng.integers(1, 4, len(x))
    order, top = (np.concatenate(c) for c in zip(*((k + o, t) for k in range(0, 600, 120) for o, t in [vector_dedup.CoverTree.build(x[k : k + 120])])))
    x, weight = x[order], weight[order]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    count, group = vector_dedup.DualJoin(vector_dedup.CoverTree(x, top), None, weight, 0.9).run()
    assert (count == linked @ weight).all() and len(set(group)) == components(linked)
    forests = [vector_dedup.CoverTree(x[a:b], top[a:b]) for a, b in ((0, 240), (240, 600))]
    join = vector_dedup.DualJoin(*forests, weight, 0.9)
    linked[:240, :240] = linked[240:, 240:] = False
    assert (join.run()[0] == linked @ weight).all()
    # what the leading coordinates let through holds each pair at the cosine, on fewer axes
    assert (join.low @ join.low.T >= join.points @ join.points.T - join.slack).all() and join.low.shape[1] < 24
    # a vector goes to no more pairs of teams than there are teams, however many blocks there are
    far = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 24)))], "vec_id long, embedding array<float>")
    sets = vector_dedup.parsed(far).withColumns({"set": F.col("vec_id"), "rep": F.col("vec_id"), "times": F.lit(1).cast("long")})
    trees = vector_dedup._trees(vector_dedup._placed(sets, 64), 10).persist()
    assert trees.select("block").distinct().count() >= 90
    tiles = vector_dedup._tiles(trees, vector_dedup._pairs(trees, 0.9), 10)
    teams = int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))
    assert 900 < tiles.count() <= 900 * teams
    trees.unpersist()


def components(linked):
    left, n = set(range(len(linked))), 0
    while left:
        stack, n = [left.pop()], n + 1
        while stack:
            more = {int(b) for b in np.flatnonzero(linked[stack.pop()])} & left
            left -= more
            stack += more
    return n


# phrases


def phrases(docs, least=10, top=2000):
    import re

    f, n = Counter(), Counter()
    for t, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(brute.FOLD)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            score, k = min(((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]])), k) for k in range(1, len(w)))
            out[lang, w] = (score, a, f[lang, w[:k]], f[lang, w[k:]])
    longest = Counter()
    for (lang, w), (_, a, _, _) in out.items():
        if len(w) == 3:
            for x in (w[:2], w[1:]):
                longest[lang, x] = max(longest[lang, x], a)
    by = {}
    for (lang, w), (score, a, left, right) in out.items():
        if not longest[lang, w] or 100 * longest[lang, w] < 50 * a:
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, own in by.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)), key=repr)


def phrase_docs():
    rng = random.Random(12)
    v = ["a", "b", "é", "Ünit", "of", "the", "House", "x-y", "日本", "1"]
    docs = [("".join(rng.choice(v) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(rng.randint(0, 200))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(60)]
    docs += [("see New York city now. " * 30, "en"), (None, "en"), ("", None), ("one", "fr"), ("la " * 3000, "fr"), (". ,;", "xx"), ("\x0bnew\x0cyork new york", "en")]
    return docs + [docs[-7]] * 3


def test_phrases(spark):
    docs = phrase_docs()
    df = spark.createDataFrame([(t, lang, "p", 1) for t, lang in docs], "text string, lang string, phrase string, f int").repartition(4)
    assert rows(phrase_mining.mine(df)) == phrases(docs)
    assert rows(phrase_mining.mine(df, 3, 7)) == phrases(docs, 3, 7)


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert rows(phrase_mining.mine(df)) == []
    assert rows(phrase_mining.mine(spark.createDataFrame([(None, None), ("x y", "en")], df.schema))) == []


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    docs = phrase_docs()
    long = [("".join(t or "" for t, _ in docs), "en"), ("u v w " * 500, "en")]
    data = np.frombuffer("".join(t for t, _ in long).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t, _ in long)])
    monkeypatch.setattr(phrase_mining, "SHARD", 50)
    cuts = list(phrase_mining._cuts(data, offsets))
    assert b"".join(d.tobytes() for d, *_ in cuts) == data.tobytes() and len(cuts) > 50
    assert all(phrase_mining._PIECE[d[0]] for d, _, a, _ in cuts[1:-1] if a == 0) and len(cuts[-1][0]) == 3000


def test_automaton_has_each_substring_once():
    rng = random.Random(2)
    for size in (1, 2, 5, 60):
        strings = [[rng.randrange(size) for _ in range(rng.randint(0, 30))] for _ in range(12)]
        flat = np.array([x for s in strings for x in s], np.int64)
        depth = np.array([min(k + 1, 3) for s in strings for k in range(len(s))], np.int8)
        auto = phrase_mining.SuffixAutomaton.of(flat, depth)
        end, length, count = auto.substrings()
        got = [(tuple(flat[e - n + 1 : e + 1]), c) for e, n, c in zip(end, length, count)]
        want = Counter(tuple(s[i : i + k]) for s in strings for k in (1, 2, 3) for i in range(len(s) - k + 1))
        assert len(got) == len(want) and dict(got) == dict(want)
        # a state's substrings have one set of end positions; its link's is larger
        ends = {}
        for k in (1, 2, 3):
            for p in np.flatnonzero(depth >= k):
                ends.setdefault(tuple(flat[p - k + 1 : p + 1]), set()).add(int(p))
        assert len(auto.count) - 1 == len({frozenset(x) for x in ends.values()})
        assert all(auto.count[auto.link[s]] > auto.count[s] for s in range(1, len(auto.link)) if auto.link[s] > 0)


# quality classifier


def test_ridge_and_calibration_are_those_of_a_plain_solve(spark):
    import zlib

    from pyspark.sql import functions as F

    from quillframe.llm import quality_model as Q

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = Q.measured(docs)
    model = Q.fit(x, labels)
    values = {r.doc_id: np.array(r.x, np.float64) for r in x.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in values}
    fold = {r.doc_id: r.cal for r in spark.createDataFrame([(i,) for i in y], "doc_id long").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("cal")), F.lit(Q.CALIBRATE)) == 0).alias("cal")).collect()}
    every = np.array([values[i] for i in y])
    assert np.allclose(model.mean, every.mean(axis=0)) and np.allclose(model.scale, np.maximum(every.std(axis=0), 1e-6))
    ids = [i for i in y if not fold[i]]
    z = model.features(np.array([values[i] for i in ids]))
    strength = Q.RIDGE * max(1.0, len(ids)) / Q.FEATURES
    stacked = np.concatenate([z, np.sqrt(strength) * np.eye(z.shape[1])])
    plain = np.linalg.lstsq(stacked, np.concatenate([[y[i] for i in ids], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.coefficients, plain, atol=1e-6)
    held = [i for i in y if fold[i]]
    margin = model.features(np.array([values[i] for i in held])) @ model.coefficients
    order = np.argsort(margin, kind="stable")
    label = np.array([y[i] for i in held], float)[order]
    sums = np.concatenate([[0], np.cumsum(label)])
    n = len(label)
    # the isotonic fit by its definition: the largest, over starts, of the smallest mean, over ends
    level = [max(min((sums[k] - sums[j]) / (k - j) for k in range(i + 1, n + 1)) for j in range(i + 1)) for i in range(n)]
    edges, levels = Q.isotonic(margin, np.array([y[i] for i in held], float))
    assert np.allclose(edges, model.edges) and np.allclose(levels, model.levels)
    assert np.allclose(sorted(set(np.round(level, 9))), np.round(levels, 9))
