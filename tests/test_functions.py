import difflib
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import blocks, formulas, text as T
from quillframe.operators import decoding, distance, exports, language_model as lm, metrics, plugins, profiles, relational as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,kind", [("", "empty"), ("a = b + c", "math"), ("Chapter 4", "h2"), ("Note:", "h2"), ("- item", "bullet"), ("1) item", "bullet"), ("plain prose here", "paragraph")])
def test_line_type(spark, text, kind):
    assert one(spark, T.line_type(F.col("t"), F.lit(10), F.lit(20.0)), t=text) == kind


def test_tall_line_is_heading(spark):
    assert one(spark, T.line_type(F.col("t"), F.lit(30), F.lit(20.0)), t="Some words") == "h1"


@pytest.mark.parametrize("text,want", [("go go go on now", True), ("a b c d", False), ("x x x", False), ("abababab", True), ("", False), ("end a a a", False)])
def test_repetitive(spark, text, want):
    assert one(spark, T.repetitive(F.col("t")), t=text) is want


@pytest.mark.parametrize("a,b,want", [("cat", "cot", 0.2), ("cat", "Cat", 1.0), ("abc", "abc", 0.0), ("", "ab", 2.0), ("kitten", "sitting", None), ("ab", "abc", 1.0)])
def test_weighted_distance(spark, a, b, want):
    got = one(spark, distance.weighted_distance(F.col("a"), F.col("b"), 2.2), a=a, b=b)
    assert got is want if want is None else got == pytest.approx(want)


def test_names(spark):
    assert one(spark, T.user_id(F.col("t")), t="  Ann  Lee! ") == "ann_lee"
    assert one(spark, T.user_id(F.col("t")), t="!!") == "user"
    assert one(spark, T.file_name(F.col("t")), t="..\\up/.my file?.png") == "my_file_.png"
    assert one(spark, T.under_root(F.col("t"), "/data"), t="/data/../etc") is False


def test_capitals_and_json(spark):
    assert one(spark, T.capitalize_sentences(F.col("t")), t="one. two! three") == "One. Two! Three"
    got = one(spark, T.json_found(F.col("t"), "a int"), t='so: ```json\n{"a": 3}\n``` bye')
    assert got.a == 3
    assert one(spark, T.json_found(F.col("t"), "a int"), t='text {"a": 4} more').a == 4


@pytest.mark.parametrize("line,want", [("y = x^2 + 1", "$$y = x^{2} + 1$$"), ("F = (a) / (b)", "$$F = \\frac{a}{b}$$"), ("", ""), ("prose only", "prose only"), ("H2 + O2 -> H2O", "$$\\text{H}_2 + \\text{O}_2 \\rightarrow \\text{H}_2\\text{O}$$")])
def test_formulas(spark, line, want):
    assert one(spark, formulas.format_line(F.col("t")), t=line) == want


def test_markdown(spark):
    rows = [(1, 0, "Chapter one"), (1, 1, "- item"), (1, 2, "long prose line that is no heading as it goes on and on"), (1, 3, "")]
    out = exports.markdown(spark.createDataFrame(rows, "doc_id int, pos int, text string"), "T").first().content
    assert out.startswith("# T\n\n> **Subject**") and "\n### Chapter one\n" in out and "\n- item\n" in out and out.endswith("on and on\n")
    with pytest.raises(ValueError):
        exports.export(spark.createDataFrame(rows, "doc_id int, pos int, text string"), "pdf", "T")


def test_substitutions_and_penalties(spark):
    rows = [("u", 1, "cat", "cot"), ("u", 2, "hat", "hot"), ("u", 3, "same", "SAME"), ("v", 4, "ab", "abcd")]
    fixes = spark.createDataFrame(rows, "user_id string, at long, original string, corrected string")
    counts = profiles.pair_counts(profiles.substitutions(fixes))
    assert {(r.user_id, r.a, r.b, r.n) for r in counts.collect()} == {("u", "a", "o", 2)}
    assert {(r.a, r.b): round(r.cost, 3) for r in profiles.penalties(counts).collect()} == {("a", "o"): 0.12, ("o", "a"): 0.12}
    got = {r.user_id: r for r in profiles.stats(fixes, counts).collect()}
    assert (got["u"].total_corrections, got["u"].n_pairs, got["v"].n_pairs) == (2, 1, 0)


def test_arbitration(spark):
    def reason(a, ca, b, cb, la=False, lb=False, va=1, vb=1):
        out = T.arbitrate(F.lit(a), F.lit(ca), F.lit(b), F.lit(cb), F.lit(la), F.lit(lb), F.lit(va), F.lit(2), F.lit(vb), F.lit(2))
        return one(spark, out).reason

    assert reason("", 0.1, "x", 0.5) == "second_only"
    assert reason("x", 0.1, "", 0.5) == "first_only"
    assert reason("", 0.1, " ", 0.5) == "both_empty"
    assert reason("a", 0.95, "b", 0.5, la=True) == "first_loops"
    assert reason("a", 0.95, "b", 0.5) == "first_confident"
    assert reason("a", 0.5, "b", 0.7, va=0, vb=2) == "second_lexical"
    assert reason("a", 0.5, "A", 0.5) == "agreement"
    assert reason("a", 0.5, "b", 0.5) == "weighted"


def test_ctc(spark):
    step = lambda c: [0.9 if i == c else 0.02 for i in range(6)]
    df = spark.createDataFrame([(1, [step(2), step(2), step(0), step(2), step(1), step(3)]), (2, [step(0)])], "id int, p array<array<double>>")
    got = {r.id: r for r in decoding.ctc_greedy(df, "id").collect()}
    assert got[1].ids == [2, 2, 3] and got[1].confidence == pytest.approx(0.9)
    assert got[2].ids == [] and got[2].confidence == 0


def test_language_model(spark):
    lines = spark.createDataFrame([(1, 0, "the cat sat"), (1, 1, "the cat ran"), (1, 2, "")], "d int, p int, text string")
    t = lm.tokens(lines, ["d", "p"])
    counts = [ngrams(t, ["d", "p"], n) for n in (1, 2, 3)]
    assert {(r.w1, r.w2): r.n for r in counts[1].collect()}[("the", "cat")] == 2
    scores = {r.p: r.score for r in lm.score_lines(lines, "d", "p", *counts, lm.char_trigrams(t)).collect()}
    assert scores[2] == -10.0 and scores[0] < 0


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page int, text string")
    new = spark.createDataFrame([(1, "z")], "page int, text string")
    assert {tuple(r) for r in R.replace_children(old, new, "page").collect()} == {(1, "z"), (2, "c")}
    again = R.replace_children(R.replace_children(old, new, "page"), new, "page")
    assert again.count() == 2
    assert R.insert(old, new.drop("text"), text=F.lit("d")).filter("text = 'd'").count() == 1
    docs, made = spark.createDataFrame([(1,), (2,)], "id int"), F.lit("new")
    stored = spark.createDataFrame([(1, "old")], "id int, content string")
    assert {tuple(r) for r in R.stored_or_made(docs, stored, "id", made).collect()} == {(1, "old"), (2, "new")}
    bad = spark.createDataFrame([("1", "d", 0, 5, 5)], "id string, document_id string, page_number int, width int, height int")
    assert {r["check"]: r.n for r in R.violations(bad, R.model_checks("pages")).collect()} == {"page_number": 1, "size": 0}


def test_plugins(spark):
    lines = spark.createDataFrame([(1, bytearray(b"x" * 10)), (2, bytearray(b"y" * 900))], "id int, data binary")
    out = {r.id: r for r in plugins.two_tier(lines, plugins.StubRecognizer, plugins.StubRecognizer).collect()}
    assert out[2].conf == 0.9 and out[1].text == "line of 10 bytes"
    asked = spark.createDataFrame([(1, 1, "abc", 0.5), (1, 2, "d", 0.9)], "g int, k int, text string, conf double")
    fixes = spark.createDataFrame([(1, 1, "abd")], "g int, k int, corrected_text string")
    got = {r.k: r for r in plugins.merge_corrections(asked, fixes, ["g", "k"]).collect()}
    assert got[1].changed and got[1].conf == pytest.approx(0.62) and not got[2].changed


def some_pairs(n):
    rng = random.Random(5)
    out = [(None, "x"), ("", ""), (None, None), ("ab", "")]
    for _ in range(n):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz éß日,."])
        x = [rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 40, 199, 201, 450]))]
        y = list(x) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.choice([2, 60, 220, 480]))]
        for _ in range(rng.randint(0, 1 + len(y) // 6)):
            y[rng.randrange(len(y))] = rng.choice(["", " ", "x", "ab", rng.choice(letters)])
        out.append(("".join(x), "".join(y)))
    return out


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_blocks_are_those_of_the_definition(monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    pairs = [(a or "", b or "") for a, b in some_pairs(150)]
    found = {}
    for p, *block in zip(*blocks.matching_blocks(*(x for side in zip(*pairs) for x in blocks.characters(pa.array(side))))):
        own = found.setdefault(int(p), [])
        i, j, n = map(int, block)
        if own and (own[-1][0] + own[-1][2], own[-1][1] + own[-1][2]) == (i, j):
            own[-1] = (*own[-1][:2], own[-1][2] + n)
        else:
            own.append((i, j, n))
    for k, (a, b) in enumerate(pairs):
        assert found.get(k, []) == [tuple(m) for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()[:-1]]


def test_similarity_is_that_of_the_definition(spark):
    pairs = some_pairs(120) + [(" a  b\tc ", "a c b"), ("w " * 250, "w x " * 130)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").repartition(3)
    for r in df.select("k", metrics.similarity("a", "b").alias("c"), metrics.word_similarity("a", "b").alias("w")).collect():
        a, b = (x or "" for x in pairs[r.k])
        assert r.c == difflib.SequenceMatcher(None, a, b).ratio() and r.w == difflib.SequenceMatcher(None, a.split(), b.split()).ratio()


def test_substitutions_are_those_of_the_definition(spark):
    pairs = [(a, b) for a, b in some_pairs(80) if a and b]
    df = spark.createDataFrame([("u", k, *p) for k, p in enumerate(pairs)], "user_id string, at long, original string, corrected string")
    want = []
    for k, (a, b) in enumerate(pairs):
        x, y = a.lower().strip(), b.lower().strip()
        if x != y and x and y:
            want += [(k, x[i], y[m]) for tag, i, j, m, n in difflib.SequenceMatcher(None, x, y).get_opcodes() if tag == "replace" and j - i == 1 == n - m]
    assert sorted((r["at"], r.a, r.b) for r in profiles.substitutions(df).collect()) == sorted(want)


def test_similar_pairs_lose_none(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aabcdeést") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    words += [w[: len(w) // 2] + rng.choice("xyz") + w[len(w) // 2 :] for w in words[:60]]
    asked, known = words[::2], words[1::2]
    a, b = (spark.createDataFrame([(w,) for w in x], "word string") for x in (asked, known))
    for least in (0.72, 0.51, 0.9):
        got = {(r.word, r.candidate): r.r for r in distance.similar_pairs(a, b, least).collect()}
        every = {(x, y): difflib.SequenceMatcher(None, y, x).ratio() for x in asked for y in known if len(x) > 2 and len(y) > 2}
        assert got == {k: r for k, r in every.items() if r >= least}
    with pytest.raises(ValueError):
        distance.similar_pairs(a, b, 0.5)


def test_similar_pairs_by_blocks(spark, monkeypatch):
    """no plan makes keys or letter lists for each pair of words; small blocks, slices and shared places of letters lose none, and words of the vocabulary are not compared."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdeés𐍈") for _ in range(rng.choice([2, 3, 4, 5, 8, 30]))) for _ in range(120)} | {"x" * k for k in (3, 5, 40, 55, 90)})
    asked, known = words[::2], words[1::2] + words[:6:2]
    a, b = (spark.createDataFrame([(w,) for w in x], "word string") for x in (asked, known))
    plan = distance.similar_pairs(a, b, 0.72)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "lambda" not in plan and "NestedLoop" not in plan
    every = {(x, y): difflib.SequenceMatcher(None, y, x).ratio() for x in asked for y in known if len(x) > 2 and len(y) > 2}
    for size, places in ((7, 4), (4_000, 1_024)):
        monkeypatch.setattr(distance, "BLOCK", size)
        monkeypatch.setattr(distance, "SLICE", 3)
        monkeypatch.setattr(distance, "PLACES", places)
        for least in (0.6, 0.72, 1.0):
            rows = distance.similar_pairs(a, b, least).collect()
            assert len(rows) == len({(r.word, r.candidate) for r in rows}) and {(r.word, r.candidate): r.r for r in rows} == {k: r for k, r in every.items() if r >= least}
    tokens = spark.createDataFrame([(1, k, w) for k, w in enumerate(asked)], "d int, k int, token string")
    fixed = spark.createDataFrame([], "word string, replacement string")
    best = {x: max(((r, y) for (w, y), r in every.items() if w == x and r >= 0.72), default=(0, x))[1] if len(x) > 3 else x for x in asked}
    assert {asked[r.k]: r.token for r in distance.snapped(tokens, b, fixed, ["d"]).collect()} == best


def test_bound_lines(spark):
    lines = [(1, "Not more than 10 ml"), (2, "the Kottle, boils ,, x|"), (3, '"«ab»" | | abcde'), (4, "a."), (5, None), (6, "7"), (7, "R.kettle ??water"), (8, "|"), (9, "KETTEL wa-ter")]
    df = spark.createDataFrame(lines, "k int, text string")
    vocabulary = spark.createDataFrame([("kettle",), ("water",), ("settle",), ("boils",)], "word string")
    fixed = spark.createDataFrame([("abcde", "fixed")], "word string, replacement string")
    got = {r.k: r.text for r in distance.bound_lines(df, vocabulary, fixed, [("not more", "small"), ("(?i)not more", "At most 10 ml")], ["k"]).collect()}
    assert got == {1: "At most 10 ml", 2: "the Kettle, boils, x", 3: "ab | fixed", 4: "", 5: "", 6: "7", 7: "kettle water", 8: "", 9: "Kettle water"}


def test_ratio_errors(spark):
    df = spark.createDataFrame([("g", "abcd", "abcd"), ("g", "", "x")], "k string, found string, truth string")
    assert metrics.ratio_error_macro(df, ["k"]).first().error == pytest.approx(0.5)


@pytest.mark.parametrize(
    "line,want",
    [
        ("(a + b) / (c - d)", "\\frac{a + b}{c - d}"),
        ("sqrt(x + 1)", "\\sqrt{x + 1}"),
        ("x^2 + y^2 = R^2", "x^{2} + y^{2} = R^{2}"),
        ("E_k = m * v^2 / 2", "E_{k} = m \\cdot \\frac{v^{2}}{2}"),
        ("Delta t != 0", "\\Delta t \\neq 0"),
        ("lim x->0", "\\lim_{x \\to 0}"),
        ("sum x_i <= infinity", "\\sum x_{i} \\le \\infty"),
        ("a <-> b ~= eps", "a \\Leftrightarrow b \\approx \\varepsilon"),
        ("e^(kx) ± 2pi", "e^{kx} \\pm 2\\pi"),
    ],
)
def test_latex(spark, line, want):
    assert one(spark, formulas.to_latex(F.col("t")), t=line) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("H2SO4", "\\text{H}_2\\text{SO}_4"),
        ("2H2 + O2 -> 2H2O", "2\\text{H}_2 + \\text{O}_2 \\rightarrow 2\\text{H}_2\\text{O}"),
        ("C6H12O6 <=> Ca(OH)2", "\\text{C}_6\\text{H}_{12}\\text{O}_6 \\Leftrightarrow \\text{Ca(OH)}_2"),
        ("CH3-COOH", "\\text{CH}_3\\text{-COOH}"),
    ],
)
def test_chemistry(spark, line, want):
    assert one(spark, formulas.chemistry(F.col("t")), t=line) == want


@pytest.mark.parametrize(
    "line,kind", [("", "blank"), ("$$a$$", "ready"), ("HCl + NaOH = NaCl + H2O", "reaction"), ("V1 = V0 + a * t", "equation"), ("The area of it: a * b", "labelled"), ("OK, NO MORE", "prose"), ("plain prose of a lecture", "prose")]
)
def test_line_kind(spark, line, kind):
    assert one(spark, formulas.line_kind(F.col("t")), t=line) == kind


def test_prose_is_that_of_a_script(spark):
    assert one(spark, formulas.is_formula(F.col("t")), t="speed is = wayoftime") is False
    assert one(spark, formulas.is_formula(F.col("t"), "[а-яА-ЯёЁ]"), t="speed is = wayoftime") is True
    assert one(spark, formulas.is_formula(F.col("t"), "[а-яА-ЯёЁ]"), t="скорость равна > пути") is False


def test_prose_names_its_compounds(spark):
    assert one(spark, formulas.format_line(F.col("t")), t="we added H2SO4, then KOH; OK.") == "we added $\\text{H}_2\\text{SO}_4$, then $\\text{KOH}$; OK."


def test_comparison_table(spark):
    rows = [(1, 0, "Intro line here goes on and on, without an end to it"), (1, 1, "cats versus dogs"), (1, 2, "purr | bark"), (1, 3, "whiskers of the cat"), (1, 4, "tail wags"), (2, 0, " "), (3, 0, "no table")]
    c = exports.Comparison("cats.*dogs", "Cats", "Dogs", ("cat",))
    got = {r.doc_id: r.content for r in exports.markdown(spark.createDataFrame(rows, "doc_id int, pos int, text string"), "T", comparison=c).collect()}
    assert got[1].endswith("### Cats / Dogs\n\n| Cats | Dogs |\n| :--- | :--- |\n| purr | bark |\n| whiskers of the cat | tail wags |\n")
    assert got[2] == f"# T\n\n{exports.NO_TEXT}\n" and "no table" in got[3]
    every = spark.createDataFrame([(2,), (3,), (4,)], "doc_id int")
    got = {r.doc_id: r.content for r in exports.markdown(spark.createDataFrame(rows, "doc_id int, pos int, text string"), "T", documents=every).collect()}
    assert set(got) == {2, 3, 4} and got[2] == f"# T\n\n{exports.NO_TEXT}\n" and got[4] == f"# T\n\n{exports.NO_LINES}\n"


def test_front_matter(spark):
    assert one(spark, exports.front_matter(F.lit("t"), F.lit("s"), F.lit("d"), F.lit("x"))) == "---\ntitle: t\nsubject: s\ndate: d\n---\n\nx"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_pairs_lose_none(spark):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(120)}
    for n in (17, 19, 20, 21, 23, 40):  # about the length at which the keys change
        base = "".join(rng.choices("abcdefgh", k=n))
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice(([], ["z"], [x[k], "y"]))
            words.add("".join(x))
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = {(r.word, r.candidate) for r in distance.near_pairs(df, df).collect()}
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 2 and _edits(a, b) <= 2}
    assert want <= got


def test_folded_keys_reach_look_alikes(spark):
    v = spark.createDataFrame([("moan",), ("zebra",)], "word string")
    got = distance.candidates(spark.createDataFrame([("wean",), ("nocn",)], "word string"), v).collect()
    assert {(r.word, r.candidate, r.dist) for r in got} == {("wean", "moan", 0.4), ("nocn", "moan", 0.4)}


def test_lexicons_are_joined(spark):
    rows = spark.createDataFrame([(1, "Cat dog 7"), (2, "x"), (3, "")], "id int, text string")
    lexicon = spark.createDataFrame([("cat",), ("cow",)], "word string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    digit = lambda w: w.rlike("^[0-9]$")
    assert {(r.id, r.n_words, r.n_valid) for r in metrics.lexicon_counts(rows, words, lexicon, ["id"], digit).collect()} == {(1, 3, 2), (2, 1, 0), (3, 0, 0)}
    large = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word")).union(lexicon)
    d = metrics.lexicon_counts(rows, words, large, ["id"], digit)
    assert {(r.id, r.n_words, r.n_valid) for r in d.collect()} == {(1, 3, 2), (2, 1, 0), (3, 0, 0)}
    assert len(d._jdf.queryExecution().optimizedPlan().toString()) < 10_000


def ngrams(words, keys, n):
    """Counts of n consecutive words by windows."""
    w = Window.partitionBy(*keys).orderBy("k")
    d = words.withColumnRenamed("word", "w1")
    for i in range(1, n):
        d = d.withColumn(f"w{i + 1}", F.lead("w1", i).over(w))
    names = [f"w{i + 1}" for i in range(n)]
    return d.filter(F.col(names[-1]).isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def test_ngrams_agree(spark):
    lines = spark.createDataFrame([(1, 0, "a b a b"), (1, 1, "b"), (2, 0, ""), (2, 1, None), (3, 0, "a b a")], "d int, p int, text string")
    derived = lm.orders(lm.context_counts(lm.contexts(lines, ["d", "p"])))
    for n in (1, 2, 3):
        a, b = lm.ngram_counts(lines, n), ngrams(lm.tokens(lines, ["d", "p"]), ["d", "p"], n)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == sorted(map(tuple, derived[n - 1].collect()))
    plan = lm.ngram_counts(lines, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "lambda" not in plan.split("Generate")[0]


def test_own_counts_score_like_given_ones(spark):
    lines = spark.createDataFrame([(1, 0, "the cat sat on the mat"), (1, 1, "the cat ran"), (2, 0, "a")], "d int, p int, text string")
    x = lm.contexts(lines, ["d", "p"])
    a, b = lm.word_log_prob(x), lm.word_log_prob(x, *(lm.ngram_counts(lines, n) for n in (1, 2, 3)))
    key = lambda r: (r.d, r.p, r.k)
    assert [(key(r), round(r.logp, 9), r.known) for r in sorted(a.collect(), key=key)] == [(key(r), round(r.logp, 9), r.known) for r in sorted(b.collect(), key=key)]


def test_parents_without_children_are_replaced_too(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page int, text string")
    new = spark.createDataFrame([(1, "z")], "page int, text string")
    got = R.replace_children(old, new, "page", spark.createDataFrame([(2,)], "page int"))
    assert {tuple(r) for r in got.collect()} == {(1, "z"), (3, "c")}


def test_study_kit(spark):
    rows = spark.createDataFrame([(1, k, f"line {k}") for k in range(5)], "d int, k int, text string")
    assert plugins.study_kit_fallback(rows, "d", "k").first().answer == "line 0 line 1 line 2"


def test_capitals_are_one_letter(spark):
    """As SQL's upper() has it: ß becomes ẞ, and a letter without a capital of one letter stays."""
    texts = ["ßheit. ßlich! éa? ŉa. ﬁn. ᾳb. a", "ß", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in d.select(T.capitalize_sentences(F.col("t")).alias("t")).collect()]
    assert got == ["ẞheit. ẞlich! Éa? ŉa. ﬁn. ᾼb. A", "ẞ", ""]


def test_blocks_of_many_pairs_are_sorted_in_parts(monkeypatch):
    """A batch of any size is sorted SYMBOLS at a time, with the blocks of the whole."""
    rng = random.Random(4)
    left, right = (pa.array(["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 40))) for _ in range(60)]) for _ in range(2))
    whole = blocks.matching_blocks(*blocks.characters(left), *blocks.characters(right))
    seen, inner = [], blocks._sorted_blocks
    monkeypatch.setattr(blocks, "SYMBOLS", 100)
    monkeypatch.setattr(blocks, "_sorted_blocks", lambda a, fa, b, fb: (seen.append(len(a) + len(b)), inner(a, fa, b, fb))[1])
    parts = blocks.matching_blocks(*blocks.characters(left), *blocks.characters(right))
    assert all((x == y).all() for x, y in zip(whole, parts)) and len(seen) > 10 and max(seen) <= 100


def test_codes_without_a_search_per_letter(spark):
    """Ids of letters come back as they were; each letter is one step of one pass, not a filter and a search of a list."""
    got = one(spark, T.decode(T.encode(F.col("t"), "ab "), "ab "), t="ba xä b")
    assert got == "ba  b" and one(spark, T.encode(F.col("t"), "ab "), t="") == [] and one(spark, T.encode(F.col("t"), "ab "), t="bä a") == [3, 1, 4, 2]
    assert one(spark, T.decode(F.array(*map(F.lit, (0, 1, 2, 5, -1, 3))), "ab "), t="") == "ab"
    plan = spark.range(1).select(T.encode(F.lit("x").substr(F.lit(1), F.col("id").cast("int")), "ab "))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and "filter(" not in plan


def test_words_meet_a_small_lexicon_where_they_stand(spark):
    rows = spark.createDataFrame([(1, "a bb"), (2, ""), (3, "cc a a")], "k int, text string")
    lexicon = spark.createDataFrame([("a",), ("dd",)], "word string").repartition(3).distinct()
    d = metrics.lexicon_counts(rows, F.filter(F.split("text", " "), lambda x: x != ""), lexicon, ["k"], lambda w: w == "bb")
    assert sorted((r.k, r.n_words, r.n_valid) for r in d.collect()) == [(1, 2, 2), (2, 0, 0), (3, 3, 2)]
    assert "BroadcastHashJoin" in d._jdf.queryExecution().sparkPlan().toString()
