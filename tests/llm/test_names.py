"""Columns whose names clash with those that the operators use inside, null ids and empty tables, through each operator and the whole pipeline; the secret battery on labelled strings."""

import os
import random
import re
import sys
import uuid

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillframe.llm import common, decontaminate, jaccard_join, line_dedup, mixing, quality_model, quality_rules, secrets_scan, substring_dedup, suffix_dedup, token_count  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["_kept", "_gone", "_first", "first", "_runs", "_items", "row", "kept", "gone", "id", "a.b", "n_words", "runs", "spans", "items", "_s", "_h", "size", "words", "block", "c", "k", "w", "x", "_text", "tick`s"]


@pytest.fixture(scope="module")
def clashing(spark):
    """The documents with columns of such names, some null ids and texts, and rows that repeat."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(3)
    docs = docs.union(some).union(some.withColumn("doc_id", F.lit(None).cast("long"))).union(some.limit(1).withColumn("text", F.lit(None).cast("string")))
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def test_pipeline_keeps_clashing_columns(spark, clashing, tmp_path):
    docs, columns = clashing, clashing.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns and docs.count() > 0
        wrong = [F.col(common.quoted(n)) != F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES]
        for x in wrong:
            assert docs.filter(x | x.isNull()).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_operators_take_clashing_columns(spark, clashing):
    n = clashing.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    reports = [
        substring_dedup.report(clashing), mixing.mix(clashing), quality_rules.report(clashing), suffix_dedup.report(clashing), secrets_scan.report(clashing), line_dedup.report(clashing),
        jaccard_join.join(clashing), token_count.count_tokens(clashing, "piece_bpe_32k.model", 4096), quality_model.classify(clashing, labels), decontaminate.report(clashing, bench),
    ]
    assert [df.count() for df in reports] == [n] * len(reports)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as Fake

    for warehouse in ("file:/home/w", "spark-warehouse", "/home/w"):
        context = Fake(master="yarn", getConf=lambda: Fake(get=lambda key: None))
        conf = Fake(get=lambda key, default=None, w=warehouse: {"spark.sql.warehouse.dir": w}.get(key, default))
        with pytest.raises(RuntimeError):
            common.shared_dir(Fake(conf=conf, sparkContext=context))


def test_sample_is_from_all_over(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    ids = [int(r.text) for r in quality_rules.sampled(docs, 500).collect()]
    assert 350 < len(ids) < 650 and len([i for i in ids if i < 20_000]) > 150 < len([i for i in ids if i >= 20_000])
    assert quality_rules.sampled(docs.limit(7), 500).count() == 7


@pytest.mark.parametrize("text", ["", " ", "a", " a\tb\n\nc\x0bd\x0ce\rf ", "ü ß x", "#a*b$% &|<>", "  x"])
def test_counts_of_words_and_symbols(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(quality_rules.words_of(F.col("text")).alias("w"), quality_rules.count_symbols(F.col("text")).alias("s"), quality_rules.word_chars(quality_rules.words_of(F.col("text"))).alias("c")).first()
    assert got.w == brute.WORD.findall(text) and got.s == sum(x in "#*$%&|<>" for x in text) and got.c == sum(map(len, got.w))


def identifiers(rng, words, n):
    """Names made of words, as code and paths have them."""
    out = []
    while len(out) < n:
        w = [rng.choice(words) for _ in range(rng.randint(3, 6))]
        x = rng.choice(["".join(w), "_".join(w), "-".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper(), "/".join(w) + f"_{rng.randint(1, 2030)}", "".join(x.title() for x in w) + str(rng.randint(1, 99))])
        if len(x) >= 20:
            out.append(x)
    return out


def test_battery_finds_random_strings_of_each_encoding(spark):
    """At least 0.9 of the strings of 24 characters and more (hexadecimal capitals: of 32), and few identifiers."""
    rng = random.Random(17)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    words = sorted({w for w in re.findall("[a-z]+", " ".join(texts).lower()) if 3 <= len(w) <= 9})
    a = secrets_scan.ALPHABETS
    kinds = {k: a[k] for k in ("base64", "base64url", "base32", "lower36", "lower", "upper", "HEX")} | {"base62": a["base64"][:62]}
    tokens = [(k, n, "".join(rng.choice(x) for _ in range(n))) for k, x in kinds.items() for n in (24, 32, 40) for _ in range(20)]
    tokens += [("uuid", 36, str(uuid.UUID(int=rng.getrandbits(128)))) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10_000 + k, f"see {x} there") for k, x in enumerate(identifiers(rng, words, 3000))]
    rows += [(20_000 + k, f"see {x} there") for k, (_, _, x) in enumerate(tokens)]
    got = {r.doc_id: r.spans for r in secrets_scan.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    hits = {}
    for k, (kind, n, x) in enumerate(tokens):
        covered = [s.split(":") for s in got[20_000 + k].split(",") if s]
        hits.setdefault((kind, n), []).append(any(min(int(e), 4 + n) - max(int(b), 4) >= 0.9 * n for _, b, e in covered))
    low = {k: sum(v) / len(v) for k, v in hits.items() if sum(v) < 0.9 * len(v) and k != ("HEX", 24)}
    assert not low, low
    wrong = sum("random" in got[10_000 + k] for k in range(3000))
    assert wrong <= 3


def test_step_up_is_that_of_the_definition(spark):
    rng = random.Random(8)
    rows = [(k, [(0, 9, rng.choice(["a:5", "b:6"]), rng.choice([0, 1, 2, 3, 9, 12, 14, 20, 30]))] * rng.randint(0, 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, more array<struct<s:int,e:int,c:string,b:int>>")
    for rate in (0.2, 0.01, 0.001, 1e-9):
        got = {r.c: r.least_bin for r in secrets_scan.thresholds(df, rate).collect()}
        for c in ("a:5", "b:6"):
            bins = sorted((m[3] for _, ms in rows for m in ms if m[2] == c), reverse=True)
            found = [b for k, b in enumerate(bins, 1) if 2.0**-b <= rate * k / len(bins)]
            assert got.get(c) == (min(found) if found else None)


def test_letter_pairs(spark):
    df = common.keyed(spark.createDataFrame([(1, "abAb aaaa b"), (2, "ü ba"), (3, None), (4, "a"), (5, "b")], "doc_id long, text string").coalesce(1))
    n = secrets_scan.letter_pairs(df)
    assert n[0, 1] == 2 and n[1, 0] == 1 and n[0, 0] == 1 and n.sum() == 4
