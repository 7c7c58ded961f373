"""The registered queries against their SQL, and the pipeline against plain restatements of its stages."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from oracle import assert_same  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillframe.llm import common, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert_same(spark, SF, name, registry.queries()[name], registry.oracle_sql()[name])


def test_names():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]


def good(t):
    (_, n, chars, symbols, dup, repeat, failed), = brute.quality([(0, t)])
    lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
    capitals = sum(c.isupper() for c in t)
    return not (failed or 100 * symbols > 20 * n or 2 * capitals > chars or (lines > 3 and 100 * dup > 50 * lines) or chars > 30 * n or 10 * chars < 15 * n)


def kept_lines(docs):
    """Texts without lines that are alike to an earlier one."""
    exact, place, out, shorter, whole = set(), {}, {}, {}, {}
    for i, t in sorted(docs.items()):
        kept = []
        for line in t.split("\n"):
            w = tuple(brute.WORD.findall(line))
            if w:
                if w in exact:
                    continue
                exact.add(w)
                if len(w) >= 8:
                    less = [w[:k] + w[k + 1 :] for k in range(len(w))]
                    alike = any((k, x) in place for k, x in enumerate(less)) or any(x in whole for x in less) or w in shorter
                    place |= {(k, x): 1 for k, x in enumerate(less)}
                    shorter |= dict.fromkeys(less, 1)
                    whole[w] = 1
                    if alike:
                        continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        seen.append((before, after))
        assert docs.columns == columns or k == 4
    texts = lambda rows: {i: r.text for i, r in rows.items()}
    (a, b), (_, c), (_, d), (_, e), (_, f) = seen
    assert set(b) == {i for i, r in a.items() if good(r.text)} and all(a[i] == b[i] for i in b)
    assert texts(c) == kept_lines(texts(b)) and all(r.n_chars == len(r.text) for r in c.values())
    assert texts(d) == {i: c[i].text for i, _, first in brute.jaccard(list(texts(c).items())) if i == first}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert texts(e) == dict(brute.leaks(list(texts(d).items()), items)[1])
    assert not any(x[-1] for x in brute.leaks(list(texts(e).items()), items)[0])
    assert {i: r["size"] for i, r in f.items()} == {i: len(brute.WORD.findall(t)) for i, t in texts(e).items()}
    by_source = {}
    for i, r in f.items():
        assert 0 <= r.taken <= 2 * r["size"]
        by_source.setdefault(e[i].source, []).append(r)
    assert all(abs(sum(r.taken for r in rs) - rs[0].target) <= 2 for rs in by_source.values())


def test_run_is_stable_and_cleans_up(spark):
    x, y = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert x == y and len(x) > 0
    common.release(spark)
    assert not common.tables(spark)


def test_natives_have_no_python(spark):
    for name in ("op2_source_mixing", "op3_quality_rules", "op6_line_dedup"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
