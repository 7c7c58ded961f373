"""The engine's queries over the test tables, and the DuckDB SQL that states their rows.

Where a query needs lines, documents split at line breaks give them; `variant` lines carry
deterministic edits, stated in the same way on both sides, so that every branch is met.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillframe.functions import arrays as A, formulas, text as T
from quillframe.operators import decoding, distance, exports, language_model as lm, metrics, page_geometry as G, plugins, profiles, relational as R, sequence as S, services
from quillframe.sources.tables import lines, table, variants, words

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
FLAGSHIP = "doc_line_profile"


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
VARIANTS = (
    LINES
    + """, v AS (SELECT doc_id, pos, CASE (doc_id + pos) % 9 WHEN 0 THEN text || 'a-' WHEN 1 THEN '- ' || text WHEN 2 THEN '1. ' || text WHEN 3 THEN text || ':' WHEN 4 THEN ''
 WHEN 5 THEN lower(substring(text, 1, 1)) || substring(text, 2) WHEN 6 THEN text || ' of' WHEN 7 THEN 'x = y + ' || text ELSE regexp_replace(text, '\\.+$', '') END AS text FROM lines)"""
)
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
BOX = "(pos % 5) * 35 AS bbox_x, 18 + pos % 17 AS bbox_h, (doc_id * 31 + pos * 17) % 100 / 100.0::DOUBLE AS confidence"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "documents"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return variants(_lines(spark, d))


def _boxed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "bbox_x": F.col("pos") % 5 * 35, "bbox_y": F.col("pos") * 40, "bbox_w": F.length("text") * 8 + 1, "bbox_h": 18 + F.col("pos") % 17,
        "confidence": ((F.col("doc_id") * 31 + F.col("pos") * 17) % 100) / F.lit(100.0),
    })


_MARKS = " + ".join(f"CAST(contains(s, '{m}') AS INTEGER)" for m in T.MATH_MARKS)
_TYPE = f"""CASE WHEN s = '' THEN 'empty' WHEN ({_MARKS}) >= 2 OR (({_MARKS}) >= 1 AND (contains(s, '=') OR contains(s, '^'))) THEN 'math'
 WHEN bbox_h > avg_h * 1.35 AND length(s) < 60 THEN 'h1'
 WHEN regexp_matches(lower(s), '^({"|".join(T.HEADINGS)})([^\\p{{L}}]|$)') OR regexp_matches(s, '^\\d+(\\.\\d+)*\\s+\\p{{Lu}}') THEN 'h2'
 WHEN ends_with(s, ':') AND length(s) < 50 THEN 'h2'
 WHEN regexp_matches(s, '^[-*•–—]\\s+') OR regexp_matches(s, '^\\d+[.)]\\s+') OR regexp_matches(s, '^\\p{{L}}[.)]\\s+') THEN 'bullet' ELSE 'paragraph' END"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(_variants(spark, d)).withColumn("line_type", T.line_type(F.col("text"), F.col("bbox_h"), F.lit(22.0)))


_CLASSIFIED = f"{VARIANTS}, c AS (SELECT doc_id, pos, text, {_TYPE} AS line_type FROM (SELECT *, {STRIP.format('text')} AS s, 18 + pos % 17 AS bbox_h, 22.0 AS avg_h FROM v))"
_INFORMATIVE = "(s <> '' AND (length(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')) > 1 OR regexp_matches(s, '^\\p{Nd}+$')))"


@query(
    f"""WITH {_CLASSIFIED}, t AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (line_type = 'math') AS n_math, COUNT(*) FILTER (line_type IN ('h1', 'h2')) AS n_heads,
 COUNT(*) FILTER (line_type = 'bullet') AS n_bullets, COUNT(*) FILTER ({_INFORMATIVE.replace("s ", "x ").replace("(s,", "(x,").replace("s,", "x,")}) AS n_informative
 FROM (SELECT *, {STRIP.format("text")} AS x FROM c) GROUP BY doc_id)
SELECT t.*, l.quality FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id ORDER BY n_lines DESC, t.doc_id LIMIT 20"""
)
def doc_line_profile(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: line types and informative lines per document with its label, the twenty longest first."""
    n = _classified(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("line_type") == "math").alias("n_math"),
        F.count_if(F.col("line_type").isin("h1", "h2")).alias("n_heads"),
        F.count_if(F.col("line_type") == "bullet").alias("n_bullets"),
        F.count_if(T.informative(F.col("text"))).alias("n_informative"),
    )
    out = n.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.scan_page(out, [F.desc("n_lines"), "doc_id"], 0, 20)


@query(f"WITH {_CLASSIFIED} SELECT doc_id, pos, line_type FROM c")
def line_explode_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("doc_id", "pos", "line_type")


@query("SELECT * FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def scan_page(spark: SparkSession, d: str) -> DataFrame:
    return R.scan_page(table(spark, d, "documents"), ["doc_id"], 50, 100)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 100")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.point(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    """SELECT o_orderkey, o_custkey, o_orderdate, (SELECT COUNT(o_orderkey) FROM orders) AS total FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20"""
)
def list_recent_paged(spark: SparkSession, d: str) -> DataFrame:
    """A filtered page, with the unfiltered total."""
    orders = table(spark, d, "orders")
    page = R.list_recent(orders, [F.desc("o_orderdate"), "o_orderkey"], 20, 20, "o_orderstatus", "F").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.with_total(page, orders, "o_orderkey")


@query("SELECT COUNT(doc_id) AS n FROM documents")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("doc_id").alias("n"))


@query(
    """SELECT c.c_custkey, CAST(row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity) AS INTEGER) AS item, o.o_orderkey, l.l_linenumber, l.l_quantity
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""
)
def eager_load_flat(spark: SparkSession, d: str) -> DataFrame:
    """Parents, children and grandchildren in one nested load, then flattened again in order."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    orders = R.nested(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), items, "o_orderkey", "l_linenumber", "items")
    tree = R.nested(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", "orders")
    flat = tree.select("c_custkey", F.explode_outer("orders").alias("o")).select("c_custkey", "o.o_orderkey", F.explode_outer("o.items").alias("l"))
    w = S.Window.partitionBy("c_custkey").orderBy(F.asc_nulls_last("o_orderkey"), "l.l_linenumber", "l.l_partkey", "l.l_quantity")
    return flat.select("c_custkey", F.row_number().over(w).alias("item"), "o_orderkey", "l.l_linenumber", "l.l_quantity")


@query(
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    return S.latest(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL
SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1"""
)
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    """Of each seventh order the lines give way to its first line; orders without one lose all the same, so the parents are named."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    of = old.filter("l_orderkey % 7 = 0")
    new = of.filter("l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return R.replace_children(old, new, "l_orderkey", of.select("l_orderkey"))


@query(
    """SELECT 'customer' AS tab, COUNT(*) AS n FROM customer WHERE c_custkey % 10 <> 3 UNION ALL
SELECT 'orders', COUNT(*) FROM orders WHERE o_custkey % 10 <> 3 UNION ALL
SELECT 'lineitem', COUNT(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 10 = 3)"""
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    customer, orders, items = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    gone = customer.filter("c_custkey % 10 = 3").select("c_custkey")
    left = R.cascade_delete(gone, [(customer, "c_custkey", "c_custkey"), (orders, "o_orderkey", "o_custkey"), (items, "l_linenumber", "l_orderkey")])
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tab"), "n") for t, df in zip(("customer", "orders", "lineitem"), left, strict=True)]
    return out[0].union(out[1]).union(out[2])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders"""
)
def patch_update(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 2).alias("o_totalprice"))
    return R.patch(o, changes, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, 'NEW' FROM region WHERE r_regionkey < 2")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    new = r.filter("r_regionkey < 2").select((F.col("r_regionkey") + 10).alias("r_regionkey"))
    return R.insert(r, new, r_name=F.lit("NEW"))


@query(
    f"""WITH {LINES}, f1 AS (SELECT doc_id, pos, 'id ' || pos AS c FROM lines WHERE pos % 4 = 0), f2 AS (SELECT doc_id, pos AS idx, 'index ' || pos AS c FROM lines WHERE pos % 6 = 0)
SELECT l.doc_id, l.pos, COALESCE(f1.c, f2.c) AS corrected FROM lines l LEFT JOIN f1 ON l.doc_id = f1.doc_id AND l.pos = f1.pos LEFT JOIN f2 ON l.doc_id = f2.doc_id AND l.pos = f2.idx"""
)
def fallback_match(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by line, else by index."""
    rows = _lines(spark, d).select("doc_id", "pos", F.col("pos").alias("idx"))
    by_id = rows.filter("pos % 4 = 0").select("doc_id", "pos", F.lit(None).cast("int").alias("idx"), F.concat(F.lit("id "), "pos").alias("corrected"))
    by_index = rows.filter("pos % 6 = 0").select("doc_id", F.lit(None).cast("int").alias("pos"), "idx", F.concat(F.lit("index "), "idx").alias("corrected"))
    return R.fallback_match(rows, by_id.union(by_index), ["doc_id", "pos"], ["doc_id", "idx"], "corrected").select("doc_id", "pos", "corrected")


@query(
    f"""WITH {LINES}, l AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM lines), b AS (SELECT doc_id, n // 30 AS chunk, n % 30 AS place, pos + 3 AS line_index FROM l),
c AS (SELECT doc_id, chunk, place AS own, CASE place % 5 WHEN 0 THEN NULL WHEN 1 THEN line_index WHEN 2 THEN place WHEN 3 THEN 100000 ELSE -1 END AS raw FROM b),
t AS (SELECT c.doc_id, c.chunk, c.own, COALESCE(x.line_index, y.line_index, z.line_index) AS line_index FROM c
 LEFT JOIN b x ON c.doc_id = x.doc_id AND c.chunk = x.chunk AND x.line_index = COALESCE(raw, own) LEFT JOIN b y ON c.doc_id = y.doc_id AND c.chunk = y.chunk AND y.place = COALESCE(raw, own)
 LEFT JOIN b z ON c.doc_id = z.doc_id AND c.chunk = z.chunk AND z.place = c.own)
SELECT doc_id, chunk::INT AS chunk, line_index::INT AS line_index, 'fix ' || MAX(own) AS corrected_text FROM t WHERE line_index IS NOT NULL GROUP BY doc_id, chunk, line_index"""
)
def batch_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by index, else by the place they name, else by their own place in the reply."""
    asked = plugins.request_chunks(_lines(spark, d).select("doc_id", "pos"), "doc_id", "pos").withColumn("line_index", (F.col("pos") + 3).cast("int"))
    k = F.col("place") % 5
    raw = F.when(k == 1, F.col("line_index")).when(k == 2, F.col("place")).when(k == 3, 100000).when(k == 4, -1)
    replies = asked.select("doc_id", "chunk", F.col("place").alias("pos"), raw.alias("raw"), F.concat(F.lit("fix "), "place").alias("corrected_text"))
    return plugins.resolved(replies, asked, ["doc_id", "chunk"])


@query("SELECT *, 'default' AS author, 0::BIGINT AS size FROM region")
def migrated_columns(spark: SparkSession, d: str) -> DataFrame:
    schema = StructType.fromDDL("r_name string, author string, size bigint")
    return R.migrated(table(spark, d, "region"), schema, author=F.lit("default"), size=F.lit(0))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5"""
)
def largest_five(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")]
    return S.top(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey"], order)


@query(
    """SELECT 'quantity' AS "check", COUNT(*) FILTER (NOT l_quantity < 45) AS n FROM lineitem UNION ALL SELECT 'discount', COUNT(*) FILTER (NOT (l_discount >= 0 AND l_discount <= 0.08)) FROM lineitem
UNION ALL SELECT 'flag', COUNT(*) FILTER (NOT l_returnflag IN ('A', 'N')) FROM lineitem"""
)
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return R.violations(table(spark, d, "lineitem"), {"quantity": F.col("l_quantity") < 45, "discount": F.col("l_discount").between(0, 0.08), "flag": F.col("l_returnflag").isin("A", "N")})


@query(f"WITH {VARIANTS} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS line_index FROM (SELECT *, {STRIP.format('text')} AS s FROM v) WHERE {_INFORMATIVE}")
def informative_renumber(spark: SparkSession, d: str) -> DataFrame:
    return S.renumbered(_variants(spark, d), T.informative(F.col("text"))).select("doc_id", "pos", "line_index")


@query(
    f"""WITH {VARIANTS}, p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' ELSE 'UPLOADED' END AS status FROM documents),
n AS (SELECT doc_id, COUNT(*) AS lines, COUNT(*) FILTER (text <> '') AS done FROM v GROUP BY doc_id)
SELECT p.doc_id, status, COALESCE(lines, 0) AS lines, COALESCE(done, 0) AS done, round(CASE status WHEN 'COMPLETED' THEN 100.0 WHEN 'PROCESSING' THEN CASE WHEN COALESCE(lines, 0) = 0 THEN 50.0 ELSE 100.0 * done / lines END
WHEN 'FAILED' THEN 0.0 ELSE 10.0 END::DOUBLE, 6) AS percent FROM p LEFT JOIN n ON p.doc_id = n.doc_id"""
)
def progress_by_doc(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    pages = table(spark, d, "documents").select("doc_id", F.when(k == 0, "COMPLETED").when(k == 1, "PROCESSING").when(k == 2, "FAILED").otherwise("UPLOADED").alias("status"))
    return R.progress(pages, _variants(spark, d), "doc_id").withColumn("percent", F.round("percent", 6))


#: How often a word stands at least to be in the lexicon.
COMMON = 20
_LEXICON = f"lexicon AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS word FROM documents) GROUP BY word HAVING COUNT(*) >= {COMMON})"


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The words that stand often in the documents."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), 0)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).select("word")


@query(f"WITH {_LEXICON} SELECT word FROM lexicon")
def lexicon_scan(spark: SparkSession, d: str) -> DataFrame:
    return _lexicon(spark, d)


_EDGES = "regexp_replace(w, '^[.,;:!?()\\-\"'']+|[.,;:!?()\\-\"'']+$', '', 'g')"
_CALIBRATED = f"""{VARIANTS}, {_LEXICON}, s AS (SELECT doc_id, pos, text, {STRIP.format("text")} AS s, {BOX} FROM v),
ws AS (SELECT doc_id, pos, {_EDGES} AS w FROM (SELECT doc_id, pos, unnest(regexp_split_to_array(s, '\\s+')) AS w FROM s)),
n AS (SELECT doc_id, pos, COUNT(*) AS n_words, COUNT(*) FILTER (l.word IS NOT NULL OR regexp_matches(w, '^\\p{{Nd}}+$') OR length(w) = 1 OR (length(w) >= 3 AND regexp_matches(w, '[$=+\\-_^{{}}()\\\\/]'))) AS n_valid
 FROM ws LEFT JOIN lexicon l ON lower(w) = l.word WHERE w <> '' GROUP BY doc_id, pos),
j AS (SELECT s.*, COALESCE(n_words, 0) AS nw, COALESCE(n_valid, 0) AS nv, COALESCE(n_valid, 0)::DOUBLE / greatest(COALESCE(n_words, 0), 1) AS ratio, length(text) - length(replace(text, '.', '')) AS dots FROM s LEFT JOIN n ON s.doc_id = n.doc_id AND s.pos = n.pos),
cal AS (SELECT doc_id, pos, round(CASE WHEN s = '' THEN 0.0 WHEN nw = 0 THEN greatest(0.10, least(0.35, confidence * 0.4)) ELSE greatest(0.10, least(0.99, confidence * 0.25 + confidence * 0.75 * ratio
 - (CASE WHEN regexp_matches(text, '[|/\\\\]') THEN 0.15 ELSE 0.0 END + CASE WHEN contains(text, 'I.') THEN 0.15 ELSE 0.0 END
 + CASE WHEN dots >= 3 AND nw >= 3 AND dots::DOUBLE / greatest(nw, 1) > 0.35 THEN 0.20 ELSE 0.0 END + CASE WHEN ratio < 0.4 THEN 0.25 ELSE 0.0 END))) END::DOUBLE + 1e-9, 6) AS calibrated FROM j)"""


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    v = _boxed(_variants(spark, d)).select("doc_id", "pos", "text", "confidence")
    j = metrics.lexicon_counts(v, T.edge_stripped_words(F.col("text")), _lexicon(spark, d), ["doc_id", "pos"], T.valid_shape)
    return j.select("doc_id", "pos", F.round(T.calibrated(F.col("text"), F.col("confidence"), F.col("n_words"), F.col("n_valid")) + F.lit(1e-9), 6).alias("calibrated"))


@query(f"WITH {_CALIBRATED} SELECT * FROM cal")
def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d)


@query(f"WITH {_CALIBRATED} SELECT CASE WHEN calibrated >= 0.80 THEN 'high' WHEN calibrated >= 0.55 THEN 'medium' ELSE 'low' END AS band, COUNT(*) AS n FROM cal GROUP BY 1")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).groupBy(metrics.band(F.col("calibrated")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT doc_id, round(avg((doc_id * 31 + pos * 17) % 100 / 100.0::DOUBLE) * 100, 6) AS percent FROM lines GROUP BY doc_id")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_percent(_boxed(_lines(spark, d)), ["doc_id"], "confidence").withColumn("percent", F.round("percent", 6))


#: Our own subjects and their words.
SUBJECTS = [("articles", 0, ("the", "that", "this")), ("french", 1, ("les", "des", "dans")), ("german", 2, ("und", "der", "nicht")), ("spanish", 3, ("los", "del", "por"))]
_RULES = ", ".join(f"('{d}', {o}, '{k}')" for d, o, ks in SUBJECTS for k in ks)


@query(
    f"""WITH r(domain, ord, keyword) AS (VALUES {_RULES}), n AS (SELECT doc_id, domain, ord, COUNT(*) AS hits FROM documents, r WHERE contains(lower(text), keyword) GROUP BY doc_id, domain, ord),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) AS rn FROM n)
SELECT d.doc_id, CASE WHEN COALESCE(hits, 0) >= 2 THEN domain ELSE 'general' END AS domain, COALESCE(hits, 0) AS hits FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND rn = 1"""
)
def domain_argmax(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(s, o, k) for s, o, ks in SUBJECTS for k in ks], "domain string, ord int, keyword string")
    return metrics.domain(table(spark, d, "documents").select("doc_id", "text"), "doc_id", rules)


@query(
    f"""WITH {LINES}, {_LEXICON}, w AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM lines)
SELECT doc_id, pos, COUNT(*) AS n_words, COUNT(*) FILTER (length(w.word) <= 2 OR l.word IS NOT NULL) AS n_valid FROM w LEFT JOIN lexicon l ON w.word = l.word GROUP BY doc_id, pos"""
)
def valid_word_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _valid(_lines(spark, d), "text", _lexicon(spark, d)).filter("n_words > 0").select("doc_id", "pos", "n_words", "n_valid")


def _valid(rows: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    w = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), 0)
    return metrics.lexicon_counts(rows, w, lexicon, ["doc_id", "pos"], lambda x: F.length(x) <= 2)


_NORM = "string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"


@query(
    f"""WITH t AS (SELECT a.conv_id, a.turn, list_distinct(list_filter({_NORM.format("a.text")}, lambda x: length(x) > 2)) AS a, list_distinct(list_filter({_NORM.format("b.text")}, lambda x: length(x) > 2)) AS b
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1), 3) AS recall FROM t"""
)
def token_recall(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("found"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.token_recall(F.col("text"), F.col("found")), 3).alias("recall"))


_TOKENS = f"{LINES}, tok AS (SELECT doc_id, pos, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> ''), 1) - 1 AS k FROM lines)"
_WIN = "WINDOW w AS (PARTITION BY doc_id, pos ORDER BY k)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return lm.tokens(_lines(spark, d), ["doc_id", "pos"])


@query(f"WITH {_TOKENS} SELECT word AS w1, COUNT(*) AS n FROM tok GROUP BY word")
def ngram_counts_1(spark: SparkSession, d: str) -> DataFrame:
    return lm.ngram_counts(_lines(spark, d), 1)


@query(f"WITH {_TOKENS} SELECT w1, w2, COUNT(*) AS n FROM (SELECT word AS w1, lead(word) OVER w AS w2 FROM tok {_WIN}) WHERE w2 IS NOT NULL GROUP BY w1, w2")
def ngram_counts_2(spark: SparkSession, d: str) -> DataFrame:
    return lm.ngram_counts(_lines(spark, d), 2)


@query(f"WITH {_TOKENS} SELECT w1, w2, w3, COUNT(*) AS n FROM (SELECT word AS w1, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM tok {_WIN}) WHERE w3 IS NOT NULL GROUP BY w1, w2, w3")
def ngram_counts_3(spark: SparkSession, d: str) -> DataFrame:
    return lm.ngram_counts(_lines(spark, d), 3)


_TRI = "tri AS (SELECT tri, CAST(SUM(c) AS BIGINT) AS n FROM (SELECT c, substring('^^' || word || '$$', CAST(unnest(range(1, length(word) + 3)) AS INTEGER), 3) AS tri FROM (SELECT word, COUNT(*) AS c FROM tok GROUP BY word)) GROUP BY tri)"


@query(f"WITH {_TOKENS}, {_TRI} SELECT tri, n FROM tri")
def char_trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return lm.char_trigrams(_tokens(spark, d))


@query(
    f"""WITH {_TOKENS}, {_TRI}, u AS (SELECT DISTINCT word FROM tok), g AS (SELECT word, substring('^^' || word || '$$', CAST(unnest(range(1, length(word) + 3)) AS INTEGER), 3) AS tri FROM u),
m AS (SELECT word, avg(ln(greatest(1e-12, (COALESCE(n, 0) + 0.01) / ((SELECT SUM(n) FROM tri) + 50.0)))) AS m FROM g LEFT JOIN tri USING (tri) GROUP BY word)
SELECT word, round(CASE WHEN length(word) < 3 OR NOT regexp_matches(word, '[a-z]') THEN 0.0 WHEN m < -9 THEN (m + 9) * 2.5 ELSE 0.0 END::DOUBLE, 6) AS penalty FROM m"""
)
def gibberish_penalty(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return lm.gibberish_penalty(t.select("word").distinct(), lm.char_trigrams(t)).withColumn("penalty", F.round("penalty", 6))


_COUNTS = f"uni AS (SELECT word AS w1, COUNT(*) AS n FROM tok GROUP BY word), bi AS (SELECT w1, w2, COUNT(*) AS n FROM (SELECT word AS w1, lead(word) OVER w AS w2 FROM tok {_WIN}) WHERE w2 IS NOT NULL GROUP BY w1, w2), tr AS (SELECT w1, w2, w3, COUNT(*) AS n FROM (SELECT word AS w1, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM tok {_WIN}) WHERE w3 IS NOT NULL GROUP BY w1, w2, w3)"


@query(
    f"""WITH {_TOKENS}, {_COUNTS}, x AS (SELECT doc_id, pos, k, word, lag(word) OVER w AS p1, lag(word, 2) OVER w AS p2 FROM tok {_WIN}), q AS (SELECT SUM(n) AS N, greatest(1000, COUNT(*)) AS V FROM uni),
y AS (SELECT x.*, (COALESCE(u.n, 0) + 0.1::DOUBLE) / (q.N + 0.1::DOUBLE * q.V) AS u, u1.n AS c1, b.n AS c12, b2.n AS c21, t.n AS c123 FROM x CROSS JOIN q LEFT JOIN uni u ON x.word = u.w1 LEFT JOIN uni u1 ON x.p1 = u1.w1
 LEFT JOIN bi b ON x.p1 = b.w1 AND x.word = b.w2 LEFT JOIN bi b2 ON x.p2 = b2.w1 AND x.p1 = b2.w2 LEFT JOIN tr t ON x.p2 = t.w1 AND x.p1 = t.w2 AND x.word = t.w3),
z AS (SELECT *, CASE WHEN c1 > 0 THEN 0.7::DOUBLE * COALESCE(c12, 0) / c1 + 0.3::DOUBLE * u ELSE u END AS b FROM y)
SELECT doc_id, pos, CAST(k AS INTEGER) AS k, round(ln(greatest(1e-12, CASE WHEN c21 > 0 THEN 0.6::DOUBLE * COALESCE(c123, 0) / c21 + 0.4::DOUBLE * b ELSE b END)), 6) AS logp FROM z"""
)
def word_logprob(spark: SparkSession, d: str) -> DataFrame:
    return lm.own_log_prob(_lines(spark, d), ["doc_id", "pos"]).select("doc_id", "pos", "k", F.round("logp", 6).alias("logp"))


_CONV = """c AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM conversations),
tok AS (SELECT conv_id AS doc_id, turn AS pos, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM c)"""


@query(
    f"""WITH {_CONV}, {_TRI}, {_COUNTS}, d AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS pw, regexp_extract(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '(\\S+)\\s*$', 1) AS tail FROM c),
e AS (SELECT conv_id, turn, w, COALESCE(pw, []) AS pw, CASE WHEN regexp_matches(tail, '[-.]$') THEN regexp_replace(lower(tail), '[^\\p{{L}}\\p{{N}}]', '', 'g') END AS stem FROM d),
f AS (SELECT *, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM e),
x AS (SELECT conv_id, turn, k, word, CASE WHEN k = 0 AND stem <> '' THEN stem || word END AS whole, CASE WHEN k = 0 THEN pw[-1] ELSE w[k] END AS p1, CASE WHEN k = 0 THEN CASE WHEN len(pw) >= 2 THEN pw[-2] END WHEN k >= 2 THEN w[k - 1] END AS p2 FROM f),
q AS (SELECT SUM(n) AS N, greatest(1000, COUNT(*)) AS V FROM uni),
y AS (SELECT x.*, u.n > 0 AS known, (COALESCE(u.n, 0) + 0.1::DOUBLE) / (q.N + 0.1::DOUBLE * q.V) AS u, u1.n AS c1, b.n AS c12, b2.n AS c21, t.n AS c123, wu.n IS NOT NULL AS wk FROM x CROSS JOIN q LEFT JOIN uni u ON x.word = u.w1 LEFT JOIN uni u1 ON x.p1 = u1.w1
 LEFT JOIN bi b ON x.p1 = b.w1 AND x.word = b.w2 LEFT JOIN bi b2 ON x.p2 = b2.w1 AND x.p1 = b2.w2 LEFT JOIN tr t ON x.p2 = t.w1 AND x.p1 = t.w2 AND x.word = t.w3 LEFT JOIN uni wu ON x.whole = wu.w1),
z AS (SELECT *, CASE WHEN c1 > 0 THEN 0.7::DOUBLE * COALESCE(c12, 0) / c1 + 0.3::DOUBLE * u ELSE u END AS b FROM y),
ud AS (SELECT DISTINCT word FROM (SELECT word FROM x UNION ALL SELECT whole FROM x WHERE whole IS NOT NULL)), g AS (SELECT word, substring('^^' || word || '$$', CAST(unnest(range(1, length(word) + 3)) AS INTEGER), 3) AS tri FROM ud),
m AS (SELECT word, avg(ln(greatest(1e-12, (COALESCE(n, 0) + 0.01) / ((SELECT SUM(n) FROM tri) + 50.0)))) AS m FROM g LEFT JOIN tri USING (tri) GROUP BY word),
pen AS (SELECT word, CASE WHEN length(word) < 3 OR NOT regexp_matches(word, '[a-z]') THEN 0.0 WHEN m < -9 THEN (m + 9) * 2.5 ELSE 0.0 END::DOUBLE AS pen FROM m),
s AS (SELECT z.conv_id, z.turn, SUM(ln(greatest(1e-12, CASE WHEN c21 > 0 THEN 0.6::DOUBLE * COALESCE(c123, 0) / c21 + 0.4::DOUBLE * b ELSE b END)) + COALESCE(a.pen, 0) + CASE WHEN known THEN 1.2::DOUBLE ELSE 0.0 END + CASE WHEN wk OR (length(whole) >= 5 AND v.pen = 0) THEN 3.5::DOUBLE ELSE 0.0 END) AS s
 FROM z LEFT JOIN pen a ON z.word = a.word LEFT JOIN pen v ON z.whole = v.word GROUP BY z.conv_id, z.turn)
SELECT c.conv_id, c.turn, round(CASE WHEN trim(c.text) = '' THEN -10.0::DOUBLE ELSE COALESCE(s.s, -5.0::DOUBLE) END, 6) AS score FROM c LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn"""
)
def sequence_score(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    counts = [n.persist() for n in lm.orders(lm.context_counts(lm.contexts(c, ["conv_id", "turn"])).persist())]  # asked in several places: made once
    return lm.score_lines(c, "conv_id", "turn", *counts, lm.weighted_trigrams(counts[0])).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {VARIANTS}, c AS (SELECT doc_id, pos AS line, 0 AS i, text, (doc_id + pos) % 10 / 10.0::DOUBLE AS ocr, (doc_id * 7 + pos) % 10 / 10.0::DOUBLE AS lm FROM lines UNION ALL
SELECT doc_id, pos, 1, text, (doc_id * 3 + pos) % 10 / 10.0::DOUBLE, (doc_id + pos * 5) % 10 / 10.0::DOUBLE FROM v),
s AS (SELECT *, trim(text) <> '' AS ok, 0.65::DOUBLE * ocr + 0.35::DOUBLE * lm + 0.2::DOUBLE * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS total FROM c)
SELECT doc_id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY ok DESC, CASE WHEN ok THEN total END DESC NULLS LAST, i) AS r FROM s) WHERE r = 1"""
)
def rescore_best(spark: SparkSession, d: str) -> DataFrame:
    def tenths(a: int, b: int):
        return ((F.col("doc_id") * a + F.col("pos") * b) % 10) / F.lit(10.0)

    a = _lines(spark, d).select("doc_id", F.col("pos").alias("line"), F.lit(0).alias("i"), "text", tenths(1, 1).alias("ocr"), tenths(7, 1).alias("lm"))
    b = _variants(spark, d).select("doc_id", F.col("pos").alias("line"), F.lit(1).alias("i"), "text", tenths(3, 1).alias("ocr"), tenths(1, 5).alias("lm"))
    return lm.rescore(a.union(b).withColumnRenamed("i", "pos"), ["doc_id", "line"])


_ASKED = "q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()


@query(f"WITH {_ASKED}, {_LEXICON} SELECT word, v AS candidate, levenshtein(word, x) AS dist FROM (SELECT q.word, v.word AS v, regexp_replace(v.word, '[^a-z]', '#', 'g') AS x FROM q JOIN lexicon v ON abs(length(q.word) - length(v.word)) <= 2) WHERE levenshtein(word, x) <= 2")
def candidates_in_band(spark: SparkSession, d: str) -> DataFrame:
    """All words of the lexicon within two plain edits of each word of the benchmark. The SQL counts edits by byte, so it has one mark for each other letter; none equals one of the asked words."""
    near = distance.near_pairs(_asked(spark, d), _lexicon(spark, d)).withColumn("dist", F.levenshtein("word", "candidate", 2).cast("long"))
    return near.filter("dist >= 0")


_FOLD = "translate(lower({0}), '" + "".join(g[1:] for g in distance.LOOKALIKES) + "', '" + "".join(g[0] * (len(g) - 1) for g in distance.LOOKALIKES) + "')"
#: Cells of the distance table one after the other, row by row: cell k stands under cell k - m, m the letters of the candidate and one more.
_WEIGHED = f"""p AS (SELECT a, b, length(b) + 1 AS m, (length(a) + 1) * (length(b) + 1) AS cells FROM (SELECT w.word AS a, v.word AS b FROM new w JOIN lexicon v ON abs(length(w.word) - length(v.word)) <= 2) WHERE levenshtein(regexp_replace({_FOLD.format("a")}, '[^a-z]', '#', 'g'), regexp_replace({_FOLD.format("b")}, '[^a-z]', '#', 'g')) <= 2),
t AS (SELECT a, b, m, cells, 1 AS k, [0.0::DOUBLE] AS x FROM p UNION ALL SELECT a, b, m, cells, k + 1, list_append(x, CASE WHEN k < m THEN x[k] + 1 WHEN k % m = 0 THEN x[k - m + 1] + 1 ELSE least(x[k] + 1, x[k - m + 1] + 1,
 x[k - m] + CASE WHEN substring(a, k // m, 1) = substring(b, k % m, 1) THEN 0.0 WHEN {_FOLD.format("substring(a, k // m, 1)")} = {_FOLD.format("substring(b, k % m, 1)")} AND lower(substring(a, k // m, 1)) <> lower(substring(b, k % m, 1)) THEN 0.2 ELSE 1.0 END) END::DOUBLE) FROM t WHERE k < cells),
near AS (SELECT a AS word, b AS candidate, greatest(0.0, 1 - x[k] / greatest(1, length(b))) AS score, x[k] AS dist FROM t WHERE k = cells AND x[k] <= 2.2)"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, dist, candidate DESC) AS rank FROM near)"


@query(
    f"""WITH RECURSIVE {_ASKED}, {_LEXICON}, w AS (SELECT word FROM q WHERE length(word) >= 3), new AS (SELECT word FROM w WHERE word NOT IN (SELECT word FROM lexicon)), {_WEIGHED}, {_RANKED}
SELECT word, CAST(rank AS INTEGER) AS rank, candidate, round_even(score, 3) AS score, round_even(dist, 2) AS dist FROM ranked WHERE rank <= 3 UNION ALL SELECT word, 1, word, 1.0, 0.0 FROM w WHERE word IN (SELECT word FROM lexicon)"""
)
def candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best by weighted distance."""
    return distance.candidates(_asked(spark, d), _lexicon(spark, d))


_BODY = "regexp_replace(token, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')"


@query(
    f"""WITH RECURSIVE {_LEXICON}, k AS (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS token, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS k FROM benchmark),
b AS (SELECT *, {_BODY} AS body FROM k), c AS (SELECT *, CASE WHEN NOT regexp_matches(token, '[$\\\\]') AND NOT (token = upper(token) AND length(token) <= 3) AND regexp_matches(body, '^\\p{{L}}+$') THEN lower(body) END AS word FROM b),
new AS (SELECT DISTINCT word FROM c WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM lexicon)), {_WEIGHED}, {_RANKED},
r AS (SELECT word, candidate FROM ranked WHERE rank = 1 AND (round_even(dist, 2) <= 1.6 OR round_even(score, 3) >= 0.70)),
n AS (SELECT item_id, k, token, CASE WHEN candidate IS NULL THEN token ELSE regexp_extract(token, '^([^\\p{{L}}]*)', 1) || CASE WHEN substring(body, 1, 1) = upper(substring(body, 1, 1)) THEN upper(substring(candidate, 1, 1)) || substring(candidate, 2) ELSE candidate END || regexp_extract(token, '([^\\p{{L}}]*)$', 1) END AS new FROM c LEFT JOIN r ON c.word = r.word)
SELECT item_id, string_agg(new, ' ' ORDER BY k) AS text, lower(string_agg(new, ' ' ORDER BY k)) <> lower(string_agg(token, ' ' ORDER BY k)) AS changed FROM n GROUP BY item_id"""
)
def corrected_lines(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's texts, unknown words corrected by the lexicon."""
    tokens = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\\s+")).alias("k", "token"))
    lexicon = _lexicon(spark, d)
    return distance.corrected_lines(tokens, lexicon, lexicon, ["item_id"])


@query("SELECT a.p_brand, round(100.0 * SUM(levenshtein(a.p_name, b.p_name)) / SUM(greatest(1, length(b.p_name))), 6) AS cer FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 GROUP BY a.p_brand")
def cer_micro(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    pairs = p.select("p_brand", "p_partkey", F.col("p_name").alias("found")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("truth")), "p_partkey")
    return metrics.cer_micro(pairs, ["p_brand"]).withColumn("cer", F.round(F.col("cer").cast("double"), 6))


#: Matching blocks of distinct short texts p (a, b): each step takes the longest common part, leftmost of equals, of the first open pair, and opens both sides of it.
_RATIOS = """r AS (SELECT a, b, [{'a': a, 'b': b}] AS todo, 0 AS m FROM p UNION ALL SELECT a, b, CASE WHEN c IS NULL THEN todo[2:] ELSE list_concat(todo[2:], [{'a': substring(x, 1, c.i - 1), 'b': substring(y, 1, strpos(y, substring(x, c.i, c.n)) - 1)},
 {'a': substring(x, c.i + c.n), 'b': substring(y, strpos(y, substring(x, c.i, c.n)) + c.n)}]) END, m + COALESCE(c.n, 0)::INTEGER FROM (SELECT *, todo[1].a AS x, todo[1].b AS y,
 list_filter(flatten(list_transform(range(length(todo[1].a), 0, -1), lambda n: list_transform(range(1, length(todo[1].a) - n + 2), lambda i: {'n': n, 'i': i}))), lambda c: contains(todo[1].b, substring(todo[1].a, c.i, c.n)))[1] AS c FROM r WHERE len(todo) > 0)),
ratios AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE 2.0::DOUBLE * m / (length(a) + length(b)) END AS ratio FROM r WHERE len(todo) = 0)"""


@query(
    f"""WITH RECURSIVE z AS (SELECT a.p_brand, a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part), n AS (SELECT word, chr(CAST(20000 + row_number() OVER (ORDER BY word) AS INTEGER)) AS c FROM (SELECT DISTINCT word FROM w)),
e AS (SELECT p_partkey, string_agg(c, '' ORDER BY k) AS e FROM w JOIN n USING (word) GROUP BY p_partkey), q AS (SELECT z.*, e1.e AS ex, e2.e AS ey FROM z JOIN e e1 USING (p_partkey) JOIN e e2 ON e2.p_partkey = z.p_partkey + 1),
p AS (SELECT x AS a, y AS b FROM q UNION SELECT ex, ey FROM q), {_RATIOS}
SELECT p_brand, round(avg(1 - s.ratio), 6) AS error, round(avg(1 - t.ratio), 6) AS word_error FROM q JOIN ratios s ON q.x = s.a AND q.y = s.b JOIN ratios t ON q.ex = t.a AND q.ey = t.b GROUP BY p_brand"""
)
def name_ratio_errors(spark: SparkSession, d: str) -> DataFrame:
    """Similarity-ratio errors by character and by word of names that follow each other."""
    p = table(spark, d, "part")
    pairs = p.select("p_brand", "p_partkey", F.col("p_name").alias("found")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("truth")), "p_partkey")
    a = metrics.ratio_error_macro(pairs, ["p_brand"]).withColumn("error", F.round("error", 6))
    return a.join(metrics.ratio_error_macro(pairs, ["p_brand"], by_word=True).select("p_brand", F.round("error", 6).alias("word_error")), "p_brand")


@query()
def ratio_errors(spark: SparkSession, d: str) -> DataFrame:
    """Similarity-ratio errors by character and by word of consecutive turns."""
    c = table(spark, d, "conversations")
    pairs = c.select("role", "conv_id", "turn", F.col("text").alias("found")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth")), ["conv_id", "turn"])
    a = metrics.ratio_error_macro(pairs, ["role"]).withColumn("error", F.round("error", 6))
    b = metrics.ratio_error_macro(pairs, ["role"], by_word=True).select("role", F.round("error", 6).alias("word_error"))
    return a.join(b, "role")


_DASH = "regexp_matches(t, '\\p{L}+[-–—=]$') AND regexp_matches(n, '^\\p{L}')"


def _pairs_sql(edge: str) -> str:
    return f"""{VARIANTS}, a AS (SELECT doc_id, pos, {STRIP.format("text")} AS t FROM v), b AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM a),
e AS (SELECT *, COALESCE({edge}, false) AS j FROM b), i AS (SELECT *, COALESCE(SUM(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM e),
k AS (SELECT *, j AND row_number() OVER (PARTITION BY doc_id, isl ORDER BY pos) % 2 = 1 AS take FROM i), u AS (SELECT *, COALESCE(lag(take) OVER (PARTITION BY doc_id ORDER BY pos), false) AS used FROM k)"""


@query(f"WITH {_pairs_sql(_DASH)} SELECT doc_id, pos, CASE WHEN take THEN regexp_replace(t, '[-–—=]$', '') || n ELSE t END AS text FROM u WHERE NOT used")
def stitch_hyphen(spark: SparkSession, d: str) -> DataFrame:
    return S.stitch_hyphens(_variants(spark, d))


_BIND = f"lower(regexp_extract(t, '(\\S+)$', 1)) IN ({', '.join(repr(c) for c in T.CONNECTORS)}) AND regexp_matches(n, '^[\\p{{Ll}}0-9]')"


@query(
    f"""WITH {_pairs_sql(_BIND)}, m AS (SELECT doc_id, pos, CASE WHEN take THEN list_filter([regexp_replace(t, '\\s*\\S+$', ''), regexp_extract(t, '(\\S+)$', 1) || ' ' || n], lambda x: x <> '') ELSE [t] END AS x FROM u WHERE NOT used)
SELECT doc_id, pos, CAST(unnest(range(len(x))) AS INTEGER) AS sub, unnest(x) AS text FROM m"""
)
def bind_connectors(spark: SparkSession, d: str) -> DataFrame:
    return S.bind_connectors(_variants(spark, d))


_GOES_ON = "p <> '' AND NOT regexp_matches(t, '^([-*•–—]\\s+|\\d+[.)]\\s+|#|\\$\\$)|:$') AND NOT regexp_matches(p, '(:|\\$\\$)$') AND NOT regexp_matches(p, '^\\$\\$') AND NOT regexp_matches(p, '[.!?:]$') AND regexp_matches(t, '^\\p{Ll}')"


@query(
    f"""WITH {VARIANTS}, a AS (SELECT doc_id, pos, {STRIP.format("text")} AS t FROM v), b AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM a),
c AS (SELECT *, COALESCE({_GOES_ON}, false) AS g FROM b),
e AS (SELECT *, SUM(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM c)
SELECT doc_id, MIN(pos) AS pos, string_agg(t, ' ' ORDER BY pos) AS text FROM e WHERE t <> '' GROUP BY doc_id, grp"""
)
def merge_sentences(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_sentences(_variants(spark, d))


_TAKEN = """e AS (SELECT *, COALESCE({edge}, false) AS j FROM b), i AS (SELECT *, COALESCE(SUM(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM e),
k AS (SELECT *, j AND row_number() OVER (PARTITION BY doc_id, isl ORDER BY pos) % 2 = 1 AS take FROM i), u AS (SELECT *, COALESCE(lag(take) OVER (PARTITION BY doc_id ORDER BY pos), false) AS used FROM k)"""


@query(
    f"""WITH {_pairs_sql(_DASH)}, s1 AS (SELECT doc_id, pos, CASE WHEN take THEN regexp_replace(t, '[-–—=]$', '') || n ELSE t END AS t FROM u WHERE NOT used),
b1 AS (WITH b AS (SELECT doc_id, pos, {STRIP.format("t")} AS t, lead({STRIP.format("t")}) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM s1), {_TAKEN.format(edge=_BIND)} SELECT * FROM u WHERE NOT used),
m1 AS (SELECT doc_id, pos, CASE WHEN take THEN list_filter([regexp_replace(t, '\\s*\\S+$', ''), regexp_extract(t, '(\\S+)$', 1) || ' ' || n], lambda x: x <> '') ELSE [t] END AS x FROM b1),
r1 AS (SELECT doc_id, pos, CAST(unnest(range(len(x))) AS INTEGER) AS sub, {STRIP.format("unnest(x)")} AS t FROM m1), l1 AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos, sub) AS p FROM r1),
g1 AS (SELECT *, COALESCE({_GOES_ON}, false) AS g FROM l1), n1 AS (SELECT *, SUM(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos, sub) AS grp FROM g1),
f1 AS (SELECT doc_id, MIN((pos, sub)) AS o, string_agg(t, ' ' ORDER BY pos, sub) AS t FROM n1 WHERE t <> '' GROUP BY doc_id, grp)
SELECT doc_id, o[1] AS pos, o[2] AS sub, array_to_string(list_transform(regexp_extract_all(t, '(?s).*?[.!?]\\s|.+'), lambda x: upper(substring(x, 1, 1)) || substring(x, 2)), '') AS text FROM f1"""
)
def document_text(spark: SparkSession, d: str) -> DataFrame:
    return S.document_text(_variants(spark, d))


#: Whether a text repeats itself; pieces are looked for in each run without white space.
_LOOPS = """(len({1}) >= 4 AND len(list_filter(range(1, len({1}) - 2), lambda i: {1}[i] = {1}[i + 1] AND {1}[i] = {1}[i + 2])) > 0
 OR len(list_filter(regexp_extract_all({0}, '\\S+'), lambda r: len(list_filter(range(2, length(r) // 4 + 1), lambda n: len(list_filter(range(1, length(r) - 4 * n + 2), lambda i: substring(r, i, 4 * n) = repeat(substring(r, i, n), 4))) > 0)) > 0)) > 0)"""


def _loops(text: str) -> str:
    return _LOOPS.format(text, f"regexp_extract_all({text}, '\\S+')")


@query(f"WITH {LINES} SELECT {_loops('text')} AS repetitive, COUNT(*) AS n FROM lines GROUP BY 1")
def repeat_loop(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(T.repetitive(F.col("text")).alias("repetitive")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)"""
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return S.carry_forward(e, "v", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "carried")


@query(
    """WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + CAST(floor(value) AS BIGINT) AS e FROM events),
a AS (SELECT *, CASE WHEN s - MAX(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3600 THEN 0 ELSE 1 END AS nw FROM i),
g AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM a)
SELECT user_id, MIN(s) AS "start", MAX(e) AS "end", COUNT(*) AS n FROM g GROUP BY user_id, g HAVING MAX(e) - MIN(s) >= 10"""
)
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", s.alias("s"), (s + F.floor("value")).alias("e"))
    return S.merge_intervals(e, "user_id", "s", "e", 3600, 10)


@query(
    """WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), a AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 7200 THEN 0 ELSE 1 END AS nw FROM i),
g AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id ORDER BY s) AS g FROM a) SELECT user_id, CAST(g AS BIGINT) AS cluster, MIN(s) AS "first", MAX(s) AS "last", COUNT(*) AS n FROM g GROUP BY user_id, g"""
)
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return S.gap_clusters(e, "user_id", "s", 7200)


@query(
    f"""WITH {LINES}, s AS (SELECT *, pos % 3 = 0 AS side, row_number() OVER (PARTITION BY doc_id, pos % 3 = 0 ORDER BY pos) AS r FROM lines)
SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, CAST(COALESCE(a.r, b.r) AS INTEGER) AS rank, COALESCE(a.text, '') AS left_text, COALESCE(b.text, '') AS right_text FROM (SELECT * FROM s WHERE side) a FULL JOIN (SELECT * FROM s WHERE NOT side) b ON a.doc_id = b.doc_id AND a.r = b.r"""
)
def rank_outer_table(spark: SparkSession, d: str) -> DataFrame:
    return S.side_by_side(_lines(spark, d), "doc_id", ["pos"], F.col("pos") % 3 == 0)


_SIDES = f"""{VARIANTS}, {_LEXICON}, y AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 5 = 0 THEN text || repeat(' ' || regexp_extract(text, '(\\S*)\\s*$', 1), 4) ELSE text END AS text FROM lines), p AS (SELECT l.doc_id, l.pos, {STRIP.format("l.text")} AS a, {STRIP.format("v.text")} AS b, (l.doc_id * 31 + l.pos * 17) % 100 / 100.0::DOUBLE AS ca, (l.doc_id * 13 + l.pos * 29) % 100 / 100.0::DOUBLE AS cb FROM y l JOIN v ON l.doc_id = v.doc_id AND l.pos = v.pos),
wa AS (SELECT doc_id, pos, COUNT(*) AS t, COUNT(*) FILTER (length(x.word) <= 2 OR l.word IS NOT NULL) AS n FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}]+')) AS word FROM p) x LEFT JOIN lexicon l ON x.word = l.word GROUP BY doc_id, pos),
wb AS (SELECT doc_id, pos, COUNT(*) AS t, COUNT(*) FILTER (length(x.word) <= 2 OR l.word IS NOT NULL) AS n FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}]+')) AS word FROM p) x LEFT JOIN lexicon l ON x.word = l.word GROUP BY doc_id, pos),
q AS (SELECT p.*, {_loops('a')} AS la, {_loops('b')} AS lb, COALESCE(wa.n, 0) AS na, COALESCE(wb.n, 0) AS nb, COALESCE(wa.n, 0)::DOUBLE / greatest(COALESCE(wa.t, 0), 1) AS ra, COALESCE(wb.n, 0)::DOUBLE / greatest(COALESCE(wb.t, 0), 1) AS rb FROM p LEFT JOIN wa USING (doc_id, pos) LEFT JOIN wb USING (doc_id, pos)),
d AS (SELECT *, CASE WHEN a = '' AND b <> '' THEN 'second_only' WHEN b = '' AND a <> '' THEN 'first_only' WHEN a = '' AND b = '' THEN 'both_empty' WHEN la AND NOT lb THEN 'first_loops' WHEN ca >= 0.88 THEN 'first_confident' WHEN rb > ra + 0.35::DOUBLE AND nb >= 2 AND cb >= 0.65 THEN 'second_lexical' WHEN lower(a) = lower(b) THEN 'agreement' ELSE 'weighted' END AS reason FROM q)"""


@query(
    f"""WITH {_SIDES} SELECT doc_id, pos, reason, CASE reason WHEN 'second_only' THEN b WHEN 'first_only' THEN a WHEN 'both_empty' THEN '' WHEN 'first_loops' THEN b WHEN 'first_confident' THEN a WHEN 'second_lexical' THEN b WHEN 'agreement' THEN a ELSE CASE WHEN ca * 0.65::DOUBLE >= cb * 0.35::DOUBLE THEN a ELSE b END END AS text,
round(CASE reason WHEN 'second_only' THEN cb WHEN 'first_only' THEN ca WHEN 'both_empty' THEN 0 WHEN 'first_loops' THEN greatest(cb, 0.75) WHEN 'first_confident' THEN ca WHEN 'second_lexical' THEN ca * 0.3 + cb * 0.7 WHEN 'agreement' THEN least(0.98, greatest(ca, cb) + 0.06) ELSE ca * 0.6 + cb * 0.4 END::DOUBLE, 6) AS conf FROM d"""
)
def arbitrate(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of each line, arbitrated; every fifth first reading has its last word on end."""
    stutter = F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, F.concat("text", F.repeat(F.concat(F.lit(" "), F.regexp_extract("text", "(\\S*)\\s*$", 1)), 4))).otherwise(F.col("text"))
    b = _variants(spark, d).withColumnRenamed("text", "b")
    p = _lines(spark, d).withColumn("a", stutter).drop("text").join(b, ["doc_id", "pos"])
    p = p.withColumn("ca", ((F.col("doc_id") * 31 + F.col("pos") * 17) % 100) / F.lit(100.0)).withColumn("cb", ((F.col("doc_id") * 13 + F.col("pos") * 29) % 100) / F.lit(100.0))
    lex = _lexicon(spark, d)
    for side in "ab":
        p = _valid(p, side, lex).withColumnsRenamed({"n_words": f"t{side}", "n_valid": f"n{side}"})
    c = F.col
    out = T.arbitrate(c("a"), c("ca"), c("b"), c("cb"), T.repetitive(c("a")), T.repetitive(c("b")), c("na"), c("ta"), c("nb"), c("tb"))
    return p.select("doc_id", "pos", out.alias("o")).select("doc_id", "pos", "o.reason", "o.text", F.round("o.conf", 6).alias("conf"))


_PAIR_ROWS = ", ".join(f"('{g}')" for g in distance.LOOKALIKES)


@query(
    f"""WITH g(s) AS (VALUES {_PAIR_ROWS}), l AS (SELECT s, unnest(string_split(s, '')) AS a FROM g), n AS (SELECT c, COUNT(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM benchmark) GROUP BY c)
SELECT x.a, y.a AS b, 0.2::DOUBLE AS cost, COALESCE(n.n, 0) AS seen FROM l x JOIN l y ON x.s = y.s AND x.a <> y.a LEFT JOIN n ON x.a = n.c"""
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Costs of look-alike letters, and how often the benchmark has the first of each pair."""
    letters = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("seen"))
    return distance.cost_table(spark).join(letters, "a", "left").fillna(0, ["seen"])


_EVENT_PAIRS = "p AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id AS ev FROM events), c AS (SELECT user_id, a, b, COUNT(*) AS n, MIN(ev) AS f FROM p WHERE b IS NOT NULL AND a <> b GROUP BY user_id, a, b)"


def _event_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = S.Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.col("event_id").alias("at"))
    return profiles.pair_counts(p.filter("b is not null and a <> b"))


@query(f"WITH {_EVENT_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, a, b) AS rank FROM c) SELECT user_id, a, b, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6")
def profile_counts_topk(spark: SparkSession, d: str) -> DataFrame:
    return profiles.top_pairs(_event_pairs(spark, d)).drop("first")


@query(
    f"""WITH {_EVENT_PAIRS}, k AS (SELECT user_id, a, b, greatest(0.04::DOUBLE, 0.20::DOUBLE - least(0.16::DOUBLE, 0.04::DOUBLE * n)) AS cost, f FROM c), m AS (SELECT * FROM k UNION ALL SELECT user_id, b, a, cost, f FROM k)
SELECT user_id, a, b, round(arg_max(cost, f), 6) AS cost FROM m GROUP BY user_id, a, b"""
)
def profile_penalties(spark: SparkSession, d: str) -> DataFrame:
    return profiles.penalties(_event_pairs(spark, d)).withColumn("cost", F.round("cost", 6))


@query(
    """WITH RECURSIVE z AS (SELECT a.p_brand AS user_id, a.p_partkey AS at, lower(a.p_name) AS a, lower(b.p_name) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), p AS (SELECT DISTINCT a, b FROM z WHERE a <> b),
r AS (SELECT a, b, [{'a': a, 'b': b}] AS todo, CAST([] AS STRUCT(a VARCHAR, b VARCHAR)[]) AS subs FROM p UNION ALL SELECT a, b, CASE WHEN c IS NULL THEN todo[2:] ELSE list_concat(todo[2:], [{'a': substring(x, 1, c.i - 1), 'b': substring(y, 1, strpos(y, substring(x, c.i, c.n)) - 1)},
 {'a': substring(x, c.i + c.n), 'b': substring(y, strpos(y, substring(x, c.i, c.n)) + c.n)}]) END, CASE WHEN c IS NULL AND length(x) = 1 AND length(y) = 1 THEN list_append(subs, {'a': x, 'b': y}) ELSE subs END FROM (SELECT *, todo[1].a AS x, todo[1].b AS y,
 list_filter(flatten(list_transform(range(length(todo[1].a), 0, -1), lambda n: list_transform(range(1, length(todo[1].a) - n + 2), lambda i: {'n': n, 'i': i}))), lambda c: contains(todo[1].b, substring(todo[1].a, c.i, c.n)))[1] AS c FROM r WHERE len(todo) > 0)),
s AS (SELECT user_id, x.a AS sa, x.b AS sb FROM (SELECT user_id, unnest(subs) AS x FROM z JOIN r ON z.a = r.a AND z.b = r.b WHERE len(todo) = 0)), n AS (SELECT user_id, COUNT(DISTINCT (sa, sb)) AS n FROM s GROUP BY user_id)
SELECT z.user_id, COUNT(*) FILTER (a <> b) AS total_corrections, COUNT(DISTINCT CASE WHEN a <> b AND regexp_matches(b, '^\\p{L}{3,}$') THEN b END) AS vocabulary_size, COALESCE(MAX(n.n), 0) AS n_pairs FROM z LEFT JOIN n ON z.user_id = n.user_id GROUP BY z.user_id"""
)
def name_profile_stats(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions learned from names that follow each other, as if one corrected the other; a brand is a user."""
    p = table(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("corrected"))
    fixes = p.select(F.col("p_brand").alias("user_id"), "p_partkey", F.col("p_name").alias("original")).join(nxt, "p_partkey").withColumnRenamed("p_partkey", "at")
    return profiles.stats(fixes, profiles.pair_counts(profiles.substitutions(fixes)))


@query()
def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions learned from consecutive turns, as if one corrected the other."""
    c = table(spark, d, "conversations")
    fixes = c.select(F.col("conv_id").cast("string").alias("user_id"), F.col("turn").alias("at"), F.col("text").alias("original")).join(
        c.select(F.col("conv_id").cast("string").alias("user_id"), (F.col("turn") - 1).alias("at"), F.upper("text").alias("corrected")), ["user_id", "at"]
    )
    return profiles.stats(fixes, profiles.pair_counts(profiles.substitutions(fixes)))


@query(
    """SELECT page_id, COALESCE(nullif(regexp_replace(regexp_replace(lower(regexp_replace(trim(url), '[^\\p{L}\\p{N}_-]', '_', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'user') AS user_id,
COALESCE(nullif(regexp_replace(regexp_replace(regexp_extract(replace(url, '\\', '/'), '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', ''), ''), 'file') AS file_name,
lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS extension, sha256(url) AS digest FROM pages"""
)
def sanitize_ids(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", T.user_id(url).alias("user_id"), T.file_name(url).alias("file_name"), T.extension(url).alias("extension"), T.sha256(url).alias("digest"))


_VOC = "abcdefghijklmnopqrstuvwxyz "


@query(
    f"""WITH e AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: CASE WHEN c <> '' AND strpos('{_VOC}', c) > 0 THEN strpos('{_VOC}', c) + 1 ELSE 1 END) AS ids FROM documents)
SELECT doc_id, len(ids)::INTEGER AS n, list_count(list_filter(ids, lambda i: i = 1)) AS unknown, md5(array_to_string(list_transform(list_filter(ids, lambda i: i >= 2), lambda i: substring('{_VOC}', CAST(i - 1 AS INTEGER), 1)), '')) AS decoded FROM e"""
)
def encode_decode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", T.encode(F.col("text"), _VOC).alias("ids"))
    return e.select("doc_id", F.size("ids").alias("n"), (F.size("ids") - F.size(F.array_remove("ids", 1))).cast("long").alias("unknown"), F.md5(T.decode(F.col("ids"), _VOC)).alias("decoded"))


@query(
    """WITH w AS (SELECT l_orderkey, l_suppkey % 2 AS grp, l_linenumber * 10.5 AS x0, l_linenumber * 2.0 AS y0, l_linenumber * 10.5 + l_quantity AS x1, l_linenumber * 2.0 + 12 AS y1, l_partkey AS pos, l_returnflag AS text FROM lineitem),
g AS (SELECT l_orderkey, grp, MIN(x0) AS x0, MIN(y0) AS y0, MAX(x1) AS x1, MAX(y1) AS y1, string_agg(text, ' ' ORDER BY x0, pos, text) AS text FROM w GROUP BY l_orderkey, grp),
b AS (SELECT l_orderkey, grp, CAST(greatest(0, floor(x0) - 6) AS BIGINT) AS x, CAST(greatest(0, floor(y0) - 4) AS BIGINT) AS y, x1, y1, text FROM g)
SELECT l_orderkey, grp, x, y, CAST(ceil(x1) + 6 - x AS BIGINT) AS w, CAST(ceil(y1) + 4 - y AS BIGINT) AS h, text FROM b WHERE ceil(x1) + 6 - x >= 24 AND ceil(y1) + 4 - y >= 10 AND length(text) >= 2"""
)
def annotation_group(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    w = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_suppkey") % 2).alias("grp"), (n * F.lit(10.5)).alias("x0"), (n * F.lit(2.0)).alias("y0"), (n * F.lit(10.5) + F.col("l_quantity")).alias("x1"),
        (n * F.lit(2.0) + 12).alias("y1"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("text"),
    )
    return metrics.annotation_groups(w, ["l_orderkey", "grp"])


@query("SELECT doc_id, CASE WHEN CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 9 THEN 'train' ELSE 'val' END AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    """WITH v AS (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT greatest(10, least(500, CAST(floor(COUNT(*) * 0.05) AS BIGINT))) FROM documents))
SELECT COUNT(*) AS total_samples, COUNT(*) FILTER (v.doc_id IS NULL) AS train_samples, COUNT(v.doc_id) AS val_samples FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id"""
)
def clamped_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.split_counts(metrics.clamped_split(table(spark, d, "documents").select("doc_id"), "doc_id"))


@query(
    f"""WITH {VARIANTS}, s AS (SELECT doc_id, pos, {STRIP.format("text")} AS s FROM v) SELECT doc_id, '=== Notes ===' || chr(10) || chr(10) || COALESCE(string_agg(s, chr(10) ORDER BY pos) FILTER (s <> ''), '') || chr(10) AS content FROM s GROUP BY doc_id"""
)
def plain_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.plain_text(_variants(spark, d), "Notes")


#: Formula and term lines that stand among the documents' lines, so that each rule is met.
FORMULA_LINES = (
    "y = x^2 + (a + b) / (c - d)", "E_k = m * v^2 / 2", "lim x->0 sqrt(x + 1) >= alpha", "2H2 + O2 -> 2H2O", "HCl + NaOH = NaCl + H2O", "N2 + 3H2 <=> 2NH3", "the area of it: a * b",
    "we poured H2SO4 and Ca(OH)2, then waited", "cell - the least unit of life", "chapter one", "sum x_i != infinity ± eps", "$$ a = b $$",
)
_FORMULA_LINES = "SELECT doc_id, pos, CASE pos % 20 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FORMULA_LINES)) + " ELSE text END AS text FROM v"


def _formula_lines(spark: SparkSession, d: str) -> DataFrame:
    v, text = _variants(spark, d), F.col("text")
    for k, x in enumerate(FORMULA_LINES):
        text = F.when(F.col("pos") % 20 == k, F.lit(x)).otherwise(text)
    return v.withColumn("text", text)


def _shaped_sql(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, template in rules:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern, template.replace("\\", "\\\\").replace("%", "\\"))
    return x


def _latex_sql(x: str) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in formulas.LATEX.items())
    return STRIP.format(_shaped_sql(f"array_to_string(list_transform(regexp_extract_all({x}, '{formulas.TOKEN}'), lambda t: CASE t {names} ELSE t END), '')", formulas.SHAPES))


_COMPOUND_SQL = f"(regexp_matches(t, '{formulas.COMPOUND}') AND regexp_matches(t, '{formulas.TWO_ELEMENTS}') AND (regexp_matches(t, '{formulas.COUNTED}') OR regexp_matches(t, '{formulas.NAMED}')) OR regexp_matches(t, '{formulas.PAIR}'))"
_COUNTED_SQL = f"(regexp_matches(t, '{formulas.COMPOUND}') AND regexp_matches(t, '{formulas.COUNTED}'))"
_WORDS_SQL = f"regexp_extract_all(s, '{formulas.REACTION_TOKEN}')"
_SUBSCRIPTS_SQL = _shaped_sql("t", formulas.SUBSCRIPTS)
_SIGNS = " + ".join(f"CAST(contains(s, '{m}') AS INTEGER)" for m in formulas.SIGNS)
_IS_FORMULA = f"(s <> '' AND ((regexp_matches(s, '{formulas.RELATION}') AND (length(regexp_replace(s, '[^\\p{{Ll}}]', '', 'g'))::DOUBLE / greatest(1, length(replace(s, ' ', ''))) < 0.45 OR ({_SIGNS}) >= 2)) OR starts_with(s, '$$') OR ends_with(s, '$$')))"
_FORMULAS = f"""{VARIANTS}, fs AS (SELECT doc_id, pos, {STRIP.format("text")} AS s FROM ({_FORMULA_LINES})), fk AS (SELECT *, {_IS_FORMULA} AS f FROM fs),
fl AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN contains(s, '$$') THEN 'ready' WHEN NOT f THEN CASE WHEN regexp_matches(s, '{formulas.LABELLED}') AND regexp_matches(regexp_extract(s, '{formulas.LABELLED}', 2), '{formulas.WORKED}') THEN 'labelled' ELSE 'prose' END
 WHEN len(list_filter({_WORDS_SQL}, lambda t: {_COMPOUND_SQL})) > 0 OR regexp_matches(s, '{formulas.ARROW}') AND len(list_filter({_WORDS_SQL}, lambda t: {_COUNTED_SQL})) > 0 THEN 'reaction' ELSE 'equation' END AS kind FROM fk),
ff AS (SELECT doc_id, pos, f, CASE kind WHEN 'reaction' THEN '$$' || array_to_string(list_transform({_WORDS_SQL}, lambda t: CASE WHEN t IN ('<=>', '<->') THEN '\\Leftrightarrow' WHEN regexp_matches(t, '^-+>$') THEN '\\rightarrow' WHEN {_COMPOUND_SQL} OR {_COUNTED_SQL} THEN {_SUBSCRIPTS_SQL} ELSE t END), '') || '$$'
 WHEN 'equation' THEN '$$' || {_latex_sql("s")} || '$$' WHEN 'labelled' THEN regexp_extract(s, '{formulas.LABELLED}', 1) || ' $' || {_latex_sql(f"regexp_extract(s, '{formulas.LABELLED}', 2)")} || '$'
 WHEN 'prose' THEN array_to_string(list_transform({_WORDS_SQL}, lambda t: CASE WHEN {_COMPOUND_SQL} THEN '$' || {_SUBSCRIPTS_SQL} || '$' ELSE t END), '') ELSE s END AS s FROM fl)"""
_MARKDOWN = f"""{_FORMULAS}, md AS (SELECT doc_id, pos, s, CASE WHEN s = '' THEN NULL WHEN f THEN chr(10) || s || chr(10) WHEN regexp_matches(lower(s), '{formulas.CHAPTER}') THEN chr(10) || '### ' || s || chr(10)
 WHEN starts_with(s, '•') OR starts_with(s, '-') THEN '- ' || regexp_replace(s, '{formulas.BULLET}', '') WHEN regexp_matches(s, '{formulas.NUMBERED}') THEN chr(10) || s || chr(10)
 WHEN ends_with(s, ':') OR (length(s) < 50 AND NOT contains(s, ' - ') AND regexp_matches(s, '^\\p{{Lu}}')) THEN chr(10) || '## ' || s || chr(10)
 WHEN contains(s, ' - ') OR contains(s, ' — ') THEN chr(10) || '**' || {STRIP.format(f"regexp_extract(s, '{formulas.TERM}', 1)")} || '** — ' || {STRIP.format(f"regexp_extract(s, '{formulas.TERM}', 2)")} || chr(10) ELSE s END AS m FROM ff),
body AS (SELECT doc_id, CASE WHEN COUNT(m) = 0 THEN '# Notes' || chr(10) || chr(10) || '{exports.NO_TEXT}' || chr(10) ELSE {STRIP.format("'# Notes' || chr(10) || chr(10) || '> **Subject**: *general*' || chr(10) || chr(10) || COALESCE(string_agg(m, chr(10) ORDER BY pos), '')")} || chr(10) END AS content FROM md GROUP BY doc_id)"""


@query(f"WITH {_MARKDOWN} SELECT doc_id, 'MARKDOWN' AS export_format, content FROM body")
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.export(_formula_lines(spark, d), "markdown", "Notes")


#: Our own comparison: the line that starts it, the columns, and a word of the left one.
COMPARED = exports.Comparison("^(chapter|1\\. )", "First", "Second", (" on", "de "))
_LEFT_WORD = " OR ".join(f"contains(lower(s), '{w}')" for w in COMPARED.left_words)


@query(
    f"""WITH {_MARKDOWN.replace(f"({_FORMULA_LINES})", f"(SELECT doc_id, pos, CASE WHEN pos % 11 = 6 THEN 'left | ' || text ELSE text END AS text FROM ({_FORMULA_LINES}))")}, st AS (SELECT doc_id, MIN(pos) AS first FROM fs WHERE s <> '' AND regexp_matches(lower(s), '{COMPARED.start}') GROUP BY doc_id),
rw AS (SELECT doc_id, pos, contains(s, ' | ') AS two, regexp_split_to_array(s, '\\s*\\|\\s*') AS cut, {_LEFT_WORD} AS lw, s FROM fs JOIN st USING (doc_id) WHERE pos > first AND s <> ''),
sd AS (SELECT doc_id, pos, {STRIP.format("COALESCE(CASE WHEN two THEN cut[1] WHEN lw THEN s END, '')")} AS l, {STRIP.format("COALESCE(CASE WHEN two THEN cut[2] WHEN NOT lw THEN s END, '')")} AS r FROM rw),
lf AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM sd WHERE l <> ''), rt AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM sd WHERE r <> ''),
tb AS (SELECT doc_id, string_agg('| ' || COALESCE(l, '') || ' | ' || COALESCE(r, '') || ' |', chr(10) ORDER BY k) AS t FROM lf FULL JOIN rt USING (doc_id, k) GROUP BY doc_id),
hd AS (SELECT md.doc_id, string_agg(m, chr(10) ORDER BY pos) FILTER (first IS NULL OR pos < first) AS t, COUNT(m) AS n FROM md LEFT JOIN st USING (doc_id) GROUP BY md.doc_id)
SELECT doc_id, CASE WHEN hd.n = 0 THEN '# Notes' || chr(10) || chr(10) || '{exports.NO_TEXT}' || chr(10) ELSE {STRIP.format("'# Notes' || chr(10) || chr(10) || '> **Subject**: *general*' || chr(10) || chr(10) || concat_ws(chr(10), hd.t, CASE WHEN first IS NOT NULL THEN chr(10) || '### " + COMPARED.left + " / " + COMPARED.right + "' || chr(10) || chr(10) || '| " + COMPARED.left + " | " + COMPARED.right + " |' || chr(10) || '| :--- | :--- |' END, tb.t)")} || chr(10) END AS content
FROM hd LEFT JOIN st USING (doc_id) LEFT JOIN tb USING (doc_id)"""
)
def comparison_export(spark: SparkSession, d: str) -> DataFrame:
    """Markdown whose lines become a two-column table from the first line on that starts a comparison."""
    lines_ = _formula_lines(spark, d)
    lines_ = lines_.withColumn("text", F.when(F.col("pos") % 11 == 6, F.concat(F.lit("left | "), "text")).otherwise(F.col("text")))
    return exports.markdown(lines_, "Notes", comparison=COMPARED)


@query(f"WITH {_MARKDOWN} SELECT doc_id, 'LATEX' AS export_format, '{exports.HEAD}' || content || '{exports.FOOT}' AS content FROM body")
def latex_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.export(_formula_lines(spark, d), "latex", "Notes")


@query(
    f"""WITH {LINES}, j AS (SELECT doc_id, pos, to_json({{'line_index': pos, 'bbox': [pos % 5 * 35, pos * 40, length(text) * 8 + 1, 18 + pos % 17], 'text': text, 'confidence': (doc_id * 31 + pos * 17) % 100 / 100.0::DOUBLE}})::VARCHAR AS j FROM lines)
SELECT doc_id, 'JSON' AS export_format, '{{"title":"Notes","lines":[' || string_agg(j, ',' ORDER BY pos) || ']}}' AS content FROM j GROUP BY doc_id"""
)
def json_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.export(_boxed(_lines(spark, d)), "json", "Notes")


_NOISE_SQL = "x"
for _p in T.NOISE:
    _NOISE_SQL = STRIP.format(f"regexp_replace({_NOISE_SQL}, '{_p}', '')")


_CLEAN_SQL = STRIP.format("regexp_replace(regexp_replace(" + _NOISE_SQL + ", '\\s*\\|\\s*\\|\\s*', ' | ', 'g'), '\\s+', ' ', 'g')")


@query(f"""WITH {VARIANTS}, s AS (SELECT doc_id, pos, {STRIP.format("text")} AS x FROM v) SELECT doc_id, pos, {_CLEAN_SQL} AS text FROM s""")
def clean_noise(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("doc_id", "pos", T.clean_noise(F.col("text")).alias("text"))


@query(f"WITH {_FORMULAS} SELECT doc_id, pos, f AS formula FROM fk")
def formula_flag(spark: SparkSession, d: str) -> DataFrame:
    return _formula_lines(spark, d).select("doc_id", "pos", formulas.is_formula(F.col("text")).alias("formula"))


@query(f"WITH {_FORMULAS} SELECT doc_id, pos, kind FROM fl")
def formula_kind(spark: SparkSession, d: str) -> DataFrame:
    return _formula_lines(spark, d).select("doc_id", "pos", formulas.line_kind(F.col("text")).alias("kind"))


@query(f"WITH {_FORMULAS} SELECT doc_id, pos, s AS text FROM ff")
def formula_latex(spark: SparkSession, d: str) -> DataFrame:
    return _formula_lines(spark, d).select("doc_id", "pos", formulas.format_line(F.col("text")).alias("text"))


@query(f"WITH {VARIANTS} SELECT doc_id, pos, CAST(least(greatest(bbox_x - 35, 0) // 35, 4) AS INTEGER) AS indent FROM (SELECT doc_id, pos, (pos % 9) * 35 AS bbox_x FROM v)")
def indentation(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("doc_id", "pos", T.indent((F.col("pos") % 9) * 35, F.lit(35)).alias("indent"))


@query(
    """WITH s AS (SELECT vec_id, unnest(range(len(embedding) // 8)) AS t, embedding FROM embeddings), c AS (SELECT vec_id, t, unnest(range(8)) AS c, embedding FROM s), p AS (SELECT vec_id, t, c, CAST(embedding[CAST(t * 8 + c + 1 AS INTEGER)] AS DOUBLE) AS v FROM c),
m AS (SELECT vec_id, t, c, v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY v DESC, c) AS r FROM p) WHERE r = 1), l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS b FROM m),
k AS (SELECT * FROM l WHERE c NOT IN (0, 1) AND (b IS NULL OR b <> c))
SELECT e.vec_id, COALESCE(string_agg(k.c::VARCHAR, ',' ORDER BY k.t), '') AS ids, round(greatest(0.0, least(1.0, COALESCE(avg(k.v), 0.0))), 6) AS confidence FROM embeddings e LEFT JOIN k ON e.vec_id = k.vec_id GROUP BY e.vec_id"""
)
def ctc_greedy(spark: SparkSession, d: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 8).cast("int") - 1), lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    out = decoding.ctc_greedy(table(spark, d, "embeddings").select("vec_id", steps.alias("p")), "vec_id")
    return out.select("vec_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.round("confidence", 6).alias("confidence"))


@query(
    """WITH RECURSIVE l AS (SELECT vec_id, CAST(len(embedding) // 8 AS INTEGER) AS steps, list_transform(embedding, lambda x: exp(-abs(CAST(x AS DOUBLE)) - 0.1::DOUBLE)) AS p FROM embeddings),
r(vec_id, t, ids, b, nb, k) AS (SELECT vec_id, 0, CAST([] AS INTEGER[]), 1.0::DOUBLE, 0.0::DOUBLE, 0 FROM l UNION ALL
 SELECT vec_id, t + 1, ids, b, nb, CAST(n - 1 AS INTEGER) FROM (SELECT vec_id, t, ids, SUM(b) AS b, SUM(nb) AS nb, row_number() OVER (PARTITION BY vec_id ORDER BY SUM(b) + SUM(nb) DESC, MIN(o)) AS n FROM
 (SELECT vec_id, t, CASE WHEN c = 0 THEN ids ELSE list_append(ids, c) END AS ids, CASE WHEN c = 0 THEN (b + nb) * q[1] ELSE 0 END AS b,
 CASE WHEN c > 0 THEN CASE WHEN ids[-1] = c THEN b ELSE b + nb END * q[c + 1] WHEN len(ids) > 0 AND q[ids[-1] + 1] >= 1e-6 THEN nb * q[ids[-1] + 1] ELSE 0 END AS nb, CASE WHEN c = 0 THEN k ELSE 8 + 8 * c + k END AS o FROM
 (SELECT r.*, p[t * 8 + 1:t * 8 + 8] AS q, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS c FROM r JOIN l ON r.vec_id = l.vec_id WHERE t < steps) WHERE c = 0 OR q[c + 1] >= 1e-6) GROUP BY vec_id, t, ids) WHERE n <= 8)
SELECT r.vec_id, array_to_string(ids, ',') AS ids, round(COALESCE(list_avg(list_transform(ids, lambda c: list_max(list_transform(range(steps), lambda i: p[CAST(i * 8 + c + 1 AS INTEGER)])))), 0.0), 6) AS confidence FROM r JOIN l ON r.vec_id = l.vec_id WHERE t = steps AND k = 0"""
)
def ctc_beam(spark: SparkSession, d: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 8).cast("int") - 1), lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda x: -F.abs(x.cast("double")) - 0.1))
    out = decoding.ctc_beam_search(table(spark, d, "embeddings").select("vec_id", steps.alias("p")), "vec_id")
    return out.select("vec_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.round("confidence", 6).alias("confidence"))


_GRAY = "g AS (SELECT vec_id, len(embedding) // 8 AS h, list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor(v::DOUBLE * 256 + 128))) AS BIGINT)) AS p FROM embeddings)"
#: Pixels as rows: y, x from 0 on.
_PIXELS = f"{_GRAY}, px AS (SELECT vec_id, h, k // 8 AS y, k % 8 AS x, p[k + 1] AS v FROM (SELECT vec_id, h, p, unnest(range(h * 8)) AS k FROM g))"


def _images(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, h, w, data: embeddings as gray images eight pixels wide."""
    h = F.floor(F.size("embedding") / 8).cast("int")
    gray = F.transform(F.slice("embedding", F.lit(1), h * 8), lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 256 + 128))).cast("long")), 2, "0"))
    return table(spark, d, "embeddings").select("vec_id", h.alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(gray, "")).alias("data"))


def _pixels(images: DataFrame, f) -> DataFrame:
    """vec_id, y, v: each row of f of the image as a comma-joined text."""
    return A.map_values(images, lambda g: [(y, ",".join(str(int(v)) for v in row)) for y, row in enumerate(f(g))], ["vec_id"], "y int, v string")


_MIRRORED = "CASE WHEN m < h THEN m ELSE 2 * h - 1 - m END"
_WEIGHTS = "exp(-0.5 * (k / 3.0::DOUBLE) * (k / 3.0::DOUBLE))"


@query(
    f"""WITH {_PIXELS}, i AS (SELECT vec_id, y, COUNT(*) FILTER (v > 128) AS n FROM px GROUP BY vec_id, y), k AS (SELECT unnest(range(-12, 13)) AS k),
s AS (SELECT i.vec_id, i.y, k, g.h, ((i.y + k) % (2 * g.h) + 2 * g.h) % (2 * g.h) AS m FROM i JOIN g ON i.vec_id = g.vec_id CROSS JOIN k),
w AS (SELECT s.vec_id, s.y, k, {_MIRRORED} AS o FROM s)
SELECT w.vec_id, CAST(w.y AS INTEGER) AS y, round(SUM({_WEIGHTS} * i.n) / SUM({_WEIGHTS}), 6) AS ink FROM w JOIN i ON w.vec_id = i.vec_id AND w.o = i.y GROUP BY w.vec_id, w.y"""
)
def row_profile(spark: SparkSession, d: str) -> DataFrame:
    """Ink by row, smoothed with a mirrored border."""
    return A.map_values(_images(spark, d), lambda g: [(y, round(float(v), 6)) for y, v in enumerate(A.row_profile(g > 128))], ["vec_id"], "y int, ink double")


_NEAR = "SELECT unnest(range(-1, 2)) AS dy", "SELECT unnest(range(-1, 2)) AS dx"


@query(
    f"""WITH {_PIXELS}, n AS (SELECT px.vec_id, px.h, px.y, px.x, px.v, abs(px.y + dy) AS a, abs(px.x + dx) AS b FROM px CROSS JOIN ({_NEAR[0]}) CROSS JOIN ({_NEAR[1]})),
r AS (SELECT vec_id, y, x, v, CASE WHEN a >= h THEN 2 * h - 2 - a ELSE a END AS a, CASE WHEN b >= 8 THEN 14 - b ELSE b END AS b FROM n),
m AS (SELECT r.vec_id, r.y, r.x, ANY_VALUE(r.v) AS v, SUM(px.v) / 9.0::DOUBLE AS m, SUM(px.v * px.v) / 9.0::DOUBLE AS q FROM r JOIN px ON r.vec_id = px.vec_id AND r.a = px.y AND r.b = px.x GROUP BY r.vec_id, r.y, r.x)
SELECT vec_id, CAST(y AS INTEGER) AS y, string_agg(CASE WHEN v < m * (1 + 0.22::DOUBLE * (sqrt(greatest(q - m * m, 0)) / 128.0::DOUBLE - 1)) THEN '255' ELSE '0' END, ',' ORDER BY x) AS v FROM m GROUP BY vec_id, y"""
)
def local_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Ink by mean and spread of each pixel's surroundings."""
    return _pixels(_images(spark, d), lambda g: A.sauvola(g, 3))


def _browser_sql(block: int, below: int, ruled: str) -> str:
    return f"""WITH {_PIXELS}, b AS (SELECT *, v < avg(v) OVER (PARTITION BY vec_id, y // {block}, x // {block}) - {below} AS ink FROM px), r AS (SELECT *, avg(CASE WHEN ink THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY vec_id, y) > {ruled} AS rule FROM b)
SELECT vec_id, CAST(y AS INTEGER) AS y, string_agg(CASE WHEN ink AND NOT rule THEN '0' ELSE '255' END, ',' ORDER BY x) AS v FROM r GROUP BY vec_id, y"""


@query(_browser_sql(4, 16, "0.52"))
def block_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Ink by block means; ruled rows are bleached."""
    return _pixels(_images(spark, d), lambda g: A.browser_ink(g, 4))


@query(_browser_sql(2, 18, "0.55"))
def block_threshold_twin(spark: SparkSession, d: str) -> DataFrame:
    """The same with smaller blocks and other limits."""
    return _pixels(_images(spark, d), lambda g: A.browser_ink(g, 2, 18.0, 0.55))


@query(f"WITH {_PIXELS} SELECT vec_id, CAST(y + 4 AS INTEGER) AS y, repeat('255,', 8) || string_agg(v::VARCHAR, ',' ORDER BY x) || repeat(',255', 8) AS v FROM px GROUP BY vec_id, y UNION ALL SELECT vec_id, CAST(o AS INTEGER), repeat('255,', 23) || '255' FROM (SELECT vec_id, unnest([0, 1, 2, 3, h + 4, h + 5, h + 6, h + 7]) AS o FROM g)")
def padded_image(spark: SparkSession, d: str) -> DataFrame:
    """White borders about each image."""
    return _pixels(_images(spark, d), lambda g: A.padded(g))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 97 AS x, l_suppkey % 89 AS y, l_partkey AS k FROM lineitem)
SELECT l_orderkey, arg_min(x, (x + y) * 1000000 + x * 1000 + y) AS top_left, arg_max(x, (x + y) * 1000000 + x * 1000 + y) AS bottom_right, arg_min(x, (y - x) * 1000000 + x * 1000 + y) AS top_right, arg_max(x, (y - x) * 1000000 + x * 1000 + y) AS bottom_left FROM p GROUP BY l_orderkey"""
)
def corner_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y"))
    return A.corner_points(p, ["l_orderkey"]).select("l_orderkey", "top_left.x", F.col("top_right.x").alias("_r"), F.col("bottom_right.x").alias("_b"), F.col("bottom_left.x").alias("_l")).toDF("l_orderkey", "top_left", "top_right", "bottom_right", "bottom_left")


@query(f"WITH {LINES}, g AS (SELECT doc_id, text, avg((doc_id * 31 + pos * 17) % 100 / 100.0::DOUBLE) AS c, COUNT(*) AS n FROM lines GROUP BY doc_id, text), s AS (SELECT *, (c + 0.15::DOUBLE * (n - 1) + 0.04::DOUBLE * 0.5) * CASE WHEN length(text) >= 3 THEN 1.0 ELSE 0.5 END AS score FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, text) AS r FROM s) SELECT doc_id, text, n, round(score, 6) AS score FROM r WHERE r = 1")
def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    c = _boxed(_lines(spark, d)).select("doc_id", "text", F.col("confidence").alias("conf"), F.lit(0.5).alias("lm"))
    return metrics.consensus(c, ["doc_id"]).select("doc_id", "text", "n", F.round("score", 6).alias("score"))


@query("SELECT doc_id, saved_percent FROM (SELECT doc_id, round(greatest(0.0, (1 - least(length(text), strlen(text))::DOUBLE / nullif(strlen(text), 0)) * 100), 6) AS saved_percent FROM documents)")
def compression_saved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.saved_percent(F.octet_length("text"), F.length("text"), F.octet_length("text")), 6).alias("saved_percent"))


@query("SELECT page_id, 'https://files/' || page_id || '/pages/' || (page_id % 7) || '/binary.png' AS url FROM pages")
def artifact_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.artifact_url("https://files/", F.col("page_id"), F.col("page_id") % 7, "binary.png").alias("url"))


@query(
    f"""WITH {VARIANTS}, c AS (SELECT doc_id, pos, text, (doc_id * 31 + pos * 17) % 100 / 100.0::DOUBLE AS conf, CASE WHEN pos % 3 = 0 THEN -1.0 ELSE 0.0 END AS penalty, length(text) * 8 + 1 AS w, 18 + pos % 17 AS h FROM v)
SELECT doc_id, pos FROM c WHERE conf >= 0.9 AND length(text) >= 8 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 2 AND penalty = 0 AND w >= 50 AND h >= 14 AND w >= 1.2 * h"""
)
def pseudo_label_accept(spark: SparkSession, d: str) -> DataFrame:
    c = _boxed(_variants(spark, d)).select("doc_id", "pos", "text", F.col("confidence").alias("conf"), F.when(F.col("pos") % 3 == 0, -1.0).otherwise(0.0).alias("penalty"), F.col("bbox_w").alias("w"), F.col("bbox_h").alias("h"))
    return metrics.pseudo_labels(c, 0.9).select("doc_id", "pos")


@query("SELECT DISTINCT lower(n_name) AS word FROM nation UNION SELECT DISTINCT lower(r_name) FROM region UNION SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) FROM part")
def vocabulary_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lower(c).alias("word")) for t, c in (("nation", "n_name"), ("region", "r_name"))]
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return parts[0].union(parts[1]).union(names).distinct()


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'no image' ELSE o_orderpriority END AS error_message FROM orders"""
)
def status_update(spark: SparkSession, d: str) -> DataFrame:
    """A transition whose message is written only where there is one."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("error_message"))
    change = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("FAILED").alias("status"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("no image")).alias("error_message"))
    return R.patch(o, change, "o_orderkey", ["status", "error_message"])


@query(
    """SELECT c.c_custkey, COALESCE(e.content, 'made for ' || c.c_custkey) AS content FROM customer c LEFT JOIN (SELECT o_custkey, 'order ' || o_orderkey AS content FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1) e ON c.c_custkey = e.o_custkey"""
)
def stored_or_made(spark: SparkSession, d: str) -> DataFrame:
    """The newest stored export, else one made now."""
    o = S.latest(table(spark, d, "orders").filter("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    stored = o.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("content"))
    return R.stored_or_made(table(spark, d, "customer").select("c_custkey"), stored, "c_custkey", F.concat(F.lit("made for "), F.col("c_custkey").cast("string")))


@query("SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus HAVING COUNT(*) > 1")
def unique_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
z AS (SELECT conv_id, turn, unnest(range(least(len(x), len(y)))) AS k, unnest(x[1:least(len(x), len(y))]) AS old, unnest(y[1:least(len(x), len(y))]) AS new FROM p)
SELECT conv_id, turn, k, old, new FROM z WHERE lower(old) <> lower(new) AND length(old) >= 2 AND length(new) >= 2"""
)
def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words by position of two texts, the shorter decides; pairs that differ."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("x"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    n = F.least(F.size("x"), F.size("y"))
    z = p.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.slice("x", F.lit(1), n).alias("old"), F.slice("y", F.lit(1), n).alias("new"))).alias("k", "z"))
    return z.select("conv_id", "turn", F.col("k").cast("long").alias("k"), "z.old", "z.new").filter("lower(old) <> lower(new) and length(old) >= 2 and length(new) >= 2")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE CAST(round(n / 1024.0::DOUBLE, 1) AS VARCHAR) || ' KB' END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.byte_size(F.octet_length("text")).alias("size"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^a-z ]', '', 'g')) AS kept FROM documents")
def character_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.keep_characters(F.col("text"), _VOC)).alias("kept"))


#: Our own phrases (a line that matches becomes the phrase) and terms by subject.
PHRASES = [("^x = y \\+", "sum of two"), ("^1\\. the ", "first of all"), (" of$", "part of a whole"), ("^- [0-9]+", "counted item")]
TERMS = {"sums": [("sum of two", "x + y"), ("part", "share")], "lists": [("first", "1st"), ("counted", "numbered")]}
_BOUND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{r}'" for p, r in PHRASES) + " WHEN length(e) <= 1 THEN '' ELSE e END"


def _terms_sql(x: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


_BREAK = "([\\p{L}\\p{N}\\p{M}_]+)[-.]$"
_KNOWN = "CASE " + " ".join(f"WHEN starts_with(p, '{a}') AND starts_with(f, '{b}') THEN {{'word': '{w}', 'keep': {str(k).lower()}}}" for a, b, w, k in S.BROKEN_WORDS) + " END"
_STEM = "CASE " + " ".join(f"WHEN starts_with(p || f, '{a}') THEN '{w}'" for a, w in S.WHOLE_WORDS) + " ELSE p || f END"


@query(
    f"""WITH {_TOKENS}, {_TRI}, {_LEXICON}, {VARIANTS.removeprefix(LINES + ", ")}, s AS (SELECT doc_id, pos, {STRIP.format("text")} AS x FROM v), c AS (SELECT doc_id, pos, {_CLEAN_SQL} AS t FROM s),
n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM c WHERE t <> ''),
b AS (SELECT *, CASE WHEN n IS NOT NULL THEN lower(regexp_extract(t, '{_BREAK}', 1)) END AS p, regexp_replace(lower(regexp_extract(n, '^(\\S*)', 1)), '[.,;:!?]+$', '') AS f, regexp_extract(n, '^\\S*\\s(.*)$', 1) AS rem FROM n),
k AS (SELECT *, COALESCE(p <> '', false) AS br, CASE WHEN p <> '' THEN {_KNOWN} END AS known FROM b), h AS (SELECT *, br AND known IS NULL AND rem = '' AND length(f) <= 5 AS short FROM k),
a AS (SELECT *, CASE WHEN br AND known IS NULL AND NOT short THEN p || f END AS asked FROM h), u AS (SELECT DISTINCT asked AS word FROM a WHERE asked IS NOT NULL),
g AS (SELECT word, substring('^^' || word || '$$', CAST(unnest(range(1, length(word) + 3)) AS INTEGER), 3) AS tri FROM u WHERE length(word) >= 6),
m AS (SELECT word, avg(ln(greatest(1e-12, (COALESCE(n, 0) + 0.01) / ((SELECT SUM(n) FROM tri) + 50.0)))) AS m FROM g LEFT JOIN tri USING (tri) GROUP BY word),
good AS (SELECT word FROM u WHERE word IN (SELECT word FROM lexicon) UNION SELECT word FROM m WHERE NOT regexp_matches(word, '[a-z]') OR m >= -9),
e AS (SELECT a.*, good.word IS NOT NULL AS good, COALESCE(known.keep AND rem <> '', false) AS keeps FROM a LEFT JOIN good ON a.asked = good.word),
i AS (SELECT *, NOT keeps AND (known IS NOT NULL OR short OR good) AS uses FROM e),
j AS (SELECT *, COALESCE(SUM(CASE WHEN uses THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM i),
o AS (SELECT *, uses AND row_number() OVER (PARTITION BY doc_id, isl ORDER BY pos) % 2 = 1 AS take FROM j), q AS (SELECT *, COALESCE(lag(take) OVER (PARTITION BY doc_id ORDER BY pos), false) AS used FROM o),
r AS (SELECT *, COALESCE(lag(keeps AND NOT used) OVER (PARTITION BY doc_id ORDER BY pos), false) AS cut FROM q),
w AS (SELECT *, CASE WHEN cut THEN regexp_extract(t, '^\\S*\\s(.*)$', 1) ELSE t END AS own, CASE WHEN known IS NOT NULL THEN known.word WHEN short THEN {_STEM} || '.' WHEN good THEN p || f || CASE WHEN rem <> '' THEN ' ' || rem ELSE '' END END AS ending FROM r WHERE NOT used)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, CASE WHEN ending IS NOT NULL THEN regexp_replace(own, '{_BREAK}', '') || ending ELSE own END AS text FROM w"""
)
def dewrapped(spark: SparkSession, d: str) -> DataFrame:
    """Words that a line's end breaks, put together by the lexicon and by trigrams of letters."""
    return S.dewrap(_variants(spark, d), _lexicon(spark, d), lm.char_trigrams(_tokens(spark, d)))


@query(
    f"""WITH {VARIANTS}, s AS (SELECT doc_id, pos, {STRIP.format("text")} AS x FROM v), n AS (SELECT doc_id, pos, {_CLEAN_SQL} AS c FROM s),
e AS (SELECT *, {STRIP.format("regexp_replace(regexp_replace(c, '\\s+([.,;:!?])', '\\1', 'g'), '([,;])(\\p{L})', '\\1 \\2', 'g')")} AS e FROM n), b AS (SELECT doc_id, pos, {_BOUND_SQL} AS t FROM e)
SELECT doc_id, pos, CASE doc_id % 3 WHEN 0 THEN {_terms_sql("t", TERMS["sums"])} WHEN 1 THEN {_terms_sql("t", TERMS["lists"])} ELSE t END AS text FROM b"""
)
def phrase_bound_lines(spark: SparkSession, d: str) -> DataFrame:
    """Noise stripping, first matching phrase, spacing, then the terms of the line's subject."""
    subject = F.when(F.col("doc_id") % 3 == 0, "sums").when(F.col("doc_id") % 3 == 1, "lists").otherwise("none")
    return _variants(spark, d).select("doc_id", "pos", T.replace_subject_terms(T.bound(F.col("text"), PHRASES), subject, TERMS).alias("text"))


#: Our own replacements and phrases, and how often a word of five letters and more stands to be a term.
REPLACEMENTS, SNAP_PHRASES, TERM = [("thion", "nation"), ("whith", "which")], [("[0-9]+ ", "counted item"), (".*\\bin the\\b.*\\bof the\\b", "in and of the")], 50
_W = "\\p{L}\\p{N}\\p{M}_"
_TIDY_SQL = "regexp_replace(regexp_replace(t, '[\"''«»]', '', 'g'), '\\s*\\|\\s*$', '')"
for _old, _made in [("^\\s*\\|\\s*", ""), ("\\s*\\|\\s*\\|\\s*", " | "), ("\\s*,\\s*,+", ","), ("\\s*\\.\\s*\\.+", "."), ("\\s*:\\s*:+", ":"), ("\\s*;\\s*;+", ";"), ("\\s+", " ")]:
    _TIDY_SQL = f"regexp_replace({_TIDY_SQL}, '{_old}', '{_made}', 'g')"
_PHRASE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '^(?:{p})') THEN '{r}'" for p, r in SNAP_PHRASES) + " END"


@query(
    f"""WITH RECURSIVE v AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS word FROM documents) WHERE length(word) >= 5 GROUP BY word HAVING COUNT(*) >= {TERM}),
l AS (SELECT item_id, unnest(generate_series(0, len(x) - 1))::INTEGER AS pos, {STRIP.format("unnest(x)")} AS s FROM (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark)),
h AS (SELECT *, {_PHRASE_SQL} AS phrase FROM l), k AS (SELECT item_id, pos, unnest(regexp_split_to_array(s, '\\s+')) AS token, generate_subscripts(regexp_split_to_array(s, '\\s+'), 1) AS k FROM h WHERE phrase IS NULL AND s <> ''),
c AS (SELECT *, CASE WHEN length(lower(regexp_replace(token, '[^{_W}-]', '', 'g'))) >= 4 THEN lower(regexp_replace(token, '[^{_W}-]', '', 'g')) END AS word FROM k),
f(word, best) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in REPLACEMENTS)}), q AS (SELECT DISTINCT word FROM c WHERE word IS NOT NULL AND word NOT IN (SELECT word FROM f)),
ql AS (SELECT word, list_transform(list_distinct(string_split(word, '')), lambda x: {{'c': x, 'n': length(word) - length(replace(word, x, ''))}}) AS bag FROM (SELECT word FROM q UNION SELECT word FROM v)), qb AS (SELECT word, b.c AS c, b.n AS n FROM (SELECT word, unnest(bag) AS b FROM ql)),
o AS (SELECT x.word AS b, y.word AS a FROM (SELECT * FROM qb WHERE word IN (SELECT word FROM q)) x JOIN (SELECT * FROM qb WHERE word IN (SELECT word FROM v)) y ON x.c = y.c GROUP BY x.word, y.word HAVING 2.0::DOUBLE * SUM(least(x.n, y.n)) / (length(x.word) + length(y.word)) >= 0.72),
p AS (SELECT a, b FROM o), {_RATIOS}, m AS (SELECT b AS word, arg_max(a, (ratio, a)) AS best FROM ratios WHERE ratio >= 0.72 GROUP BY b UNION ALL SELECT word, best FROM f),
n AS (SELECT item_id, pos, k, CASE WHEN best IS NULL THEN token ELSE regexp_extract(token, '^([^{_W}]*)', 1) || CASE WHEN substring(token, 1, 1) = upper(substring(token, 1, 1)) AND substring(token, 1, 1) <> lower(substring(token, 1, 1)) THEN upper(substring(best, 1, 1)) || substring(best, 2) ELSE best END || regexp_extract(token, '([^{_W}]*)$', 1) END AS token FROM c LEFT JOIN m ON c.word = m.word),
g AS (SELECT item_id, pos, string_agg(token, ' ' ORDER BY k) AS t FROM n GROUP BY item_id, pos), e AS (SELECT item_id, pos, {STRIP.format(_TIDY_SQL)} AS t FROM g)
SELECT h.item_id, h.pos, COALESCE(phrase, CASE WHEN e.t IS NULL OR length(regexp_replace(e.t, '[^{_W}]', '', 'g')) <= 1 AND NOT regexp_matches(e.t, '^\\p{{Nd}}+$') THEN '' ELSE e.t END) AS text FROM h LEFT JOIN e ON h.item_id = e.item_id AND h.pos = e.pos"""
)
def bound_lines(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's lines: phrases, else words snapped to the documents' terms by similarity ratio, marks tidied. Debris of recognition is not looked for here: SQL's patterns cannot look around."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), 0)).alias("word"))
    terms = w.filter(F.length("word") >= 5).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TERM).select("word")
    fixed = spark.createDataFrame(REPLACEMENTS, "word string, replacement string")
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return distance.bound_lines(rows, terms, fixed, SNAP_PHRASES, ["item_id", "pos"], debris="(?!)")


def _angle_rows(some: list[tuple[float, float, float]]) -> str:
    return "(VALUES " + ", ".join(f"({a!r}::DOUBLE, {c!r}::DOUBLE, {s!r}::DOUBLE)" for a, c, s in some) + ") t(a, c, s)"


#: Pages whose words stand where their lines and places put them, each page on a slope of its own: y, x of each word.
_PAGE_POINTS = f"{LINES}, w AS (SELECT doc_id, pos, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS k FROM lines), k AS (SELECT DISTINCT doc_id, pos * 12 + CAST(floor(k * 6 * ((doc_id % 13) - 6) / 60.0::DOUBLE) AS BIGINT) AS y0, k * 6 AS x FROM w), ink AS (SELECT doc_id, y0 - MIN(y0) OVER (PARTITION BY doc_id) AS y, x FROM k)"


@query(
    f"""WITH {_PAGE_POINTS}, cells AS (SELECT doc_id, a, CAST(floor(y * c - x * s + 0.5) AS BIGINT) AS o, COUNT(*) AS n FROM ink, {_angle_rows(G.angles(-G.LINES + 1, G.LINES, 1))} GROUP BY 1, 2, 3 HAVING COUNT(*) >= 12),
pk AS (SELECT doc_id, a FROM cells x WHERE NOT EXISTS (SELECT 1 FROM cells y WHERE x.doc_id = y.doc_id AND abs(x.a - y.a) <= 1 AND abs(x.o - y.o) <= 1 AND (y.n, -y.a, -y.o) > (x.n, -x.a, -x.o))),
ln AS (SELECT doc_id, median(a) AS angle FROM pk GROUP BY doc_id HAVING COUNT(*) >= {G.PEAKS}),
pr AS (SELECT doc_id, a, SUM(n * n)::BIGINT AS q, SUM(n)::BIGINT AS t FROM (SELECT doc_id, a, CAST(floor(y * c - x * s + 0.5) AS BIGINT) AS o, COUNT(*) AS n FROM ink, {_angle_rows(G.angles(-G.SWEEP, G.SWEEP, G.STEP))} GROUP BY 1, 2, 3) GROUP BY doc_id, a),
hh AS (SELECT doc_id, (MAX(y) + 1)::DOUBLE AS h, COUNT(*) AS ink FROM ink GROUP BY doc_id), sp AS (SELECT doc_id, a, q / h - t / h * (t / h) AS v FROM pr JOIN hh USING (doc_id)), pa AS (SELECT doc_id, arg_max(a, (v, -abs(a), -a)) AS angle FROM sp GROUP BY doc_id),
en AS (SELECT doc_id, y, MIN(x) AS x FROM ink GROUP BY doc_id, y UNION SELECT doc_id, y, MAX(x) FROM ink GROUP BY doc_id, y), bx AS (SELECT doc_id, a, round((MAX(x * c + y * s) - MIN(x * c + y * s)) * (MAX(y * c - x * s) - MIN(y * c - x * s)), 6) AS v FROM en, {_angle_rows(G.angles(-45, 45, G.STEP))} GROUP BY doc_id, a),
ba AS (SELECT doc_id, arg_min(a, (v, abs(a), a)) AS angle FROM bx GROUP BY doc_id)
SELECT doc_id, CASE WHEN ln.angle IS NOT NULL THEN 'lines' WHEN ink < {G.INK} THEN 'nothing' WHEN abs(pa.angle) >= {G.LEAST} THEN 'profile' ELSE 'box' END AS "by",
 CASE WHEN ln.angle IS NOT NULL THEN ln.angle WHEN ink < {G.INK} THEN 0.0::DOUBLE WHEN abs(pa.angle) >= {G.LEAST} THEN pa.angle WHEN abs(ba.angle) > {G.BOX} THEN 0.0::DOUBLE ELSE ba.angle END AS angle FROM hh LEFT JOIN ln USING (doc_id) LEFT JOIN pa USING (doc_id) LEFT JOIN ba USING (doc_id)"""
)
def page_skew(spark: SparkSession, d: str) -> DataFrame:
    """The slope of pages that are laid out from the documents' words: by lines, by profile or by the smallest box."""
    # lines with their numbers of words are dealt out by page, so all later steps find a page where it is
    w = _lines(spark, d).select("doc_id", "pos", F.regexp_count("text", F.lit("\\S+")).alias("n")).filter("n > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    x = F.col("k") * 6
    w = w.select("doc_id", "pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    ink = w.select("doc_id", (F.col("pos") * 12 + F.floor(x * (F.col("doc_id") % 13 - 6) / F.lit(60.0))).alias("y"), x.alias("x")).distinct()
    ink = ink.withColumn("y", F.col("y") - F.min("y").over(S.Window.partitionBy("doc_id")))
    return G.skew(ink, ink, "doc_id", votes=12)


class NumberedReplies:
    """A stand-in for a service: what it does hangs on the request's digest alone. One request in sixteen fails, one is always refused, one is refused at first; the rest name each line."""

    def __init__(self):
        self.refused: set[str] = set()

    def ask(self, request: str, key: str) -> services.Reply:
        digit = hashlib.md5(request.encode()).hexdigest()[0]
        if digit == "0":
            return services.Reply(500, "error")
        if digit == "1" or (digit == "2" and key not in self.refused):
            self.refused.add(key)
            return services.Reply(429, "slow down")
        lines_ = re.findall(r"^\[Line (\d+)\]: ", request, re.M)
        return services.Reply(200, json.dumps({"corrections": [{"line_index": int(k), "corrected_text": f"checked {k}"} for k in lines_ if int(k) % 2 == 0]}))


@query(
    f"""WITH n AS (SELECT conv_id, turn, text, (conv_id * 31 + turn * 17) % 100 / 100.0::DOUBLE AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
q AS (SELECT conv_id, n // 4 AS chunk, substring(md5(string_agg('[Line ' || turn || ']: ' || {STRIP.format("text")}, chr(10) ORDER BY turn)), 1, 1) AS h FROM n GROUP BY 1, 2),
s AS (SELECT *, CASE h WHEN '0' THEN 'failed' WHEN '1' THEN 'limited' ELSE 'success' END AS answer, CASE h WHEN '0' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 2 ELSE 1 END AS attempts FROM q), p AS (SELECT conv_id, MAX(CAST(answer = 'failed' AS INTEGER)) AS bad FROM s GROUP BY conv_id),
f AS (SELECT n.*, answer, attempts, bad, CASE WHEN bad = 0 AND answer = 'success' AND turn % 2 = 0 THEN 'checked ' || turn ELSE text END AS t FROM n JOIN s ON n.conv_id = s.conv_id AND n.n // 4 = s.chunk JOIN p ON n.conv_id = p.conv_id)
SELECT conv_id, turn, t AS corrected_text, lower({STRIP.format("t")}) <> lower({STRIP.format("text")}) AS changed, round(CASE WHEN lower({STRIP.format("t")}) <> lower({STRIP.format("text")}) THEN least(0.98::DOUBLE, c + 0.12::DOUBLE) ELSE c END, 6) AS confidence,
 CASE bad WHEN 0 THEN 'hybrid' ELSE 'heuristic' END AS mode, CASE bad WHEN 0 THEN 'success' ELSE 'fallback_success' END AS status, answer, attempts FROM f"""
)
def provider_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations corrected by a service's stand-in, four a call; conversations with a failed call keep their lines."""
    confidence = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 100) / F.lit(100.0)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", confidence.alias("confidence"))
    first = rows.select("conv_id", "turn", F.col("text").alias("corrected_text"), F.lit(False).alias("changed"), "confidence")
    chunks, requests = services.chunk_requests(rows, "conv_id", "turn", 4)
    asked = requests.withColumn("key", F.sha2("request", 256))
    answers = services.called(asked.select("key", "request").dropDuplicates(["key"]), NumberedReplies, pause=0.0)
    results = asked.select("conv_id", "chunk", "key").join(answers, "key")
    out = services.corrected(rows, first, results, chunks, "conv_id", "turn").withColumn("confidence", F.round("confidence", 6))
    told = chunks.select("conv_id", "turn", "chunk").join(results.select("conv_id", "chunk", F.col("status").alias("answer"), "attempts"), ["conv_id", "chunk"]).drop("chunk")
    return out.join(told, ["conv_id", "turn"])
