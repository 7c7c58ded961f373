"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

SPACE = "[^\\x20\\x09-\\x0D]+"
_WORDS = f"regexp_extract_all(COALESCE(text, ''), '{SPACE}')"

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[CAST(i AS INTEGER):CAST(i + 12 AS INTEGER)], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
r AS (SELECT doc_id, i, MIN(doc_id) OVER (PARTITION BY k) AS least FROM g),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM r WHERE least < doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, COUNT(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - COALESCE(k.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

_WEIGHT = "[5, 2, 1][CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS INTEGER)]"


def _seats(parties: str, within: str, key: str, votes: str, seats: str, name: str, out: str) -> str:
    """Common table expressions: `out` is `parties` with `name`, by highest quotients."""
    return f"""{out}_a AS (SELECT *, {votes} / greatest(SUM({votes}) OVER (PARTITION BY {within}), 1e-9) * COUNT(*) OVER (PARTITION BY {within}) / 2 AS slack FROM {parties}),
{out}_b AS (SELECT *, greatest(0, floor({votes} / block - slack) - 2)::BIGINT AS lo, greatest(0, ceil({votes} / block + slack) + 2)::BIGINT AS hi FROM {out}_a),
{out}_c AS (SELECT *, {seats} - SUM(lo) OVER (PARTITION BY {within}) AS rest FROM {out}_b),
{out}_d AS (SELECT *, unnest(range(lo, hi + 1)) AS q FROM {out}_c WHERE {votes} > 0),
{out}_e AS (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY {votes} / (2 * q + 1) DESC, {key}, q) AS r FROM {out}_d),
{out}_f AS (SELECT {within}, {key}, MIN(lo) + COUNT(*) FILTER (r <= rest) AS {name} FROM {out}_e GROUP BY {within}, {key}),
{out} AS (SELECT p.*, COALESCE(f.{name}, 0) AS {name} FROM {parties} p LEFT JOIN {out}_f f ON p.{within} = f.{within} AND p.{key} = f.{key})"""


def source_mixing(digits: int = 2) -> str:
    return f"""WITH d AS (SELECT doc_id, COALESCE('s' || source, 't') AS s, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
a AS (SELECT s, SUM(size)::BIGINT AS source_size FROM d GROUP BY s),
b AS (SELECT *, {_WEIGHT} AS w, source_size * 2 AS cap, (SUM(source_size) OVER ())::BIGINT AS total FROM a),
c AS (SELECT *, (total * 150 / 100.0::DOUBLE - COALESCE(SUM(cap) OVER o, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER o, 0)) AS level FROM b WINDOW o AS (ORDER BY cap / w::DOUBLE, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT s, source_size, least(cap::DOUBLE, w * COALESCE((SELECT arg_min(level, (cap / w::DOUBLE, s)) FROM c WHERE level * w <= cap), 0.0)) AS target, total FROM c),
z AS (SELECT s, substring(h, 1, {digits}) AS shard, SUM(size)::BIGINT AS shard_size FROM d GROUP BY s, shard),
y AS (SELECT z.*, e.source_size, e.target, e.target * shard_size / greatest(e.source_size, 1) AS votes FROM z JOIN e ON z.s = e.s),
k AS (SELECT greatest(1, least(1024, floor(COALESCE(MIN(votes) FILTER (votes > 0), 0) / 100)))::BIGINT AS block FROM y),
src AS (SELECT e.*, block, 0 AS everything, CAST(round(total * 150 / 100.0::DOUBLE / block) AS BIGINT) AS n_blocks FROM e, k),
{_seats("src", "everything", "s", "target", "n_blocks", "quota", "sq")},
sh AS (SELECT y.*, sq.block, sq.quota FROM y JOIN sq ON y.s = sq.s),
{_seats("sh", "s", "shard", "votes", "quota", "shard_quota", "ss")},
x AS (SELECT *, least(shard_quota * block, shard_size * 2)::BIGINT AS words, CAST('0x' || substring(md5('mix:' || s || ':' || shard), 1, 8) AS BIGINT) % greatest(1, ceil(shard_size / block::DOUBLE)::BIGINT) * block AS start, greatest(shard_size, 1) AS whole FROM ss),
l AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY s, substring(h, 1, {digits}) ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target, block, CAST(words // whole * size + greatest(0, least(before + size, start + words % whole, whole) - greatest(before, start)) + greatest(0, least(before + size, start + words % whole - whole) - before) AS BIGINT) AS taken
FROM l JOIN x ON l.s = x.s AND substring(l.h, 1, {digits}) = x.shard"""


SOURCE_MIXING = source_mixing()

QUALITY_RULES = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, {_WORDS} AS w, list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, array_to_string(w[CAST(i AS INTEGER):CAST(i + 7 AS INTEGER)], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
r AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS capitals, len(ls) AS n_lines FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 2 * capitals > word_chars OR (n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines) OR word_chars > 30 * n_words OR 10 * word_chars < 15 * n_words) AS kept FROM b"""

LINE_DEDUP = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, p, line, regexp_extract_all(line, '{SPACE}') AS w FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d)),
k AS (SELECT doc_id, p, array_to_string(w, ' ') AS s, w FROM l WHERE len(w) >= 1), f AS (SELECT s, ANY_VALUE(w) AS w, MIN((doc_id, p)) AS o FROM k GROUP BY s),
v AS (SELECT s, o, i, array_to_string(list_concat(w[1:CAST(i - 1 AS INTEGER)], w[CAST(i + 1 AS INTEGER):]), ' ') AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 8)),
a AS (SELECT o FROM (SELECT o, MIN(o) OVER (PARTITION BY i, x) AS m FROM v) WHERE m < o), b AS (SELECT x, MIN(o) AS m FROM v GROUP BY x), long AS (SELECT s, o FROM f WHERE len(w) >= 8),
c AS (SELECT long.o FROM long JOIN b ON long.s = b.x WHERE b.m < long.o UNION SELECT v.o FROM v JOIN long ON v.x = long.s WHERE long.o < v.o),
n AS (SELECT o FROM a UNION SELECT o FROM c UNION SELECT (k.doc_id, k.p) FROM k JOIN f ON k.s = f.s WHERE (k.doc_id, k.p) <> f.o),
q AS (SELECT l.doc_id, COUNT(*) AS n_lines, COUNT(n.o) AS n_removed, string_agg(line, chr(10) ORDER BY l.p) FILTER (n.o IS NULL) AS kept FROM l LEFT JOIN n ON (l.doc_id, l.p) = n.o GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM q"""

_FOLDED = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(i AS INTEGER):CAST(i + 4 AS INTEGER)], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, c.component_id, COALESCE(k.k, 0) AS n_links FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, MIN(b) AS component_id FROM r GROUP BY a) c ON d.doc_id = c.a LEFT JOIN (SELECT a, COUNT(*) AS k FROM e GROUP BY a) k ON d.doc_id = k.a"""

_ALNUM = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[CAST(i AS INTEGER):CAST(i + 9 AS INTEGER)], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(w[CAST(i AS INTEGER):CAST(i + n - 1 AS INTEGER)], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, g.n, item_id FROM g JOIN q ON g.k = q.k AND g.n = q.n),
h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

FILTER_AUDIT = f"""WITH k AS (SELECT doc_id, MAX(CAST(quality = 1 AS INTEGER)) AS good, MAX(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t, {_WORDS} AS w FROM documents),
m AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(MIN(d.doc_id) OVER (PARTITION BY t) < d.doc_id AS INTEGER) AS mask FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
c AS (SELECT part, mask, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, bit)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, COALESCE(list_sum(bits[1:step - 1]), 0)::INTEGER AS gone FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, SUM(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS kept, SUM(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN n ELSE 0 END) AS removed, SUM(CASE WHEN mask & bit > 0 AND mask & gone > 0 THEN n ELSE 0 END) AS redundant,
 SUM(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, SUM(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN good ELSE 0 END) AS good_lost, SUM(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 CAST(SUM(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

VECTOR_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), n AS (SELECT a, COUNT(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept FROM embeddings m LEFT JOIN n ON m.vec_id = n.a JOIN (SELECT a, MIN(b) AS component_id FROM r GROUP BY a) c ON m.vec_id = c.a"""

PHRASE_MINING = f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_extract_all({_FOLDED}, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(w[CAST(i AS INTEGER):CAST(i + k - 1 AS INTEGER)], ' ') AS phrase, COUNT(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) q(k) WHERE len(w) >= k) GROUP BY 1, 2, 3),
n AS (SELECT lang, SUM(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT *, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest([1, 2]) AS j FROM c) WHERE j < k),
s AS (SELECT u.lang, u.k, u.phrase, a, j, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score FROM u JOIN g x ON u.lang = x.lang AND u.x = x.phrase JOIN g y ON u.lang = y.lang AND u.y = y.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
z AS (SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN z ON b.k = 2 AND b.lang = z.lang AND b.phrase = z.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT t.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM t JOIN n ON t.lang = n.lang WHERE rank <= 2000"""
