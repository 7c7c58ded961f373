"""N-gram Jaccard join on a prefix tree, and the groups that its links make.

1. Documents whose shingles are mostly theirs alone drop out: a partner at 0.75
   shares three quarters of a document's shingles. One packed exchange counts, of each document, the shingles that
   stand in another document too.
2. Equal sets become one; of these the shared shingles are counted again and
   ordered by how many sets have them. Two sets that link share one of their
   rarest n - ceil(0.75 n) + 1 shingles, so sets that share no such shingle, directly or in a chain, fall into different blocks.
3. In each block the sets stand in a prefix tree, common shingles first. A set is joined by walking the tree with
   the overlap so far; a subtree goes when what is left of the set and of the subtree's
   longest member cannot reach the overlap that is needed. All links are found and counted, each set with the
   documents that have it; only those that join groups are put out, not all pairs. For that many sets walk the tree
   at once, as in a group of near copies each meets each. Where groups alone are asked
   for, a subtree whose members are already in the set's group needs no walk.
4. Links make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import kernels as K
from quillframe.llm import packed as P
from quillframe.llm.common import NULL_ID, buckets, chunks, keyed, map_batches, materialize, own_id, whole_row
from quillframe.llm.components import components

SHINGLE = 5
#: Links at 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
CHUNK = 4 << 20
#: Sets that one tree holds at most; a larger block is joined shard by shard.
BLOCK = 4000
#: Into how many parts a large block is dealt before its shards are known.
SALTS = 64
#: Bytes that tell which of the sets that walk a tree together has which rank, and tokens that they pass between two looks at the bound (255 at most).
MARKS = 64 << 20
STEP = 64
_NONE = np.uint32(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle, sorted by document and hash. Fewer words than n make one shingle."""
    data = K.fold(data)
    w = K.words(data, offsets, K.SPACE)
    h = K.word_hash(data, w)
    at = np.flatnonzero(K.gram_starts(w.first, n, len(h)))
    doc, key = w.doc[at] if len(at) else at, K.gram_hash(h, n)[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            total[has] += h[w.first[short[has]] + k] * K.PLACE[k]
        doc, key = np.append(doc, short), np.append(key, K.mix(total + count[short].astype(np.uint64) * K.PLACE[40]))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def _shared(docs: DataFrame, n: int, n_parts: int) -> DataFrame:
    """_id, _sum, n_shingles, shared of each row: how many of its shingles stand in another row too (some more by chance of 39 bits and up)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            doc, key = shingles(data, offsets, n)
            chunk, n_docs = numbers.next(), len(offsets) - 1
            count = np.bincount(doc, minlength=n_docs)
            rows = [P.passing(n_parts, chunk, P.NAMES, P.pack(t.column("_id").to_numpy(), t.column("_sum").to_numpy(), count.astype(np.int64)))]
            order = np.argsort(key)
            doc, key = doc[order].astype(np.uint32), key[order]
            b = K.group_bounds(key)
            size = np.diff(b)
            if len(key):
                rows.append(P.passing(n_parts, chunk, P.HITS, P.pack(doc[np.repeat(size > 1, size)])))
                place = np.where(size > 1, _NONE, doc[b[:-1]])
                key = key[b[:-1]]
                part = ((key >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
                low = key.astype(np.uint32)
                order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | low)
                rows += P.dealt(n_parts, chunk, part[order], low[order], place[order])
            yield P.batch(rows)

    def answer(key: np.ndarray, place: np.ndarray, _: np.ndarray) -> tuple[np.ndarray]:
        order = np.argsort(key, kind="stable")
        b = K.group_bounds(key[order])
        size = np.diff(b)
        many = (size > 1) | (np.maximum.reduceat(place[order], b[:-1]) == _NONE)
        found = order[np.repeat(many, size)]
        return (found[place[found] != _NONE],)

    def gather(places: np.ndarray, _: list, names: list[np.ndarray]) -> pa.Table:
        ids, sums, count = names
        return pa.Table.from_arrays([pa.array(ids), pa.array(sums), pa.array(count), pa.array(np.bincount(places, minlength=len(ids)), pa.int64())], names=["_id", "_sum", "n_shingles", "shared"])

    return P.exchange(map_batches(docs, scan, P.SCHEMA), n_parts, (np.uint32, np.uint32), answer, gather, (np.int64,) * 3, "_id long, _sum long, n_shingles long, shared long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """_id, _sum, k1, k2 (the set's fingerprint), n, keys (its sorted hashes) of each row with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK):
            data, offsets = K.texts(t.column("text"))
            doc, key = shingles(data, offsets, n)
            bounds = np.searchsorted(doc, np.arange(len(offsets)))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(K.mix(key ^ s))])[bounds] for s in (K.PLACE[41], K.PLACE[42])]
            k1, k2 = (np.diff(s).view(np.int64) for s in sums)
            keys = [key[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(offsets) - 1)]
            yield from pa.Table.from_arrays([t.column("_id"), t.column("_sum"), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds), pa.int64()), pa.array(keys, pa.binary())], names=["_id", "_sum", "k1", "k2", "n", "keys"]).to_batches(1000)

    return map_batches(docs, run, "_id long, _sum long, k1 long, k2 long, n long, keys binary")


def needed(n: int, similarity: int) -> int:
    """Least overlap of a set of n with any set that it links to."""
    return -(-similarity * n // 100)


def _ordered(sets: DataFrame, similarity: int, n_parts: int) -> DataFrame:
    """_id, n, tokens (shared hashes, those of fewest sets first), rare (how many of them the prefix has), of sets that may link.

    A shingle's rank is the number of sets that have it, then its hash: the same everywhere."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = P.Numbers()
        for t in chunks(batches, CHUNK, "keys"):
            chunk = numbers.next()
            ids, count = t.column("_id").to_numpy(), t.column("n").to_numpy()
            rows = [P.passing(n_parts, chunk, P.NAMES, P.pack(ids, count))]
            key = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint64)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), count)
            part = (key % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((key, part))
            rows += P.dealt(n_parts, chunk, part[order], key[order], doc[order])
            yield P.batch(rows)

    def answer(key: np.ndarray, _: np.ndarray, __: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(key, kind="stable")
        size = np.diff(K.group_bounds(key[order]))
        many = np.repeat(size, size)
        found = many > 1
        return order[found], key[order[found]], many[found].astype(np.uint32)

    def gather(places: np.ndarray, more: list[np.ndarray], names: list[np.ndarray]) -> pa.Table:
        ids, count = names
        key, many = more
        order = np.lexsort((key, many, places))
        key, many = key[order], many[order]
        bounds = np.searchsorted(places[order], np.arange(len(ids) + 1))
        out = []
        for i in range(len(ids)):
            a, b, n = bounds[i], bounds[i + 1], int(count[i])
            least = needed(n, similarity)
            if b - a >= least:
                rare = max(0, n - least + 1 - (n - int(b - a)))
                out.append((int(ids[i]), n, key[a:b].tobytes(), many[a:b].tobytes(), [int(x) for x in key[a : a + rare].view(np.int64)]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["_id", "n", "tokens", "many", "rare"])

    return P.exchange(map_batches(sets, scan, P.SCHEMA), n_parts, (np.uint64, np.uint32), answer, gather, (np.int64, np.int64), "_id long, n long, tokens binary, many binary, rare array<long>", (np.uint64, np.uint32))


class _Node:
    """A stretch of tokens of the tree. least and most: sizes of the sets below; longest: their tokens from the root; one: a member, same: whether all below are in its group."""

    __slots__ = ("run", "children", "ends", "least", "longest", "one", "same")

    def __init__(self, run: np.ndarray, least: int, longest: int, one: int):
        self.run, self.children, self.ends, self.least, self.longest, self.one, self.same = run, {}, [], least, longest, one, True


class PrefixTree:
    """Sets of ranks in a compressed tree, and the groups of their indices (union-find)."""

    def __init__(self, sizes: list[int], n_ranks: int, similarity: int):
        self.size, self.similarity = sizes, similarity
        self.parent = list(range(len(sizes)))
        self.mark = np.zeros(n_ranks, bool)
        self.root: _Node | None = None

    def group(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def unite(self, x: int, y: int) -> bool:
        """Joins the groups of x and y; whether they were two."""
        a, b = self.group(x), self.group(y)
        self.parent[a] = b
        return a != b

    def meet(self, xs: np.ndarray, ranks: list[np.ndarray], later: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(y, those of xs that link with it) of each member y; later: only those above y, where members were added in ascending order."""
        if self.root is None or not len(xs):
            return
        s, own, size = self.similarity, np.array([len(r) for r in ranks]), np.array([self.size[x] for x in xs])
        mark = np.zeros((len(self.mark), len(xs)), np.uint8)
        for k, r in enumerate(ranks):
            mark[r, k] = 1
        # how many ranks each has below every STEP-th
        below = np.cumsum(np.add.reduceat(mark, np.arange(0, len(mark), STEP), axis=0, dtype=np.int32), axis=0, dtype=np.int32)
        below = np.concatenate([np.zeros((1, len(xs)), np.int32), below])
        stack = [(self.root, 0, np.arange(len(xs)), np.zeros(len(xs), np.int64))]
        while stack:
            node, depth, who, overlap = stack.pop()
            if later:
                above = xs[who] > node.one
                who, overlap = who[above], overlap[above]
            for at in range(0, len(node.run), STEP):
                run = node.run[at : at + STEP]
                has = mark[run].sum(axis=0, dtype=np.uint8)[who] if 4 * len(who) > len(xs) else mark[run[:, None], who].sum(axis=0, dtype=np.uint8)
                overlap = overlap + has
                depth += len(run)
                left = own[who] - np.maximum(overlap, below[run[-1] // STEP, who])
                # 100 o >= s (n + m - o) for the smallest m below
                may = (100 + s) * (overlap + np.minimum(left, node.longest - depth)) >= s * (size[who] + node.least)
                who, overlap = who[may], overlap[may]
                if not len(who):
                    break
            if not len(who):
                continue
            for y in node.ends:
                found = xs[who[(100 + s) * overlap >= s * (size[who] + self.size[y])]]
                found = found[found > y] if later else found
                if len(found):
                    yield y, found
            stack += [(child, depth, who, overlap) for child in node.children.values()]

    def links(self, x: int, ranks: np.ndarray) -> Iterator[int]:
        """Members that x links to, no more than one from what is one group already, whose groups it then joins."""
        if self.root is None:
            return
        mark, n, s = self.mark, self.size[x], self.similarity
        mark[ranks] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node.same and self.group(node.one) == self.group(x):
                continue
            left = len(ranks)
            if len(node.run):
                overlap += int(np.count_nonzero(mark[node.run]))
                depth += len(node.run)
                left -= int(np.searchsorted(ranks, node.run[-1], side="right"))
            # 100 o >= s (n + m - o) for the smallest m below
            if (100 + s) * (overlap + min(left, node.longest - depth)) < s * (n + node.least):
                continue
            for y in node.ends:
                if (100 + s) * overlap >= s * (n + self.size[y]) and self.unite(x, y):
                    yield y
            first = None
            uniform = all(self.group(y) == self.group(node.one) for y in node.ends)
            for head, child in node.children.items():
                uniform = uniform and child.same and self.group(child.one) == self.group(node.one)
                if mark[head] and first is None:
                    first = child
                else:
                    stack.append((child, depth, overlap))
            if first is not None:
                stack.append((first, depth, overlap))
            node.same = node.same or uniform
        mark[ranks] = False

    def add(self, x: int, ranks: np.ndarray) -> None:
        n, length = self.size[x], len(ranks)
        if self.root is None:
            self.root = _Node(ranks[:0], n, length, x)
        node, at = self.root, 0
        while True:
            node.least, node.longest = min(node.least, n), max(node.longest, length)
            node.same = node.same and self.group(node.one) == self.group(x)
            if at == length:
                node.ends.append(x)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                leaf = _Node(ranks[at:], n, length, x)
                leaf.ends.append(x)
                node.children[int(ranks[at])] = leaf
                return
            m = min(len(child.run), length - at)
            differ = np.flatnonzero(child.run[:m] != ranks[at : at + m])
            m = int(differ[0]) if len(differ) else m
            if m < len(child.run):
                top = _Node(child.run[:m], child.least, child.longest, child.one)
                top.same = child.same
                child.run = child.run[m:]
                top.children[int(child.run[0])] = child
                node.children[int(ranks[at])] = top
                child = top
            node, at = child, at + m


def _join_block(similarity: int, counted: bool = False):
    def join(t: pa.Table) -> pa.Table:
        """Links (a, b) that join groups within a block, or between shard `i` and shard `j` of it; counted: and rows (a, null, links of a), each link as often as documents have the other set."""
        ids, sizes = t.column("_id").to_pylist(), t.column("n").to_pylist()
        # small sets first; a row that the input repeats is one set
        order = sorted({i: k for k, i in enumerate(ids)}.values() if counted else range(len(ids)), key=lambda k: (sizes[k], ids[k]))
        t = t.take(pa.array(order, pa.int64()))
        ids, sizes = [ids[k] for k in order], [sizes[k] for k in order]
        tokens = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        many = [np.frombuffer(x, np.uint32) for x in t.column("many").to_pylist()]
        flat, freq = np.concatenate(tokens), np.concatenate(many)
        distinct, where = np.unique(flat, return_index=True)
        by = np.lexsort((distinct, -freq[where].astype(np.int64)))  # common first
        rank = np.empty(len(distinct), np.int64)
        rank[by] = np.arange(len(distinct))
        ranks = [np.sort(rank[np.searchsorted(distinct, x)]) for x in tokens]
        mine = t.column("shard").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        tree = PrefixTree(sizes, len(distinct), similarity)
        found: list[tuple[int, int]] = []
        if counted:
            for x in np.flatnonzero(mine == i).tolist():
                tree.add(x, ranks[x])
            times, count, group = t.column("times").to_numpy(), np.zeros(len(ids), np.int64), np.arange(len(ids))
            asked, width = np.flatnonzero(mine == j), max(1, MARKS // max(1, len(distinct)))
            for at in range(0, len(asked), width):
                xs = asked[at : at + width]
                for y, linked in tree.meet(xs, [ranks[x] for x in xs], i == j):
                    count[y] += times[linked].sum()
                    count[linked] += times[y]
                    apart = linked[group[linked] != group[y]]
                    for x in apart[np.unique(group[apart], return_index=True)[1]].tolist():
                        found.append((x, y))
                        group[group == group[x]] = group[y]
            some = np.flatnonzero(count).tolist()
            a, b = [x for x, _ in found] + some, [ids[y] for _, y in found] + [None] * len(some)
            return pa.Table.from_arrays([pa.array([ids[x] for x in a], pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(found) + count[some].tolist(), pa.int64())], names=["a", "b", "n_links"])
        if i == j:
            for x in range(len(ids)):
                found += [(x, y) for y in tree.links(x, ranks[x])]
                tree.add(x, ranks[x])
        else:
            for x in np.flatnonzero(mine == i).tolist():
                tree.add(x, ranks[x])
            for x in np.flatnonzero(mine == j).tolist():
                found += [(x, y) for y in tree.links(x, ranks[x])]
        return pa.Table.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], names=["a", "b"])

    return join


def _dealt(ordered: DataFrame, blocks: DataFrame, similarity: int, block: int, counted: bool = False) -> DataFrame:
    """a, b, and counted n_links (see _join_block; blocks then has `times`, the documents with each set): links within blocks (node, component). The sets of a block of several shards go to a group for each pair of shards.

    How many shards a large block has comes by a join on block and salt: dealt by block alone, all pairs
    of a block would stand in one partition, which the grouping by block and pair then takes as it is."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    large = blocks.groupBy(F.col("component").alias("block")).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block).withColumn("salt", salts)
    columns = ["_id", "n", "tokens", "many", *(["times"] if counted else [])]
    placed = ordered.select(*columns[:4]).join(blocks.withColumnsRenamed({"node": "_id", "component": "block"}), "_id")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("_id", F.lit("salt")), F.lit(SALTS)).cast("int")).join(large, ["block", "salt"], "left")
    placed = placed.withColumn("shards", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int"))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("_id"), F.col("shards")).cast("int"))
    # a shard meets every other once: pairs (i, j), i <= j
    pairs = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least("shard", o).alias("i"), F.greatest("shard", o).alias("j")))
    spread = placed.withColumn("p", F.explode(pairs)).select("block", "p.i", "p.j", "shard", *columns)
    return spread.groupBy("block", "i", "j").applyInArrow(_join_block(similarity, counted), "a long, b long" + (", n_links long" if counted else ""))


def _links(ordered: DataFrame, similarity: int, block: int, times: DataFrame | None) -> DataFrame:
    """a, b: links that join the groups of ordered sets; with times (set, times) also n_links, see _dealt."""
    tokens = ordered.select("_id", F.explode("rare").alias("token"))
    stars = tokens.groupBy("token").agg(F.min("_id").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    blocks = components(tokens.join(stars, "token").select("a", F.col("_id").alias("b")))
    if times is not None:
        blocks = blocks.join(times, F.col("node") == F.col("set")).drop("set")
    return _dealt(ordered, blocks, similarity, block, times is not None)


def join(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, block: int = BLOCK, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs; not counted: without n_links, for less work in large groups.

    n_links are the other documents whose set of shingles is equal to the row's or links with it; of a doc_id with several
    sets each counts. Null texts and texts without words have no shingles and link with nothing. Rows that share a doc_id are one
    document: they are in one component. A row without doc_id links with nothing, its component is null. Columns other than doc_id and
    text are not read. An empty table gives no rows."""
    d, n_parts = keyed(docs), buckets(docs)
    sizes = materialize(_shared(d, shingle, n_parts), "shingles")
    near = sizes.filter((F.col("n_shingles") > 0) & (100 * F.col("shared") >= similarity * F.col("n_shingles")) & (F.col("_id") != NULL_ID)).select("_id", "_sum").distinct()
    sets = materialize(_sets(d.join(near, ["_id", "_sum"]), shingle), "sets")
    # written, so that the join with it can be split where a set has very many copies
    least = materialize(sets.groupBy("k1", "k2").agg(F.min("_id").alias("rep"), *([F.count_distinct("_id").alias("times")] if counted else [])), "least-sets")
    members = materialize(sets.select("_id", "_sum", "k1", "k2").distinct().join(least, ["k1", "k2"]), "members")
    firsts = members.filter("_id = rep").drop("_sum", "rep").distinct()
    if counted:  # a document may be the first of several sets: each has a number
        firsts = materialize(firsts.withColumn("set", F.monotonically_increasing_id()), "firsts")
    reps = sets.join(firsts, ["_id", "k1", "k2"]).select(F.col("set" if counted else "_id").alias("_id"), "n", "keys")
    ordered = materialize(_ordered(reps.sortWithinPartitions("_id", "n", "keys"), similarity, n_parts), "ordered")
    links = _links(ordered, similarity, block, firsts.select("set", "times") if counted else None)
    if counted:
        links = materialize(links, "links-and-counts")
        number = links.filter("b is null").groupBy(F.col("a").alias("set")).agg(F.sum("n_links").alias("n"))
        number = firsts.join(number, "set", "left").select(F.col("_id").alias("rep"), "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
        number = members.join(materialize(number, "link-counts"), ["rep", "k1", "k2"]).select("_id", "_sum", "n_links")
        a, b = (firsts.select(F.col("set").alias(x), F.col("_id").alias(f"_{x}")) for x in "ab")
        links = links.filter("b is not null").join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    # equal sets, and rows of one id, hang on their first document
    alike = members.filter("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    groups = components(links.union(alike)).withColumnRenamed("node", "_id")
    out = sizes.join(groups, "_id", "left")
    columns = [own_id().alias("doc_id"), "n_shingles", F.when(F.col("_id") != NULL_ID, F.coalesce("component", "_id")).alias("component_id")]
    return out.join(number, ["_id", "_sum"], "left").select(*columns, F.coalesce("n_links", F.lit(0)).alias("n_links")) if counted else out.select(*columns)


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is the least of their component, and rows without doc_id; all columns as they are.

    Of rows that share that doc_id all stay."""
    first = join(docs, shingle, similarity, counted=False).filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(first, F.col("id") == F.col("first"), "left_semi").select("row.*").unionByName(docs.filter("doc_id is null"))
