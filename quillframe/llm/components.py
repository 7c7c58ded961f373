"""Connected components of a table of links: each task makes stars of its own links, alternating stars join what several tasks have."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialize

#: Links that one task makes stars of at a time.
LINKS = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node that these links reach from it) of each node of links a, b."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(node))
    while True:
        x, y = least[x], least[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        if not len(x):
            return node, node[least]
        np.minimum.at(least, y, x)
        while not np.array_equal(further := least[least], least):
            least = further


def _own_stars(links: DataFrame, size: int, roots: bool = False) -> DataFrame:
    """a, b: the links of each task as stars (b the least), some `size` at a time; roots: and each b with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def told(node: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            kept = np.ones(len(node), bool) if roots else node != least
            return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(least[kept])], names=["a", "b"])

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            if sum(map(len, a)) >= size:
                node, least = stars(np.concatenate(a), np.concatenate(b))
                if 2 * len(node) > size and not roots:
                    yield told(node, least)
                    node = least = node[:0]
                a, b = [node], [least]
        yield told(*stars(np.concatenate(a), np.concatenate(b)))

    return links.select("a", "b").filter("a is not null and b is not null").mapInArrow(run, "a long, b long")


def _least(edges: DataFrame) -> DataFrame:
    """Written, so that a join with it has plain exchanges on both sides, which Spark splits where a node has very many links."""
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _clean(both.filter("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    return _clean(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, size: int = LINKS) -> DataFrame:
    """node, component (the least node that can be reached) of each node in links (a, b: long). Self-links and repeats do no harm.

    Tasks make stars of some `size` links each, without an exchange, as often as that halves them; what one task then holds is done.
    Of more, minima are pre-aggregated before they are moved and joined back, so a hub is not gathered anywhere;
    rounds grow with the logarithm of a component's diameter. Each round is written to the shared folder."""
    edges = materialize(_own_stars(links, size), "links")
    n = edges.count()
    while n > size:
        fewer = materialize(_own_stars(edges.coalesce(math.ceil(n / size)), size), "links")
        edges, was, n = fewer, n, fewer.count()
        if 2 * n > was:
            break
    if n <= size:
        return materialize(_own_stars(edges.coalesce(1), size, roots=True), "components").select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
        edges = materialize(_small_star(_large_star(edges)), "stars")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
