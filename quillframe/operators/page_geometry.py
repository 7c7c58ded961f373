"""The slope of pages from their ink, as counts over rows of pixels: votes for lines, row profiles, and the smallest box.

A page is a key's rows (key, y, x). Pages are dealt out by key, and the pixels of some pages are turned together, one angle after the other: what a task hands on
is the lines and angles it found, never a row for each pixel and angle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Angles of lines that count (degrees), votes of a line, how many lines make a median; range and step of the profile's sweep and the least angle it tells;
#: the largest angle that the smallest box tells; and how much ink a page must have.
LINES, VOTES, PEAKS = 25, 70, 6
SWEEP, STEP, LEAST = 10.0, 0.5, 0.2
BOX, INK = 30.0, 100


def angles(first: float, last: float, step: float) -> list[tuple[float, float, float]]:
    """angle, cosine and sine from first up to and without last."""
    return [(a, math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (first + k * step for k in range(round((last - first) / step)))]


#: Pixels of whole pages that are turned together, about: memory follows this, and the page that has most.
PIXELS = 500_000


def _pages(pixels: DataFrame, key: str, run: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """run(keys, first, y, x) for whole pages at a time: the page k has the key keys[k] and the pixels first[k] .. first[k + 1] - 1."""

    def some(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """What run() makes of the held pages, without the last one if that may go on, and what is still held."""
        t = pa.Table.from_batches(held).combine_chunks()
        number = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(number))
        if not last:
            first = first[:-1]
        n = int(first[-1])
        if n == 0:
            return None, [t.to_batches()[0]]
        y, x = (t.column(i).combine_chunks().to_numpy()[:n].astype(np.int64) for i in (1, 2))
        return run(t.column(0).combine_chunks().take(pa.array(first[:-1])), first, y, x), t.slice(n).combine_chunks().to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, PIXELS
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= enough:
                out, held = some(held, False)
                n = sum(h.num_rows for h in held)
                enough = max(PIXELS, 2 * n)  # a page of more pixels than that is not gone over for each batch
                if out is not None:
                    yield out
        if n:
            yield some(held, True)[0]

    return pixels.select(key, "y", "x").repartition(key).sortWithinPartitions(key).mapInArrow(each, schema)


def _cells(first: np.ndarray, y: np.ndarray, x: np.ndarray, c: float, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """page, row, n: how many pixels of each page are in each row when the page is turned back by the angle."""
    row = np.floor(y * c - x * s + 0.5).astype(np.int64)
    low, n = np.minimum.reduceat(row, first[:-1]), np.diff(first)
    start = np.append(0, np.cumsum(np.maximum.reduceat(row, first[:-1]) - low + 1))
    cell = row + np.repeat(start[:-1] - low, n)
    if start[-1] <= 8 * len(cell):
        n = np.bincount(cell, minlength=int(start[-1]))
        cell = np.flatnonzero(n)
        n = n[cell]
    else:  # pages with little ink for their size
        cell, n = np.unique(cell, return_counts=True)
    which = np.searchsorted(start, cell, "right") - 1
    return which, cell - (start[:-1] - low)[which], n


def _page_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pixels(images: DataFrame, key: str, found: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, y, x of the pixels that found() marks in each image (key, h, w, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (h, w, data) in enumerate(zip(b.column("h").to_pylist(), b.column("w").to_pylist(), b.column("data").to_pylist(), strict=True)):
                y, x = np.nonzero(found(np.frombuffer(data, np.uint8).reshape(h, w)))
                own = b.column(key).take(pa.array(np.full(len(y), i)))
                yield pa.RecordBatch.from_arrays([own, pa.array(y, pa.int32()), pa.array(x, pa.int32())], [key, "y", "x"])

    return images.select(key, "h", "w", "data").mapInArrow(run, f"{key} {dict(images.dtypes)[key]}, y int, x int")


def edges(gray: np.ndarray, least: float = 150.0) -> np.ndarray:
    """Pixels whose gradient (weighted differences of three neighbours) is that steep."""
    g = np.pad(gray.astype(float), 1, mode="edge")
    across = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    down = g[:-2] + 2 * g[1:-1] + g[2:]
    return np.abs(across[2:] - across[:-2]) + np.abs(down[:, 2:] - down[:, :-2]) >= least


def _peaks(page: np.ndarray, a: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which cells of page, angle (a number from 0) and row none of the eight cells around has more than, or as many and comes first."""
    most = np.ones(len(n), bool)
    if len(n) == 0:
        return most
    row, angles_ = row - row.min() + 1, int(a.max()) + 3
    span = int(row.max()) + 2
    place = (page * angles_ + a + 1) * span + row
    order = np.argsort(place)
    known = place[order]
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                at = np.minimum(np.searchsorted(known, place + i * span + j), len(known) - 1)
                other = np.where(known[at] == place + i * span + j, n[order[at]], -1)
                most &= (other < n) | ((other == n) & ((i, j) > (0, 0)))
    return most


def _found(first: np.ndarray, y: np.ndarray, x: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """page, angle, offset, n of the lines of each page, page by page and by angle."""
    some, found = angles(-LINES + 1, LINES, 1), []
    for k, (_, c, s) in enumerate(some):
        which, row, n = _cells(first, y, x, c, s)
        full = n >= votes
        found.append((which[full], np.full(int(full.sum()), k), row[full], n[full]))
    which, a, row, n = (np.concatenate(f) for f in zip(*found, strict=True))
    best = np.flatnonzero(_peaks(which, a, row, n))
    best = best[np.argsort(which[best], kind="stable")]
    return which[best], np.array([t[0] for t in some], float)[a[best]], row[best], n[best]


def line_angles(edge_pixels: DataFrame, key: str, votes: int = VOTES) -> DataFrame:
    """key, angle, offset, n of the straight lines near level of each page: cells of angle and offset with so many pixels, none of whose eight neighbours has more (or as many, and comes first)."""

    def run(keys: pa.Array, first: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        which, *found = _found(first, y, x, votes)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(which)), *map(pa.array, found)], [key, "angle", "offset", "n"])

    return _pages(edge_pixels, key, run, f"{key} {dict(edge_pixels.dtypes)[key]}, angle double, offset long, n long")


def _median_lines(keys: pa.Array, first: np.ndarray, y: np.ndarray, x: np.ndarray, votes: int) -> pa.Array:
    """The median angle of each page's lines, null if there are fewer than PEAKS. Lines come by angle."""
    which, angle, _, _ = _found(first, y, x, votes)
    start = np.searchsorted(which, np.arange(len(keys) + 1))
    n = np.diff(start)
    none = n < PEAKS
    angle = np.append(angle, 0.0)
    lo, hi = (np.where(none, 0, start[:-1] + np.maximum(k, 0) // 2) for k in (n - 1, n))
    return pa.array((angle[lo] + angle[hi]) / 2, mask=none)


def _line_medians(edge_pixels: DataFrame, key: str, votes: int) -> DataFrame:
    """key, lines of each page with edges."""
    run = lambda keys, first, y, x: pa.RecordBatch.from_arrays([keys, _median_lines(keys, first, y, x, votes)], [key, "lines"])
    return _pages(edge_pixels, key, run, f"{key} {dict(edge_pixels.dtypes)[key]}, lines double")


def _ends(page: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the pixels that are first or last both of their row and of their column: one of them has the least, and one the most, of y and x in any direction."""

    def outer(line: np.ndarray, along: np.ndarray) -> np.ndarray:
        order = np.lexsort((along, line, page))
        edge = np.flatnonzero((np.diff(page[order], prepend=-1) != 0) | (np.diff(line[order], prepend=line[order[:1]] - 1) != 0))
        at = np.zeros(len(page), bool)
        at[order[edge]] = at[order[np.append(edge[1:], len(page)) - 1]] = True
        return at

    return np.flatnonzero(outer(y, x) & outer(x, y))


def _spreads(ink: DataFrame, key: str, votes: int | None = None) -> DataFrame:
    """key, ink (pixels), profile (the angle whose rows of ink vary most, the smaller of equals), box (angles whose box is the smallest but for what rounding may change, with its size),
    and lines, where the ink is the edges too and votes are told."""
    sweep, turned = angles(-SWEEP, SWEEP, STEP), angles(-45, 45, STEP)

    def run(keys: pa.Array, first: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        page, pages, whole = _page_of(first), len(first) - 1, (y, x)
        total, h = np.diff(first), (np.maximum.reduceat(y, first[:-1]) + 1).astype(float)
        best, profile = np.full(pages, -np.inf), np.zeros(pages)
        for a, c, s in sorted(sweep, key=lambda t: (abs(t[0]), t[0])):  # the first of equals stays
            which, _, n = _cells(first, y, x, c, s)
            spread = np.bincount(which, n * n, pages) / h - total / h * (total / h)
            better = spread > best
            best[better], profile[better] = spread[better], a
        at = _ends(page, y, x)
        y, x, start = y[at], x[at], np.searchsorted(page[at], np.arange(pages))
        size = np.empty((pages, len(turned)))
        for k, (_, c, s) in enumerate(turned):
            u, v = x * c + y * s, y * c - x * s
            size[:, k] = (np.maximum.reduceat(u, start) - np.minimum.reduceat(u, start)) * (np.maximum.reduceat(v, start) - np.minimum.reduceat(v, start))
        which, k = np.nonzero(size <= size.min(axis=1)[:, None] + 1e-5)
        few = pa.StructArray.from_arrays([pa.array(np.array([t[0] for t in turned])[k]), pa.array(size[which, k])], ["a", "size"])
        box = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(pages + 1)), pa.int32()), few)
        lines = pa.nulls(pages, pa.float64()) if votes is None else _median_lines(keys, first, *whole, votes)
        return pa.RecordBatch.from_arrays([keys, pa.array(total), pa.array(profile), box, lines], [key, "ink", "profile", "box", "lines"])

    return _pages(ink, key, run, f"{key} {dict(ink.dtypes)[key]}, ink long, profile double, box array<struct<a:double,size:double>>, lines double")


def _box(few: Column) -> Column:
    """The angle of the smallest box, sizes rounded; the one nearest to level of equals; 0 beyond BOX degrees."""
    least = F.array_min(F.transform(few, lambda t: F.struct(F.round(t["size"], 6).alias("size"), F.abs(t["a"]).alias("off"), t["a"].alias("a"))))
    return F.when(least["off"] > BOX, 0.0).otherwise(least["a"])


def profile_angles(ink: DataFrame, key: str) -> DataFrame:
    """key, angle: the one whose rows of ink vary most, the smaller of equals; over as many rows as the page has."""
    return _spreads(ink, key).select(key, F.col("profile").alias("angle"))


def box_angles(ink: DataFrame, key: str) -> DataFrame:
    """key, angle: the slope of the smallest box around a page's ink, from the ends of its rows; 0 beyond BOX degrees."""
    return _spreads(ink, key).select(key, _box(F.col("box")).alias("angle"))


def skew(ink: DataFrame, edge_pixels: DataFrame, key: str, votes: int = VOTES, least_ink: int = INK) -> DataFrame:
    """key, angle, by: the median of a page's lines if there are PEAKS and more; else the profile's angle from LEAST on; else that of the smallest box; 0 for a page with too little ink.

    A page without ink and edges has no row."""
    same = edge_pixels is ink
    d = _spreads(ink, key, votes if same else None)
    d = d.select(key, F.col("ink").alias("_ink"), F.col("profile").alias("_profile"), _box(F.col("box")).alias("_box"), F.col("lines").alias("_lines"))
    if not same:
        d = d.drop("_lines").join(_line_medians(edge_pixels, key, votes).withColumnRenamed("lines", "_lines"), key, "full")
    inked = F.coalesce("_ink", F.lit(0)) >= least_ink
    by = F.when(F.col("_lines").isNotNull(), "lines").when(~inked, "nothing").when(F.abs("_profile") >= LEAST, "profile").otherwise("box")
    d = d.withColumn("by", by)
    return d.select(key, F.when(F.col("by") == "lines", F.col("_lines")).when(F.col("by") == "nothing", 0.0).when(F.col("by") == "profile", F.col("_profile")).otherwise(F.col("_box")).alias("angle"), "by")
