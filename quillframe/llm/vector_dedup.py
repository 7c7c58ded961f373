"""Embedding near-duplicates: all pairs at a cosine, by dual traversal of cover trees.

1. Equal vectors become one. A bounded sample is put into a cover tree; the order of its leaves says which centres lie
   near each other. Each vector goes to its nearest centre, and runs of centres make blocks of some BLOCK vectors. The
   sample only places vectors: all of them are joined, whatever it is.
2. Each block's task builds its cover tree: nested centres at halving radii, a point in the child whose centre it is nearest to.
   A tree is written as its points in depth-first order with the highest level of each as a centre, so a node is a range of points.
3. Blocks meet in teams of neighbours, so a vector is copied once for each team. Pairs of blocks whose covering balls come within the distance are joined by walking both trees: a pair of nodes goes
   when its centres are farther apart than the distance and both covering radii, counts whole when all of it must lie within, and is opened otherwise. Counts are
   added by ranges, groups by joining neighbours, so no list of pairs is made.
4. Links make components.

Vectors without structure (no two nodes closer than their radii) leave nothing to prune: then each pair of centres is looked at, by matrix products
of their leading coordinates: these and the lengths of what is left out bound a cosine, and few pairs get to the bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialize
from quillframe.llm.components import components

COSINE = 0.9
#: Vectors of a block, about.
BLOCK = 4096
#: Centres of the sample that places vectors, at most, and bytes of it.
CENTRES, CENTRE_BYTES = 2048, 16 << 20
#: Radius from which on a node stays unopened: any two of its points are nearly one.
LEAST_RADIUS = 1 / 64
#: Products in single precision are off by less than this for each dimension; decisions within it are made in double precision.
SLACK = 1e-6
#: Rows of a matrix product.
ROWS = 512
#: Bytes of vectors, in double precision, that a team of blocks has at most.
TEAM_BYTES = 32 << 20
#: Levels whose nodes are less than so many times those of another are passed over.
FEW = 1.25
#: Links of points that are held before they are counted.
HELD = 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled so that no square is lost."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


@dataclass
class CoverTree:
    """points: unit vectors in depth-first order; top: the highest level at which each is a centre; level l covers radius 2 / 2**l.

    The node of a centre v at level l >= top[v] is the range of points from v to the next point of a level <= l. Trees one behind the other are one with several roots."""

    points: np.ndarray
    top: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The depth-first order of the points and the top level of each."""
        order, top = np.empty(len(points), np.int64), np.zeros(len(points), np.int16)
        at = 0
        # (members, the first is the centre; level at which they are one node; top level of the centre)
        stack = [(np.arange(len(points)), 0, 0)] if len(points) else []
        while stack:
            members, level, own = stack.pop()
            if len(members) == 1 or 2 / 2**level <= LEAST_RADIUS:
                order[at : at + len(members)] = members
                top[at], top[at + 1 : at + len(members)] = own, 99
                at += len(members)
                continue
            x = points[members]
            centres = CoverTree._centres(x, 2 / 2 ** (level + 1))
            nearest = np.concatenate([(x[i : i + ROWS] @ x[centres].T).argmax(axis=1) for i in range(0, len(x), ROWS)])
            nearest[centres] = np.arange(len(centres))  # nested: a centre is its own
            by = np.argsort(nearest, kind="stable")
            bounds = np.searchsorted(nearest[by], np.arange(len(centres) + 1))
            for k in range(len(centres) - 1, -1, -1):
                own_members = by[bounds[k] : bounds[k + 1]]
                own_members = np.concatenate([[centres[k]], own_members[own_members != centres[k]]])
                stack.append((members[own_members], level + 1, own if k == 0 else level + 1))
        return order, top

    @staticmethod
    def _centres(x: np.ndarray, radius: float) -> np.ndarray:
        """Points farther apart than the radius, the first point among them, so that each point has one within it."""
        least = 1 - radius * radius / 2
        centres = np.zeros(0, np.int64)
        for i in range(0, len(x), ROWS):
            part = x[i : i + ROWS]
            open_ = np.ones(len(part), bool)
            for k in range(0, len(centres), 4 * ROWS):
                open_ &= (part @ x[centres[k : k + 4 * ROWS]].T).max(axis=1) < least
            left = np.flatnonzero(open_)
            near = part[left] @ part[left].T >= least
            covered, fresh = np.zeros(len(left), bool), []
            for j in range(len(left)):
                if not covered[j]:
                    fresh.append(left[j])
                    covered |= near[j]
            centres = np.append(centres, i + np.array(fresh, np.int64))
        return centres

    def levels(self) -> int:
        known = self.top[self.top < 99]
        return int(known.max(initial=0)) + 1

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and covering radius of the nodes at a level. Points of unopened nodes stand in their centre's."""
        start = np.flatnonzero(self.top <= level)
        end = np.append(start[1:], len(self.top))
        which = np.repeat(np.arange(len(start)), end - start)
        cosine = np.einsum("ij,ij->i", self.points, self.points[start[which]])
        radius = apart(np.minimum.reduceat(cosine, start)) if len(start) else np.zeros(0)
        return start, end, np.where(end - start == 1, 0.0, radius + 1e-7)


class _Labels:
    """Groups of numbers, joined many pairs at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


class DualJoin:
    """Pairs at a cosine between two cover trees, or in one: how many each point has, by weight, and the groups they make. Points of the second tree are numbered behind the first's."""

    def __init__(self, a: CoverTree, b: CoverTree | None, weight: np.ndarray, cosine: float):
        self.trees = (a, b or a)
        self.same, self.cosine, self.reach = b is None, cosine, float(apart(np.float64(cosine)))
        self.points = a.points if b is None else np.concatenate([a.points, b.points])
        self.single = self.points.astype(np.float32)
        self.slack = SLACK * self.points.shape[1] + 1e-5
        self.blur = float(np.sqrt(2 * self.slack)) + 1e-6  # by how much a distance from such a cosine can be off
        self.offset = 0 if b is None else len(a.points)
        self.weight = weight
        self.total = np.concatenate([[0], np.cumsum(weight)])
        self.step = max(64, (16 << 20) // (8 * self.points.shape[1]))  # vectors that are looked up at a time
        self.low = self._leading()
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.points)
        self.count, self.range = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        self.glue = np.zeros(n + 1, np.int64)
        self.labels = _Labels(n)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Links and group of each point."""
        a, b = self.trees
        depth = max(a.levels(), b.levels())
        if not len(a.points) or not len(b.points):
            return self.count, self.labels.of
        tables = [[t.nodes(level) for level in range(depth)] for t in self.trees]
        # node numbers at a level, and the cosine of their centres in single precision; first of all roots
        roots = self.single[tables[0][0][0]] @ self.single[tables[1][0][0] + self.offset].T
        x, y = np.nonzero(np.triu(np.ones(roots.shape, bool)) if self.same else np.ones(roots.shape, bool))
        pairs = (x, y, roots[x, y])
        nodes = [len(a[0]) + len(b[0]) for a, b in zip(*tables, strict=True)]
        level = 0
        while True:
            (sa, ea, ra), (sb, eb, rb) = tables[0][level], tables[1][level]
            pairs = self._settle(*pairs, sa, ea, ra, sb + self.offset, eb + self.offset, rb, level == depth - 1)
            if not len(pairs[0]) or level == depth - 1:
                break
            # a level that opens few nodes only leaves wide ones to meet all others: it is passed over
            above, level = level, max(k for k in range(level + 1, depth) if nodes[k] <= FEW * nodes[level + 1])
            pairs = self._open(*pairs, tables[0][above], tables[0][level], tables[1][above], tables[1][level])
            self._count_held()
        self.count += np.cumsum(self.range)[:-1]
        linked = np.flatnonzero(np.cumsum(self.glue)[:-1] > 0)
        self.labels.join(linked, linked + 1)
        return self.count, self.labels.of

    def _leading(self) -> np.ndarray:
        """Of each point its coordinates on the leading axes of some points, and the length of what these leave out: the product of two such rows is no less than the cosine.

        So many axes that what is left out bounds pairs below the cosine, as far as the points are alike; the axes decide nothing else."""
        some = self.points[:: -(-len(self.points) // 2048)]
        energy, axes = np.linalg.eigh(some.T @ some / max(1, len(some)))
        left = 1 - np.cumsum(energy[::-1])
        k = min(len(left), int(np.count_nonzero(left > 0.63 * self.cosine)) + 1)
        out = np.empty((len(self.points), k + 1), np.float32)
        for at in range(0, len(out), self.step):
            low = self.points[at : at + self.step] @ axes[:, ::-1][:, :k]
            out[at : at + self.step, :k] = low
            out[at : at + self.step, k] = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", low, low)))
        return out

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether points link, in double precision."""
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), self.step):
            out[k : k + self.step] = np.einsum("ij,ij->i", self.points[i[k : k + self.step]], self.points[j[k : k + self.step]]) >= self.cosine
        return out

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        self.labels.join(i, j)

    def _hold(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.held.append((i, j))
            if sum(len(a) for a, _ in self.held) > HELD:
                self._count_held()

    def _count_held(self) -> None:
        if self.held:
            self._link(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held = []

    def _settle(self, x, y, cosine, sa, ea, ra, sb, eb, rb, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of nodes the ones that must be opened; all others are decided."""
        i, j = sa[x], sb[y]
        own = self.same & (i == j)
        points = (ea[x] - i == 1) & (eb[y] - j == 1)
        at = np.flatnonzero(points & ~own & (cosine >= self.cosine - self.slack))
        at = at[self._exact(i[at], j[at])]
        self._link(i[at], j[at])
        at = np.flatnonzero(~points)
        d, r = apart(cosine[at]), ra[x[at]] + rb[y[at]]
        whole = d + r <= self.reach - self.blur
        self._whole(i[at[whole]], ea[x[at[whole]]], j[at[whole]], eb[y[at[whole]]], own[at[whole]])
        rest = at[~whole & (d <= self.reach + r + self.blur)]
        if last:  # nodes that stay unopened, on the edge: their points one by one
            for k in rest:
                self._points(int(i[k]), int(ea[x[k]]), int(j[k]), int(eb[y[k]]))
        return x[rest], y[rest]

    def _whole(self, i, ei, j, ej, own) -> None:
        """All points of two nodes link."""
        for a, ea, b, eb in ((i, ei, j, ej), (j[~own], ej[~own], i[~own], ei[~own])):
            w = self.total[eb] - self.total[b]
            np.add.at(self.range, a, w)
            np.add.at(self.range, ea, -w)
            np.add.at(self.glue, a, 1)
            np.add.at(self.glue, ea - 1, -1)
        # in one node each point was counted with itself
        for a, ea in zip(i[own], ei[own], strict=True):
            self.count[a:ea] -= self.weight[a:ea]
        self.labels.join(i, j)

    def _points(self, i: int, ei: int, j: int, ej: int) -> None:
        for k in range(i, ei, ROWS):
            rows, columns = np.arange(k, min(k + ROWS, ei)), np.arange(j, ej)
            found = self.points[rows] @ self.points[columns].T >= self.cosine - 1e-9
            if self.same and i == j:
                found &= rows[:, None] < columns
            x, y = np.nonzero(found)
            x, y = rows[x], columns[y]
            ok = self._exact(x, y)
            self._link(x[ok], y[ok])

    def _open(self, x, y, above_a, below_a, above_b, below_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the nodes' children whose balls come near enough, with their cosines. Large products go by matrices; pairs of points in them are decided at once."""
        first = [np.searchsorted(below[0], above[0]) for above, below in ((above_a, below_a), (above_b, below_b))]
        after = [np.append(f[1:], len(below[0])) for f, below in zip(first, (below_a, below_b), strict=True)]
        na, nb = after[0][x] - first[0][x], after[1][y] - first[1][y]
        small = na * nb <= 4096
        out = []
        at = np.flatnonzero(small)
        for part in np.array_split(at, int((na[at] * nb[at]).sum()) // self.step + 1):  # one at least, so there is a result
            size = na[part] * nb[part]
            which = np.repeat(np.arange(len(part)), size)
            step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            a, b = first[0][x[part]][which] + step // nb[part][which], first[1][y[part]][which] + step % nb[part][which]
            if self.same:  # a node's children meet each other once
                once = (x[part] != y[part])[which] | (a <= b)
                a, b = a[once], b[once]
            cosine = np.einsum("ij,ij->i", self.single[below_a[0][a]], self.single[below_b[0][b] + self.offset])
            near = cosine >= self._bound(below_a[2][a] + below_b[2][b])
            out.append((a[near], b[near], cosine[near]))
        for k in np.flatnonzero(~small):
            out += self._product(first[0][x[k]], after[0][x[k]], first[1][y[k]], after[1][y[k]], below_a, below_b, self.same and x[k] == y[k])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _bound(self, radii: np.ndarray) -> np.ndarray:
        """The cosine under which balls of these radii (summed) hold no link."""
        return 1 - np.minimum(self.reach + radii, 2.0) ** 2 / 2 - self.slack

    def _product(self, a: int, ea: int, b: int, eb: int, below_a, below_b, own: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        left, right = np.arange(a, ea), np.arange(b, eb)
        out = []
        # points, whose radius is 0, by one bound; the others by theirs
        for one_a in (True, False):
            rows = left[(below_a[2][left] == 0) == one_a]
            for one_b in (True, False):
                columns = right[(below_b[2][right] == 0) == one_b]
                if not len(columns):
                    continue
                if one_a and one_b:
                    for k in range(0, len(rows), ROWS):
                        self._hold(*self._near_points(below_a[0][rows[k : k + ROWS]], below_b[0][columns] + self.offset, own))
                    continue
                c = self.single[below_b[0][columns] + self.offset]
                for k in range(0, len(rows), ROWS):
                    r = rows[k : k + ROWS]
                    cosine = self.single[below_a[0][r]] @ c.T
                    at = np.flatnonzero(cosine >= self._bound(below_a[2][r][:, None].astype(np.float32) + below_b[2][columns].astype(np.float32)))
                    near = cosine.ravel()[at]
                    i, j = r[at // len(columns)], columns[at % len(columns)]
                    if own:
                        once = i <= j
                        i, j, near = i[once], j[once], near[once]
                    out.append((i, j, near))
        return out

    def _near_points(self, i: np.ndarray, j: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those of two lists of points that link; in one list each pair once."""
        least = self.cosine - self.slack
        at = np.flatnonzero(self.low[i] @ self.low[j].T >= least)
        if len(at) * 16 > len(i) * len(j):  # then a product of all is less work
            cosine = (self.single[i] @ self.single[j].T).ravel()[at]
            near = cosine >= least
            at, cosine = at[near], cosine[near]
            a, b = i[at // len(j)], j[at % len(j)]
        else:
            a, b = i[at // len(j)], j[at % len(j)]
            cosine = np.concatenate([np.zeros(0, np.float32)] + [np.einsum("ij,ij->i", self.single[a[k : k + self.step]], self.single[b[k : k + self.step]]) for k in range(0, len(a), self.step)])
        near = (cosine >= least) & ((a < b) if own else (a != b))
        a, b, cosine = a[near], b[near], cosine[near]
        edge = np.flatnonzero(cosine < self.cosine + self.slack)
        sure = np.ones(len(a), bool)
        sure[edge] = self._exact(a[edge], b[edge])
        return a[sure], b[sure]


def _matrix(blobs: pa.Array | pa.ChunkedArray | list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length as rows in double precision; their bytes are of single or double precision, as their column was."""
    some = blobs if isinstance(blobs, list) else blobs.to_pylist()
    flat = b"".join(some)
    return np.frombuffer(flat, np.float32 if len(flat) == 4 * dim * len(some) else np.float64).reshape(len(some), dim).astype(np.float64)


def parsed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, digest, vector of each row; dim is null where the vector can link with nothing (null, empty, zero, or with a component that is null or not finite), or has no vec_id.

    A vector's bytes are of single precision if its column is, else of double."""
    kind = "float" if vectors.select("embedding").schema[0].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, ids = b.column("x"), b.column("vec_id")
            flat = column.flatten()
            null, values = flat.is_null().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            n = np.array([0 if k is None else k for k in column.value_lengths().to_pylist()], np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = (np.diff(bad[first]) == 0) & (np.diff(some[first]) > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            blobs = [values[first[i] : first[i + 1]].tobytes() if g else None for i, g in enumerate(good)]
            digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in blobs]
            yield pa.RecordBatch.from_arrays([ids, pa.array([int(k) if g else None for k, g in zip(n, good, strict=True)], pa.int32()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["vec_id", "dim", "digest", "vector"])

    return v.mapInArrow(run, "vec_id long, dim int, digest binary, vector binary")


def _routes(sets: DataFrame, centres: int) -> dict[int, np.ndarray]:
    """For each length of vectors, unit vectors of a bounded sample in the order of their cover tree's leaves."""
    widest = sets.agg(F.max("dim")).first()[0] or 1
    sample = sets.orderBy(F.xxhash64("digest"), "set").select("dim", "vector").limit(max(1, min(centres, CENTRE_BYTES // (8 * widest)))).collect()
    by: dict[int, list[bytes]] = {}
    for r in sample:
        by.setdefault(r.dim, []).append(bytes(r.vector))
    out = {}
    for dim, some in by.items():
        x = unit(_matrix(some, dim))
        out[dim] = x[CoverTree.build(x)[0]]
    return out


def _placed(sets: DataFrame, centres: int) -> DataFrame:
    """sets with `cell`, the nearest centre; 0 where no vector of that length was in the sample."""
    routes = _routes(sets, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims):
                if (c := routes.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    x = unit(_matrix(b.column("vector").take(pa.array(at)), int(dim)))
                    cell[at] = np.concatenate([(x[k : k + ROWS] @ c.T).argmax(axis=1) for k in range(0, len(x), ROWS)])
            yield b.append_column("cell", pa.array(cell))

    return sets.select("set", "rep", "times", "dim", "vector").mapInArrow(run, "set long, rep long, times long, dim int, vector binary, cell int")


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """dim, cell, block, shards: neighbouring small cells share a block, a large cell is dealt over several. A row for each cell, of which there are no more than centres and lengths."""
    rows, at, held = [], -1, {}
    for r in placed.groupBy("dim", "cell").count().orderBy("dim", "cell").collect():
        shards = -(-r["count"] // block)
        if shards > 1 or held.get(r.dim, block + 1) + r["count"] > block:
            at += 1
            held = {r.dim: r["count"] if shards == 1 else block}
            rows.append((r.dim, r.cell, at, shards))
            at += shards - 1
        else:
            held[r.dim] += r["count"]
            rows.append((r.dim, r.cell, at, 1))
    return placed.sparkSession.createDataFrame(rows, "dim int, cell int, block int, shards int")


def _trees(placed: DataFrame, block: int) -> DataFrame:
    """dim, block, set, rep, times, pos, top, reach, vector: each block's cover tree; reach is its radius around its first point."""
    where = _blocks(placed, block)
    dealt = placed.join(F.broadcast(where), ["dim", "cell"]).withColumn("block", F.col("block") + F.pmod(F.xxhash64("set"), F.col("shards")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("set")
        x = unit(_matrix(t.column("vector"), t.column("dim")[0].as_py()))
        order, top = CoverTree.build(x)
        t, x = t.take(pa.array(order)), x[order]
        n = len(x)
        reach = float(apart((x @ x[0]).min())) + 1e-7
        return pa.table([t.column("dim"), t.column("block"), t.column("set"), t.column("rep"), t.column("times"), pa.array(np.arange(n, dtype=np.int32)), pa.array(top.astype(np.int32)), pa.array(np.full(n, reach)), t.column("vector")], names=["dim", "block", "set", "rep", "times", "pos", "top", "reach", "vector"])

    columns = "dim int, block int, set long, rep long, times long, pos int, top int, reach double, vector binary"
    return dealt.select("dim", "block", "set", "rep", "times", "vector").groupBy("dim", "block").applyInArrow(build, columns)


def _pairs(trees: DataFrame, cosine: float) -> DataFrame:
    """dim, i, j (i <= j): blocks of vectors of one length whose covering balls come near enough."""
    reach = float(apart(np.float64(cosine)))
    balls = materialize(trees.filter("pos = 0").select("dim", "block", "reach", "vector"), "vector-balls")
    last = balls.groupBy("dim").agg(F.max("block").alias("last"))
    left = balls.join(last, "dim").withColumn("j", F.explode(F.sequence("block", "last"))).select("dim", F.col("block").alias("i"), "j", F.col("reach").alias("ri"), F.col("vector").alias("vi"))
    right = balls.select("dim", F.col("block").alias("j"), F.col("reach").alias("rj"), F.col("vector").alias("vj"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                c = b.filter(pa.array(dims == dim))
                vi, vj = (unit(_matrix(c.column(v), int(dim))) for v in ("vi", "vj"))
                ok = apart(np.einsum("ij,ij->i", vi, vj)) <= reach + c.column("ri").to_numpy() + c.column("rj").to_numpy() + 1e-7
                yield c.filter(pa.array(ok)).select(["dim", "i", "j"])

    return left.join(right, ["dim", "j"]).select("dim", "i", "j", "ri", "rj", "vi", "vj").mapInArrow(near, "dim int, i int, j int")


def _tiles(trees: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """The rows of trees, dealt out to pairs of teams i, j (i <= j) of neighbouring blocks, each block to the pairs where it comes near another.

    Teams are as large as leaves four pairs of them for each core, and as TEAM_BYTES allows: what moves grows with their number."""
    widest, blocks = pairs.agg(F.max("dim"), F.count_if(F.col("i") == F.col("j"))).first()
    teams = math.ceil(math.sqrt(8 * trees.sparkSession.sparkContext.defaultParallelism))
    size = max(1, min(-(-blocks // teams), TEAM_BYTES // (8 * block * (widest or 1))))
    team = lambda c: F.floor(F.col(c) / size).cast("int")
    ends = pairs.select("dim", team("i").alias("i"), team("j").alias("j"), F.explode(F.array("i", "j")).alias("block")).distinct()
    return trees.select("dim", "block", team("block").alias("team"), "set", "rep", "times", "pos", "top", "vector").join(ends, ["dim", "block"])


def _join(cosine: float):
    def join(t: pa.Table) -> pa.Table:
        """(set, null, links) and (rep, rep of the group, null) of the points of two teams of blocks."""
        t = t.sort_by([("block", "ascending"), ("pos", "ascending")])
        x, top = unit(_matrix(t.column("vector"), t.column("dim")[0].as_py())), t.column("top").to_numpy()
        cut = int(np.count_nonzero(t.column("team").to_numpy() == t.column("i")[0].as_py()))
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        weight, rep, ids = (t.column(c).to_numpy() for c in ("times", "rep", "set"))
        trees = (CoverTree(x, top), None) if one else (CoverTree(x[:cut], top[:cut]), CoverTree(x[cut:], top[cut:]))
        count, group = DualJoin(*trees, weight, cosine).run()
        some, linked = np.flatnonzero(count), np.flatnonzero(group != np.arange(len(group)))
        n, m = len(some), len(linked)
        a = np.concatenate([ids[some], rep[linked]])
        b = pa.array(np.concatenate([np.zeros(n, np.int64), rep[group[linked]]]), mask=np.arange(n + m) < n)
        links = pa.array(np.concatenate([count[some], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)
        return pa.table([pa.array(a, pa.int64()), b, links], names=["a", "b", "links"])

    return join


def join(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding; others are not read).

    n_links are the other vectors at the cosine; rows that repeat a vec_id and a vector are one, and of a vec_id with several vectors each
    counts. component_id is the least vec_id that links reach; rows of one vec_id are in one component. kept: vec_id is component_id. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and those of different lengths not with each other. A row without vec_id links with nothing; its component is null, and it is kept. An empty
    table gives no rows. cosine is over 0."""
    rows = materialize(parsed(vectors), "vectors")
    each = rows.filter("dim is not null").groupBy("digest", "vec_id").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    sets = each.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    sets = materialize(sets.withColumn("set", F.monotonically_increasing_id()), "vector-sets")
    placed = materialize(_placed(sets, centres), "vectors-placed")
    trees = materialize(_trees(placed, block), "vector-trees")
    pairs = materialize(_pairs(trees, cosine), "vector-pairs")
    found = materialize(_tiles(trees, pairs, block).groupBy("dim", "i", "j").applyInArrow(_join(cosine), "a long, b long, links long"), "vector-links")
    number = found.filter("links is not null").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    number = materialize(sets.select("set", "digest", "times", "rep").join(number, "set", "left").select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "vector-counts")
    counted = materialize(rows.select("vec_id", "digest").join(number, "digest", "left").select("vec_id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links")), "vectors-counted")
    alike = counted.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    groups = components(found.filter("b is not null").select("a", "b").union(alike)).withColumnRenamed("node", "vec_id")
    out = counted.join(groups, "vec_id", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
