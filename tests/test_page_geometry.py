"""The slope of pages against the same rules in numpy."""

import math

import numpy as np
import pytest

from quillframe.operators import page_geometry as G


def frame(spark, pages):
    return spark.createDataFrame([(k, int(y), int(x)) for k, p in pages.items() for y, x in p], "page int, y int, x int").repartition(5)


def ruled(angle, lines=9, width=300, gap=30):
    """Points of lines that slope by an angle."""
    out = set()
    for k in range(lines):
        for x in range(width):
            out.add((round(60 + k * gap + x * math.tan(math.radians(angle))), x))
    return sorted(out)


def row(y, x, a):
    return np.floor(y * math.cos(math.radians(a)) - x * math.sin(math.radians(a)) + 0.5).astype(int)


def profile(points):
    y, x = np.array(points).T
    h = y.max() + 1
    best = None
    for k in range(40):
        a = -10 + 0.5 * k
        n = np.unique(row(y, x, a), return_counts=True)[1]
        spread = (n.astype(float) ** 2).sum() / h - (n.sum() / h) ** 2
        if best is None or (spread, -abs(a), -a) > best:
            best = (spread, -abs(a), -a)
    return -best[2]


def test_lines_give_the_median(spark):
    pages = {1: ruled(3.0), 2: ruled(-7.0), 3: ruled(2.0, lines=3), 4: []}
    got = {r.page: (r.angle, r.by) for r in G.skew(frame(spark, pages), frame(spark, pages), "page").collect()}
    assert got[1][1] == got[2][1] == "lines" and got[1][0] == pytest.approx(3, abs=0.6) and got[2][0] == pytest.approx(-7, abs=0.6)
    assert got[3] == (2.0, "profile") and 4 not in got


def test_profiles_and_boxes(spark):
    rng = np.random.default_rng(3)
    pages = {k: sorted({(int(y), int(x)) for y, x in zip(rng.integers(0, 60, 300), rng.integers(0, 200, 300))}) for k in range(4)}
    pages |= {k: [(round(20 + 15 * i + x * math.tan(math.radians(k - 12))), int(x)) for i in range(5) for x in range(0, 150, 3)] for k in (10, 14, 17)}
    got = {r.page: r.angle for r in G.profile_angles(frame(spark, pages), "page").collect()}
    assert got == {k: profile(p) for k, p in pages.items()}
    slab = [(round(y + x * math.tan(math.radians(12))), x) for x in range(0, 300, 2) for y in (0, 10, 20)]
    few = [(y, 5) for y in range(40)]
    empty = frame(spark, {9: few})
    boxes = {r.page: r.angle for r in G.box_angles(frame(spark, {1: slab, 2: [(y, x) for y in range(20) for x in range(60)]}), "page").collect()}
    assert boxes[1] == pytest.approx(12, abs=0.6) and boxes[2] == 0
    assert [(r.page, r.angle, r.by) for r in G.skew(empty, empty, "page").collect()] == [(9, 0.0, "nothing")]


def test_pixels_and_edges(spark):
    g = np.full((20, 30), 255, np.uint8)
    g[8:12, 5:25] = 0
    images = spark.createDataFrame([(1, 20, 30, g.tobytes()), (2, 1, 1, b"\xff")], "page int, h int, w int, data binary")
    ink = G.pixels(images, "page", lambda x: x < 128)
    assert {(r.page, r.y, r.x) for r in ink.collect()} == {(1, int(y), int(x)) for y, x in np.argwhere(g < 128)}
    e = G.edges(g)
    assert e[7, 10] and e[8, 10] and not e[2, 2] and not e[10, 15] and e.shape == g.shape


def test_pages_are_turned_whole(spark, monkeypatch):
    """no plan has a row for each pixel and angle, and pages that are cut by batches and chunks stay whole, sparse and null-keyed ones too."""
    rng = np.random.default_rng(8)
    pages = {k: sorted({(int(y), int(x)) for y, x in zip(rng.integers(0, 40 + k, 700 + 40 * k), rng.integers(-50, 90, 700 + 40 * k))}) for k in range(12)}
    pages |= {20: [(0, 0)], 21: [(0, 0), (3_000_000, 4_000_000)], 22: ruled(5.0), None: ruled(-4.0)}
    df = frame(spark, pages)
    assert not G.skew(df, df, "page")._jdf.queryExecution().executedPlan().toString().count("explode")

    def lines(points, votes):
        y, x = np.array(points).T
        n = {}
        for a in range(-24, 25):
            for r, k in zip(*np.unique(row(y, x, a), return_counts=True)):
                if k >= votes:
                    n[a, int(r)] = int(k)
        near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        return {(a, r, k) for (a, r), k in n.items() if (k, -a, -r) == max((n[c], -c[0], -c[1]) for i, j in near if (c := (a + i, r + j)) in n)}

    def box(points):
        best = None
        for k in range(180):
            a = -45 + 0.5 * k
            c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
            y, x = np.array(points).T
            u, v = x * c + y * s, y * c - x * s
            size = (round(float((u.max() - u.min()) * (v.max() - v.min())), 6), abs(a), a)
            best = size if best is None or size < best else best
        return 0 if best[1] > G.BOX else best[2]

    monkeypatch.setattr(G, "PIXELS", 900)
    got = {}
    for r in G.line_angles(df, "page", 20).collect():
        got.setdefault(r.page, set()).add((r.angle, r.offset, r.n))
    assert got == {k: v for k, p in pages.items() if (v := lines(p, 20))}
    assert {r.page: r.angle for r in G.profile_angles(df, "page").collect()} == {k: profile(p) for k, p in pages.items()}
    assert {r.page: r.angle for r in G.box_angles(df, "page").collect()} == {k: box(p) for k, p in pages.items()}
    other = df.filter("page = 22")
    assert {(r.page, r.by) for r in G.skew(df.filter("page < 20"), other, "page").collect()} == {(22, "lines")} | {(k, "profile" if abs(profile(pages[k])) >= G.LEAST else "box") for k in range(12)}
