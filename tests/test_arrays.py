import numpy as np
import pytest

from quillframe.functions import arrays as A


def page(lines=5, h=400, w=600, step=70):
    out = np.zeros((h, w), np.uint8)
    for k in range(lines):
        y = 30 + k * step
        out[y : y + 24 : 2, 50 : w - 60] = 255
    return out


def test_lines_of_a_page():
    p = page()
    profile = A.gaussian((p > 0).sum(axis=1), 4.5)
    found = A.line_intervals(profile)
    assert len(found) == 5
    assert all(a <= 30 + 70 * k and b >= 50 + 70 * k for k, (a, b) in enumerate(found))


def test_threshold_fallback_merges_near_intervals():
    x = np.zeros(60)
    x[10:25] = 5
    x[27:45] = 5
    assert A.line_intervals(x) == [(10, 45)]


def test_seam_is_cheapest_path():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 9, (6, 7)).astype(float)
    path = A.seam(e, 0, 6, 0.0)
    assert (abs(np.diff(path)) <= 1).all()
    best = min(
        sum(e[y, x] for x, y in enumerate(p))
        for start in range(6)
        for p in _paths(start, 6, 7)
    )
    assert sum(e[y, x] for x, y in enumerate(path)) == best


def _paths(start, h, w):
    out = [[start]]
    for _ in range(w - 1):
        out = [[*p, y] for p in out for y in range(max(0, p[-1] - 1), min(h, p[-1] + 2))]
    return out


def test_sauvola_finds_ink_and_skips_paper():
    g = np.full((60, 80), 220, np.uint8)
    g[20:24, 10:70] = 30
    ink = A.sauvola(g)
    assert ink[21, 40] == 255 and ink[50, 40] == 0


def test_grid_goes_and_ink_stays():
    b = np.zeros((60, 200), np.uint8)
    b[30, :] = 255
    b[10:20, 10:30] = 255
    out = A.without_grid(b)
    assert not out[30].any() and out[12, 15] == 255


def test_rotation_and_skew():
    p = page()
    assert (A.rotated(p, 0.05) == p).all()
    assert A.skew(A.rotated(p, 3.0, 0)) == pytest.approx(-3.0, abs=1.0)


def test_corners_and_warp():
    pts = np.array([[50, 5], [5, 5], [5, 40], [50, 40]])
    assert A.corners(pts).tolist() == [[5, 5], [50, 5], [50, 40], [5, 40]]
    img = np.arange(60 * 60, dtype=np.uint16).reshape(60, 60).astype(np.uint8)
    assert A.warped(img, pts).shape == (35, 45)


def test_descenders_and_doubles():
    ink = np.zeros(300, int)
    ink[20:50] = 40
    ink[53:60] = 20  # descenders
    ink[100:130] = 40
    ink[140:150] = 40  # too far, and too little to be a line
    parts = [(20, 50), (53, 60), (100, 130), (140, 150)]
    assert A.with_descenders(parts, ink) == [(20, 60), (100, 130)]
    assert A.with_descenders([(20, 50), (53, 60), (63, 70)], ink + (np.arange(300) == 65) * 30)[0] == (20, 70)
    ink[:] = 0
    ink[10:40] = ink[60:90] = ink[110:140] = ink[150:180] = 60
    parts = [(10, 40), (60, 90), (110, 180)]
    cut = A.without_doubles(parts, ink)
    assert cut[:2] == parts[:2] and len(cut) == 4 and cut[2][0] == 110 and 138 <= cut[2][1] <= 152 and cut[3] == (cut[2][1], 180)
    ink[110:180] = 60
    assert A.without_doubles(parts, ink) == parts  # no valley
    assert A.with_descenders([], ink) == A.without_doubles([], ink) == []


def test_boxes_of_lines():
    p = page()
    p[:, np.arange(p.shape[1]) % 18 < 6] = 0  # letters, no ruling
    p[0:4, :] = 255  # the border of a table
    boxes = A.segment_lines(p)
    assert len(boxes) == 5 and all(y <= 30 + 70 * k and y + h >= 53 + 70 * k and h < 100 and x <= 50 and x + w >= 540 for k, (x, y, w, h) in enumerate(boxes))
    assert A.segment_lines(np.zeros((50, 60), np.uint8)) == []


def test_spans():
    b = np.zeros((40, 800), np.uint8)
    b[10:30, 20:300] = 255
    b[10:30, 460:780] = 255
    assert len(A.column_spans(b)) == 2
    b[10:30, 340:460] = 255
    assert len(A.column_spans(b)) == 1


def test_beam_joins_paths_that_greedy_splits():
    p = np.array([[0.4, 0.35, 0.25], [0.4, 0.35, 0.25]])
    ids, conf = A.ctc_beam(np.log(p))
    assert ids == [1] and conf == pytest.approx(0.35)


def plain_beam(p, width):
    """Prefix beam search in dictionaries, one table at a time."""
    beams = {(): (1.0, 0.0)}
    for step in p:
        new = {x: [0.0, 0.0] for x in beams}
        for x, (b, nb) in beams.items():
            new[x][0] += (b + nb) * step[0]
        for c in range(1, len(step)):
            if step[c] >= 1e-6:
                for x, (b, nb) in beams.items():
                    if x and x[-1] == c:
                        new[x][1] += nb * step[c]
                    new.setdefault((*x, c), [0.0, 0.0])[1] += (b if x and x[-1] == c else b + nb) * step[c]
        beams = dict(sorted(new.items(), key=lambda kv: -(kv[1][0] + kv[1][1]))[:width])
    best = max(beams, key=lambda x: sum(beams[x]))
    return list(best), float(np.mean([p[:, c].max() for c in best])) if best else 0.0


@pytest.mark.parametrize("width", [1, 3, 8])
def test_beams_of_many_lines_are_those_of_each(width):
    rng = np.random.default_rng(width)
    tables = []
    for k in range(120):
        p = rng.dirichlet(np.full(int(rng.integers(2, 7)), rng.choice([0.2, 1.0, 5.0])), int(rng.integers(0, 14)))
        p[p < 1e-4] = rng.choice([0.0, 1e-7, 2e-6])
        tables.append(p)
    with np.errstate(divide="ignore"):
        got = A.ctc_beams([np.log(p) for p in tables], width=width)
    for p, (ids, conf) in zip(tables, got):
        want, mean = plain_beam(p, width)
        assert ids == want and conf == pytest.approx(mean)
    assert A.ctc_beams([]) == []


def test_shapes():
    g = np.random.default_rng(1).integers(0, 256, (37, 91)).astype(np.uint8)
    for f in (A.clahe, A.sharpened, A.even_light, A.binarized, A.without_bleed, A.deskewed, A.browser_ink):
        assert f(g).shape == g.shape
    t = A.line_tensor(g)
    assert t.shape[0] == 32 and t.shape[1] % 4 == 0 and -1 <= t.min() <= t.max() <= 1
    assert [n for n, _ in A.variants(g)] == ["base", "contrast", "sharp"]
    assert A.padded(g, 2, 3).shape == (41, 97)
    crop, top = A.tight(np.pad(np.full((4, 9), 255, np.uint8), ((10, 5), (0, 0))))
    assert crop.shape[0] == 8 and top == 8


def test_frames(spark):
    p = page()
    df = spark.createDataFrame([(1, *p.shape, bytearray(p.tobytes()))], "id int, h int, w int, data binary")
    boxes = A.map_values(df, lambda x: A.segment_lines(x), ["id"], "x int, y int, bw int, bh int")
    assert boxes.count() == 5
    back = A.map_images(df, lambda x: A.padded(x, 1, 1)).first()
    assert (back.h, back.w) == (402, 602)


def test_pencil_underlines_go_and_ink_stays():
    color = np.full((60, 200, 3), 250, np.uint8)
    color[10:20, 20:60] = (20, 20, 200)  # ink of a colour
    color[30, 20:90] = 120  # pencil, long
    color[40, 20:50] = 120  # pencil, short
    color[50, 20:90] = (20, 20, 200)  # ink, long
    binary = np.where(color.min(axis=2) < 200, 255, 0).astype(np.uint8)
    out = A.without_underlines(color, binary)
    assert not out[30].any() and (out[40] == binary[40]).all() and (out[50] == binary[50]).all() and (out[10:20] == binary[10:20]).all()
    assert A.without_underlines(None, binary) is binary
    bare = np.zeros_like(binary)
    bare[30, 20:90] = 255
    assert A.without_underlines(color, bare) is bare
