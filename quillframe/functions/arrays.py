"""Array numerics of page images and recogniser outputs: numpy functions, and the frames that map them over rows.

Images are two-dimensional uint8 arrays; a frame holds them as h, w, data (binary). Everything here sees
one image or line at a time, so it maps over rows in Arrow batches and never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_images(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df (h, w, data and others) with each image replaced by f of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [f(np.frombuffer(d, np.uint8).reshape(h, w)) for h, w, d in zip(pdf["h"], pdf["w"], pdf["data"], strict=True)]
            yield pdf.assign(h=[x.shape[0] for x in out], w=[x.shape[1] for x in out], data=[np.ascontiguousarray(x, np.uint8).tobytes() for x in out])

    return df.mapInPandas(run, df.schema)


def map_values(df: DataFrame, f: Callable[[np.ndarray], list], keys: list[str], schema: str) -> DataFrame:
    """keys and the rows of values that f gives for each image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, *(x.split()[0] for x in schema.split(", "))]
        for pdf in batches:
            rows = [[*(r[k] for k in keys), *v] for r in pdf.to_dict("records") for v in f(np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]))]
            yield pd.DataFrame(rows, columns=names)

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema]))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x.astype(float), radius, mode="symmetric"), k / k.sum(), mode="valid")


def opened(binary: np.ndarray, length: int, axis: int) -> np.ndarray:
    """Ink that lies in a straight run of `length` and more along the axis."""
    a = (binary > 0) if axis == 1 else (binary > 0).T
    if a.shape[1] < length:
        return np.zeros(binary.shape, bool)
    whole = sliding_window_view(a, length, axis=1).all(axis=2)
    edge = np.zeros((a.shape[0], a.shape[1] + 1), int)
    edge[:, : whole.shape[1]] += whole
    edge[:, length : length + whole.shape[1]] -= whole[:, : edge.shape[1] - length]
    out = np.cumsum(edge[:, :-1], axis=1) > 0
    return out if axis == 1 else out.T


def without_grid(binary: np.ndarray, length: int = 25, least: int = 100) -> np.ndarray:
    """Without straight runs in either direction, if enough ink is left."""
    cut = np.where(opened(binary, length, 1) | opened(binary, length, 0), 0, binary).astype(np.uint8)
    return cut if np.count_nonzero(cut) >= least else binary


def without_rulings(binary: np.ndarray, share: float = 0.8) -> np.ndarray:
    """Without vertical runs as long as most of the slice."""
    return np.where(opened(binary, max(2, int(binary.shape[0] * share)), 0), 0, binary).astype(np.uint8)


#: graphite's saturation and value stay below these, an underline is as long as this at least, and as much ink must be left.
SATURATION, VALUE, UNDERLINE, INK_LEFT = 32, 185, 36, 120


def without_underlines(color: np.ndarray | None, binary: np.ndarray) -> np.ndarray:
    """Without long level strokes of pencil, with a pixel to either side and the row below; as it is if too little ink would be left or there is no colour."""
    if color is None or color.ndim != 3:
        return binary
    value = color.max(axis=2).astype(float)
    saturation = (value - color.min(axis=2)) / np.maximum(value, 1) * 255
    strokes = opened((saturation < SATURATION) & (value < VALUE) & (binary > 0), UNDERLINE, 1)
    strokes[1:] |= strokes[:-1].copy()
    wide = np.pad(strokes, ((0, 0), (1, 1)))
    cut = np.where(wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:], 0, binary).astype(binary.dtype)
    return cut if np.count_nonzero(cut) >= INK_LEFT else binary


def row_profile(binary: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    return gaussian((without_grid(binary) > 0).sum(axis=1), sigma)


def peaks(x: np.ndarray, distance: float, prominence: float) -> np.ndarray:
    """Local maxima (middle of flat tops), the higher first kept within a distance, of some prominence."""
    mid, i, n = [], 1, len(x)
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            mid.append((i + j) // 2)
        i = j + 1
    keep = np.ones(len(mid), bool)
    at = np.array(mid, int)
    for k in np.argsort(x[at], kind="stable")[::-1] if len(at) else ():
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    out = []
    for p in at[keep]:
        lower = np.flatnonzero(x[:p] > x[p])
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        left = x[(lower[-1] if len(lower) else 0) : p + 1].min()
        right = x[p : (p + 1 + higher[0]) if len(higher) else n].min()
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, int)


def line_intervals(profile: np.ndarray, least: int = 10, gap: int = 4) -> list[tuple[int, int]]:
    """Lines as (top, bottom): between valleys of the peaks, small pieces merged; a threshold where there are no two peaks."""
    h = len(profile)
    spread = float(profile.max() - profile.min()) if h else 0.0
    found = peaks(profile, max(18, 0.016 * h), max(3.0, 0.04 * spread)) if spread > 8 else np.zeros(0, int)
    if len(found) >= 2:
        cuts = []
        for a, b in zip(found, found[1:], strict=False):
            v = profile[a : b + 1]
            at = np.flatnonzero(v == v.min())
            cuts.append(int(a + at[len(at) // 2]))
        top = profile[: found[0] + 1]
        low = top.min() + 0.15 * (profile[found[0]] - top.min())
        first = np.flatnonzero(top > low)
        tail = profile[found[-1] :]
        low = tail.min() + 0.15 * (profile[found[-1]] - tail.min())
        last = np.flatnonzero(tail > low)
        edges = [int(first[0]) if len(first) else 0, *cuts, int(found[-1] + last[-1] + 1) if len(last) else h]
        parts = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a >= least]
        middle = float(np.median([b - a for a, b in parts])) if parts else 0.0
        out: list[tuple[int, int]] = []
        for a, b in parts:
            if out and min(b - a, out[-1][1] - out[-1][0]) < max(14, 0.35 * middle) and b - out[-1][0] <= 1.35 * middle:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out
    full = profile[profile > 0]
    on = np.concatenate([[0], (profile > max(2.0, 0.08 * float(full.mean()) if len(full) else 2.0)).astype(int), [0]])
    parts = [(int(a), int(b)) for a, b in zip(np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1), strict=True) if b - a >= least]
    out = []
    for a, b in parts:
        if out and a - out[-1][1] < gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def ink_bounds(binary: np.ndarray, gap: int = 40, share: float = 0.15) -> tuple[int, int]:
    """First and last column of ink, without edge clusters of little ink that stand apart."""
    columns = (binary > 0).sum(axis=0)
    at = np.flatnonzero(columns)
    if not len(at):
        return 0, binary.shape[1]
    groups = np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)
    total = columns.sum()
    while len(groups) > 1 and columns[groups[0]].sum() < share * total:
        groups.pop(0)
    while len(groups) > 1 and columns[groups[-1]].sum() < share * total:
        groups.pop()
    return int(groups[0][0]), int(groups[-1][-1]) + 1


def tight(binary: np.ndarray, pad: int = 2) -> tuple[np.ndarray, int]:
    """The crop's rows with ink and some padding, and how many rows went from the top."""
    rows = np.flatnonzero((binary > 0).any(axis=1))
    if not len(rows):
        return binary, 0
    a, b = max(0, int(rows[0]) - pad), min(binary.shape[0], int(rows[-1]) + 1 + pad)
    return binary[a:b], a


#: A part below a line is its descenders up to this gap, height and ink; a line has this much ink and height at least. A line of DOUBLE times the middle height and TALL rows is
#: cut at its valley, looked for between these shares of its height, if that has less ink than a share of either half's peak or than a few pixels, and leaves halves so high.
DESCENDERS, LEAST_LINE = (5, 18, 350), (80, 12)
DOUBLE, TALL, BETWEEN, VALLEY, HALF = 1.35, 55, (0.28, 0.72), (0.75, 45.0), 15


def with_descenders(parts: list[tuple[int, int]], ink: np.ndarray) -> list[tuple[int, int]]:
    """Lines as (top, bottom) with the small parts close below them; what is too little for a line goes. ink: pixels of each row."""
    gap, height, most = DESCENDERS
    out: list[tuple[int, int]] = []
    end = None  # of the part before
    for a, b in parts:
        if end is not None and a - end <= gap and b - a <= height and ink[a:b].sum() < most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        end = b
    return [(a, b) for a, b in out if ink[a:b].sum() >= LEAST_LINE[0] and b - a >= LEAST_LINE[1]]


def without_doubles(parts: list[tuple[int, int]], ink: np.ndarray) -> list[tuple[int, int]]:
    """Lines of double height cut at their valley, once."""
    middle = float(np.median([b - a for a, b in parts])) if parts else 0.0
    out = []
    for a, b in parts:
        h = b - a
        lo, hi = int(h * BETWEEN[0]), int(h * BETWEEN[1])
        if h >= DOUBLE * middle and h >= TALL:
            soft = gaussian(ink[a:b], 2.0)
            cut = a + lo + int(np.argmin(soft[lo:hi]))
            valley = soft[lo:hi].min()
            if (valley < VALLEY[0] * min(soft[:lo].max(), soft[hi:].max()) or valley < VALLEY[1]) and cut - a >= HALF and b - cut >= HALF:
                out += [(a, cut), (cut, b)]
                continue
        out.append((a, b))
    return out


def segment_lines(binary: np.ndarray, pad: int = 6, least_ink: int = 35) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the lines of a page from top to bottom: descenders with their line, double lines cut. What hugs the page's upper or lower edge is its border."""
    h, w = binary.shape
    ink = (without_grid(binary) > 0).sum(axis=1)
    parts = line_intervals(gaussian(ink, max(4.5, min(7.5, h / 160))), 12, 4)
    out = []
    for y0, y1 in without_doubles(with_descenders(parts, ink), ink):
        if (y1 <= int(0.035 * h) and y0 <= 4) or (y1 >= h - 6 and y0 >= h - 40):
            continue
        more = max(pad, int((y1 - y0) * 0.14))
        top, bottom = max(0, y0 - more), min(h, y1 + more)
        x0, x1 = ink_bounds(binary[top:bottom])
        left, right = max(0, x0 - pad), min(w, x1 + pad)
        if right - left >= 24 and bottom - top > 10 and np.count_nonzero(binary[top:bottom, x0:x1]) >= least_ink:
            out.append((left, top, right - left, bottom - top))
    return sorted(out, key=lambda x: x[1])


def column_spans(binary: np.ndarray, least_ink: int = 250) -> list[tuple[int, int]]:
    """A line's spans between wide empty gaps with enough ink on both sides."""
    columns = (binary > 0).sum(axis=0)
    at = np.flatnonzero(columns)
    if not len(at):
        return [(0, binary.shape[1])]
    wide = max(80, 0.12 * binary.shape[1])
    cuts = [0]
    for a, b in zip(at, at[1:], strict=False):
        if b - a > wide and columns[cuts[-1] : a + 1].sum() >= least_ink and columns[b:].sum() >= least_ink:
            cuts.append(int((a + b) // 2))
    return list(zip(cuts, [*cuts[1:], binary.shape[1]], strict=True))


def energy(binary: np.ndarray, gray: np.ndarray | None = None) -> np.ndarray:
    """What a seam pays: ink much, nearness of ink and edges a little."""
    ink = (binary > 0).astype(float)
    near = np.apply_along_axis(gaussian, 0, ink, 2.0)
    e = 100 * ink + 20 * near
    if gray is not None:
        gy, gx = np.gradient(gray.astype(float))
        e += np.hypot(gx, gy) * 0.1
    return e


def seam(e: np.ndarray, y_min: int, y_max: int, centre: float = 0.05) -> np.ndarray:
    """Row of the cheapest path from left to right within a band, by dynamic programming over three neighbours; the first of equals."""
    y_min, y_max = max(0, y_min), min(e.shape[0], y_max)
    band = e[y_min:y_max].astype(float)
    h, w = band.shape
    band = band + centre * ((np.arange(h) - h / 2) ** 2)[:, None]
    cost, back = band[:, 0], np.zeros((h, w), int)
    for x in range(1, w):
        pad = np.concatenate([[np.inf], cost, [np.inf]])
        options = np.stack([pad[:-2], pad[1:-1], pad[2:]])
        back[:, x] = np.argmin(options, axis=0) - 1
        cost = options.min(axis=0) + band[:, x]
    path = np.empty(w, int)
    path[-1] = int(np.argmin(cost))
    for x in range(w - 1, 0, -1):
        path[x - 1] = path[x] + back[path[x], x]
    return path + y_min


def line_seams(binary: np.ndarray, parts: list[tuple[int, int]]) -> list[np.ndarray]:
    """A seam between each two neighbouring lines."""
    e, out = energy(binary), []
    for (a0, a1), (b0, b1) in zip(parts, parts[1:], strict=False):
        middle, reach = (a1 + b0) // 2, int(max(24, 0.5 * ((a1 - a0) + (b1 - b0)) / 2 + max(0, b0 - a1)))
        out.append(seam(e, middle - reach, middle + reach))
    return out


def seam_crop(image: np.ndarray, top: np.ndarray | None, bottom: np.ndarray | None, y0: int, y1: int, x0: int, x1: int, background: int = 255) -> np.ndarray:
    """The box, with what lies beyond either seam blanked."""
    out = image[y0:y1, x0:x1].copy()
    rows = np.arange(y0, y1)[:, None]
    if top is not None:
        out[rows < top[None, x0:x1]] = background
    if bottom is not None:
        out[rows > bottom[None, x0:x1]] = background
    return out


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean of the square around each pixel, the border reflected; an integral image makes it independent of the size."""
    r = size // 2
    p = np.pad(x.astype(float), r, mode="reflect") if min(x.shape) > r else np.pad(x.astype(float), r, mode="symmetric")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2


def sauvola(gray: np.ndarray, size: int = 35, k: float = 0.22, r: float = 128.0) -> np.ndarray:
    """255 where a pixel is darker than its surroundings' mean and spread allow."""
    size |= 1
    m = box_mean(gray, size)
    s = np.sqrt(np.maximum(box_mean(gray.astype(float) ** 2, size) - m**2, 0))
    return np.where(gray < m * (1 + k * (s / r - 1)), 255, 0).astype(np.uint8)


def _extreme(x: np.ndarray, size: int, f: Callable) -> np.ndarray:
    r = size // 2
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        x = f(sliding_window_view(np.pad(x, pad, mode="edge"), 2 * r + 1, axis=axis), axis=-1)
    return x


def even_light(gray: np.ndarray, size: int = 51) -> np.ndarray:
    """Divided by the background, which closing with a square gives."""
    background = _extreme(_extreme(gray, size, np.max), size, np.min).astype(float)
    return np.clip(gray / np.maximum(background, 1) * 255, 0, 255).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """Threshold with the widest spread between its two sides."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, m = hist.cumsum(), (hist * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarized(gray: np.ndarray) -> np.ndarray:
    """Sauvola's ink, and what both a local and a global threshold call ink; single pixels opened away."""
    even = even_light(gray)
    local = even < box_mean(even, 31) - 12
    ink = (sauvola(even) > 0) | (local & (even <= otsu(even)))
    return np.where(_extreme(_extreme(ink.astype(np.uint8), 2, np.min), 2, np.max) > 0, 255, 0).astype(np.uint8)


def clahe(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles with clipped counts, blended between tile centres."""
    h, w = gray.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            t = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(t.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * t.size / 256)
            hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / 256
            maps[i, j] = hist.cumsum() * 255 / max(t.size, 1)
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i0, j0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    i1, j1 = np.minimum(i0 + 1, tiles - 1), np.minimum(j0 + 1, tiles - 1)
    ay, ax = (fy - i0)[:, None], (fx - j0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], gray]
    out = (1 - ay) * ((1 - ax) * at(i0, j0) + ax * at(i0, j1)) + ay * ((1 - ax) * at(i1, j0) + ax * at(i1, j1))
    return np.clip(out, 0, 255).astype(np.uint8)


def sharpened(gray: np.ndarray, strength: float = 1.4) -> np.ndarray:
    soft = np.apply_along_axis(gaussian, 1, np.apply_along_axis(gaussian, 0, gray, 1.0), 1.0)
    return np.clip(gray + (strength - 1) * (gray - soft), 0, 255).astype(np.uint8)


def without_bleed(gray: np.ndarray, share: float = 0.9) -> np.ndarray:
    """What is nearly as light as the paper becomes paper."""
    paper = np.percentile(gray, 90)
    return np.where(gray > share * paper, 255, gray).astype(np.uint8)


def rotated(gray: np.ndarray, angle: float, background: int = 255) -> np.ndarray:
    """Turned about the middle by degrees, nearest pixels, white outside; under 0.1 degrees a copy."""
    if abs(angle) < 0.1:
        return gray.copy()
    h, w = gray.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    y, x = np.mgrid[:h, :w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = np.rint(c * dy - s * dx + (h - 1) / 2).astype(int), np.rint(s * dy + c * dx + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, gray[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], background).astype(np.uint8)


def skew(binary: np.ndarray, most: float = 10.0, step: float = 0.5) -> float:
    """Angle whose rotation makes the row profile vary most."""
    angles = np.arange(-most, most + step / 2, step)
    return float(max(angles, key=lambda a: ((rotated(binary, a, 0) > 0).sum(axis=1).astype(float).var(), -abs(a))))


def deskewed(gray: np.ndarray, least: float = 0.75, most: float = 8.0) -> np.ndarray:
    """A line turned level if its slope is within bounds: least squares through the columns' ink centres."""
    ink = gray < 128
    x = np.flatnonzero(ink.any(axis=0))
    if len(x) < 8:
        return gray
    y = np.array([np.flatnonzero(ink[:, c]).mean() for c in x])
    angle = float(np.degrees(np.arctan(np.polyfit(x, y, 1)[0])))
    return rotated(gray, angle) if least <= abs(angle) <= most else gray


def padded(crop: np.ndarray, vertical: int | None = None, horizontal: int | None = None, background: int = 255) -> np.ndarray:
    v = max(4, crop.shape[0] // 8) if vertical is None else vertical
    h = max(8, crop.shape[0] // 4) if horizontal is None else horizontal
    return np.pad(crop, ((v, v), (h, h)), constant_values=background)


def variants(crop: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """The three readings of a line that recognition is asked for."""
    return [("base", crop), ("contrast", clahe(crop)), ("sharp", sharpened(crop))]


def corners(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left of four points."""
    s, d = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[int(np.argmin(s)), int(np.argmin(d)), int(np.argmax(s)), int(np.argmax(d))]]


def corner_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top_left, top_right, bottom_right, bottom_left (structs of x, y) of the points (x, y) of each key; of equals the one with the smaller, at the far corners the larger x, then y."""
    p, total, apart = F.struct("x", "y"), F.struct(F.col("x") + F.col("y"), "x", "y"), F.struct(F.col("y") - F.col("x"), "x", "y")
    ends = (F.min_by(p, total), F.min_by(p, apart), F.max_by(p, total), F.max_by(p, apart))
    return points.groupBy(*keys).agg(*[e.alias(n) for e, n in zip(ends, ("top_left", "top_right", "bottom_right", "bottom_left"), strict=True)])


def warped(image: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The quadrangle as an upright rectangle as large as its longer edges."""
    tl, tr, br, bl = p = corners(points.astype(float))
    w = int(max(np.linalg.norm(br - bl), np.linalg.norm(tr - tl)))
    h = int(max(np.linalg.norm(tr - br), np.linalg.norm(tl - bl)))
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows = [r for (x, y), (u, v) in zip(target, p, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    m = np.append(np.linalg.solve(np.array(rows), p.ravel()), 1).reshape(3, 3)
    y, x = np.mgrid[:h, :w]
    u, v, z = (m @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])).reshape(3, h, w)
    sx, sy = np.rint(u / z).astype(int), np.rint(v / z).astype(int)
    inside = (sx >= 0) & (sx < image.shape[1]) & (sy >= 0) & (sy < image.shape[0])
    return np.where(inside, image[np.clip(sy, 0, image.shape[0] - 1), np.clip(sx, 0, image.shape[1] - 1)], 255).astype(np.uint8)


def line_tensor(crop: np.ndarray, height: int = 32, most: int = 1280, multiple: int = 4) -> np.ndarray:
    """Scaled to one height, width padded to a multiple with white, values in -1 .. 1."""
    w = max(multiple, min(most, round(crop.shape[1] * height / max(1, crop.shape[0]))))
    yy = np.minimum((np.arange(height) + 0.5) * crop.shape[0] / height, crop.shape[0] - 1).astype(int)
    xx = np.minimum((np.arange(w) + 0.5) * crop.shape[1] / w, crop.shape[1] - 1).astype(int)
    out = np.full((height, -(-w // multiple) * multiple), 255, np.uint8)
    out[:, :w] = crop[yy][:, xx]
    return out / 127.5 - 1.0


def browser_ink(gray: np.ndarray, block: int = 40, below: float = 16.0, ruled: float = 0.52) -> np.ndarray:
    """Block-mean threshold; rows that are ink for the most part are ruling and are bleached."""
    h, w = gray.shape
    ink = np.zeros((h, w), bool)
    for y in range(0, h, block):
        for x in range(0, w, block):
            b = gray[y : y + block, x : x + block]
            ink[y : y + block, x : x + block] = b < b.mean() - below
    ink[ink.mean(axis=1) > ruled] = False
    return np.where(ink, 0, 255).astype(np.uint8)


_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _follow(prefix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Number of each prefix with a symbol behind it, from the prefix's own number: 64 bits of its content."""
    x = (prefix ^ (prefix >> np.uint64(29))) * _STEP + (symbol.astype(np.uint64) + np.uint64(1)) * _SEED
    return x ^ (x >> np.uint64(32))


def ctc_beams(logp: list[np.ndarray], blank: int = 0, width: int = 8, least: float = 1e-6) -> list[tuple[list[int], float]]:
    """Best prefix of each log-probability table (steps x classes) by prefix beam search, and the mean of its symbols' best probabilities over all steps.

    All tables go on step by step together: their beams are one array of lines x width. A step's candidates are the prefixes as they are
    and each with each symbol; one of these that is a prefix already is added to it. Of equal ones the prefix before, then the smaller symbol, stays."""
    n, classes = len(logp), max((x.shape[1] for x in logp if x.size), default=1)
    steps = max((len(x) for x in logp), default=0)
    p = np.zeros((n, steps, classes))
    for i, x in enumerate(logp):
        if x.size:
            p[i, : len(x), : x.shape[1]] = np.exp(x)
    length = np.array([len(x) for x in logp], int)
    number, parent, last = np.zeros((n, width), np.uint64), np.zeros((n, width), np.uint64), np.full((n, width), -1)
    b, nb = np.zeros((n, width)), np.zeros((n, width))
    b[:, 0] = 1.0
    alive = np.zeros((n, width), bool)
    alive[:, 0] = True
    text, size = np.zeros((n, width, max(steps, 1)), np.int32), np.zeros((n, width), int)
    for t in range(steps):
        at = np.flatnonzero(length > t)
        q, w = p[at, t], np.arange(width)
        own = np.where(last[at] >= 0, np.take_along_axis(q, np.maximum(last[at], 0), axis=1), 0.0)
        own[own < least] = 0.0
        total = b[at] + nb[at]
        same_b, same_nb = total * q[:, [blank]], nb[at] * own
        symbols = np.arange(classes)
        repeated = symbols[None, :, None] == last[at][:, None, :]
        more = np.where(repeated, b[at][:, None, :], total[:, None, :]) * q[:, :, None]  # line, symbol, prefix
        open_ = (alive[at][:, None, :] & (q >= least)[:, :, None]) & (symbols != blank)[None, :, None]
        # prefix j is prefix k with j's last symbol behind it
        child = (parent[at][:, :, None] == number[at][:, None, :]) & alive[at][:, :, None] & alive[at][:, None, :] & (last[at] >= 0)[:, :, None]
        line, j, k = np.nonzero(child)
        c = last[at][line, j]
        known = open_[line, c, k]
        same_nb[line[known], j[known]] += more[line[known], c[known], k[known]]
        open_[line, c, k] = False
        score = np.concatenate([np.where(alive[at], same_b + same_nb, -1.0), np.where(open_, more, -1.0).reshape(len(at), -1)], axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :width]
        stays, k = best < width, np.where(best < width, best, (best - width) % width)
        c = np.where(stays, -1, (best - width) // width)
        rows = np.arange(len(at))[:, None]
        kept = np.take_along_axis(score, best, axis=1) >= 0
        new_nb = np.where(stays, same_nb[rows, k], more[rows, np.maximum(c, 0), k])
        new_b = np.where(stays, same_b[rows, k], 0.0)
        old, old_size = number[at][rows, k], size[at][rows, k]
        text[at] = text[at][rows, k]
        fresh = np.nonzero(~stays & kept)
        text[at[fresh[0]], fresh[1], old_size[fresh]] = c[fresh]
        size[at] = old_size + (~stays & kept)
        parent[at] = np.where(stays, parent[at][rows, k], old)
        number[at] = np.where(stays, old, _follow(old, c))
        last[at] = np.where(stays, last[at][rows, k], c)
        b[at], nb[at], alive[at] = np.where(kept, new_b, 0.0), np.where(kept, new_nb, 0.0), kept
    out = []
    for i in range(n):
        best = text[i, 0, : size[i, 0]].tolist()
        out.append((best, float(np.mean([p[i, :, c].max() for c in best])) if best else 0.0))
    return out


def ctc_beam(logp: np.ndarray, blank: int = 0, width: int = 8, least: float = 1e-6) -> tuple[list[int], float]:
    """ctc_beams() of one table."""
    return ctc_beams([logp], blank, width, least)[0]
