"""Image files as gray pixels."""

import struct

import numpy as np

from quillframe.sources import images


def bmp(image, bits=24, top_down=False):
    h, w = image.shape[:2]
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if bits == 8 else b""
    rows = image if bits == 8 else image[:, :, ::-1] if bits == 24 else np.dstack([image[:, :, ::-1], np.zeros((h, w), np.uint8)])
    rows = rows if top_down else rows[::-1]
    lines = b"".join(r.astype(np.uint8).tobytes().ljust((w * bits // 8 + 3) // 4 * 4, b"\0") for r in rows)
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(lines), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, 0, 0, 0, 0, 0) + palette + lines


def test_round_trips():
    rng = np.random.default_rng(0)
    color, flat = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8), rng.integers(0, 256, (6, 3)).astype(np.uint8)
    for bits in (24, 32):
        for top_down in (False, True):
            assert (images.bmp(bmp(color, bits, top_down)) == color).all()
    assert (images.bmp(bmp(flat, 8)) == flat[:, :, None]).all()
    assert (images.pnm(b"P5 3 # wide\n6\n255\n" + flat.tobytes()) == flat).all()
    assert (images.pnm(b"P6\n5 7 255\n" + color.tobytes()) == color).all()
    assert images.gray(np.full((2, 2, 3), 77, np.uint8)).tolist() == [[77, 77], [77, 77]]


def test_scaled_pixels_are_means():
    x = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (images.scaled(x, 8) == x).all()
    assert images.scaled(x, 4).tolist() == np.rint(x.reshape(3, 2, 4, 2).mean(axis=(1, 3))).astype(int).tolist()
    y = images.scaled(np.full((50, 21), 9, np.uint8), 13)
    assert y.shape == (13, 5) and (y == 9).all()


def test_frames(spark):
    flat = np.arange(30, dtype=np.uint8).reshape(5, 6)
    rows = [("a.pgm", b"P5 6 5 255\n" + flat.tobytes()), ("b.BMP", bmp(flat, 8)), ("c.jpg", b"x"), ("d.bmp", b"BM"), ("e.pgm", None), ("f.raw", flat.tobytes())]
    df = spark.createDataFrame(rows, "path string, content binary")
    out = {r.path: r for r in images.decoded(df, longest=3, decoders=images.DECODERS | {"raw": lambda b: np.frombuffer(b, np.uint8).reshape(5, 6)}).collect()}
    want = images.scaled(flat, 3)
    for name in ("a.pgm", "b.BMP", "f.raw"):
        assert (out[name].h, out[name].w) == want.shape and bytes(out[name].data) == want.tobytes() and out[name].problem is None
    assert all(out[n].data is None and out[n].problem for n in ("c.jpg", "d.bmp", "e.pgm"))
