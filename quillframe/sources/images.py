"""Image files as rows of gray pixels: decoded where no library is needed (BMP, PNM), else by a decoder that is given; large ones scaled down."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The longest side that is kept, and the weights of red, green and blue in gray.
LONGEST, GRAY = 4096, (0.299, 0.587, 0.114)


def bmp(content: bytes) -> np.ndarray:
    """Height x width x 3 (red, green, blue) of an uncompressed BMP of 8, 24 or 32 bits."""
    start, head, width, height, planes, bits, packing = struct.unpack_from("<10xIIiiHHI", content)
    if content[:2] != b"BM" or planes != 1 or bits not in (8, 24, 32) or packing not in (0, 3) or width <= 0 or not height:
        raise ValueError("not an uncompressed BMP")
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", content, 46)[0] or 256
        palette = np.frombuffer(content, np.uint8, 4 * used, 14 + head).reshape(-1, 4)
        out = palette[rows][:, :, 2::-1]
    else:
        out = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def pnm(content: bytes) -> np.ndarray:
    """Height x width (x 3) of a binary gray or colour map of one byte a value."""
    fields, at = [], 0
    while len(fields) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        fields.append(content[at:end])
        at = end
    kind, w, h, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or not 0 < most < 256:
        raise ValueError("not a binary map of bytes")
    deep = 3 if kind == b"P6" else 1
    out = np.frombuffer(content, np.uint8, h * w * deep, at + 1).reshape(h, w, deep)
    return out if deep == 3 else out[:, :, 0]


DECODERS = {"bmp": bmp, "pgm": pnm, "ppm": pnm, "pnm": pnm}


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image[:, :, :3] @ np.array(GRAY)).astype(np.uint8)


def scaled(image: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """No side longer than that: each new pixel is the mean of what it covers."""
    h, w = image.shape
    if max(h, w) <= longest:
        return image
    for axis, n in ((0, max(1, int(h * longest / max(h, w)))), (1, max(1, int(w * longest / max(h, w))))):
        whole = np.concatenate([np.zeros_like(image[:1] if axis == 0 else image[:, :1], float), np.cumsum(image, axis=axis, dtype=float)], axis=axis)
        edge = np.arange(n + 1) * image.shape[axis] / n
        low = np.minimum(edge.astype(int), image.shape[axis] - 1)
        part = (edge - low)[:, None] if axis == 0 else (edge - low)[None, :]
        at = np.take(whole, low, axis) + part * np.take(image, low, axis)
        image = np.diff(at, axis=axis) * n / image.shape[axis]
    return np.rint(image).astype(np.uint8)


def decoded(files: DataFrame, key: str = "path", decoders: dict[str, Callable[[bytes], np.ndarray]] = DECODERS, longest: int = LONGEST) -> DataFrame:
    """key, h, w, data (gray bytes), problem of files (key, path, content). A file that cannot be read, of a kind without a decoder, or null has no image but says why; the rest go on."""

    def one(path: str | None, content: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
        kind = (path or "").rpartition(".")[2].lower()
        try:
            if content is None:
                raise ValueError("no content")
            if kind not in decoders:
                raise ValueError(f"no decoder for {kind}")
            out = scaled(gray(decoders[kind](content)), longest)
        except Exception as e:  # a broken file is that row's problem
            return None, None, None, f"{type(e).__name__}: {e}"
        return *out.shape, np.ascontiguousarray(out).tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # an image at a time: each can be large
                h, w, data, problem = one(b.column("_path")[k].as_py(), b.column("content")[k].as_py())
                yield pa.RecordBatch.from_arrays([b.column(key).slice(k, 1), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([data], pa.binary()), pa.array([problem], pa.string())], [key, "h", "w", "data", "problem"])

    kind = dict(files.dtypes)[key]
    return files.selectExpr(key, "path as _path", "content").mapInArrow(run, f"{key} {kind}, h int, w int, data binary, problem string")
