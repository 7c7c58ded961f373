"""Vectorised text kernels over Arrow buffers: words, hashes and packed blobs.

Texts of one chunk are handled as one byte array with document offsets, so the
cost per word is a few array passes and no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd 64-bit multiplier of the polynomial hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, the same in every process.
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers that weigh the words of an n-gram by their place.
PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, n + n // 8)
        arr = np.full(size, base, dtype=np.uint64)
        arr[0] = 1
        have = _powers[base] = np.multiply.accumulate(arr)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: What separates words: space, and tab to carriage return.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: All of ASCII but digits and letters; capitals are folded before.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _FOLD[data]


def texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset at which each starts (one more at the end). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a chunk of documents. first[d] is the place of document d's first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separators, in each document for itself."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(separator[data], out=inside[1 : n + 1])
    starts = inside[1 : n + 1] & ~inside[:n]
    ends = inside[1 : n + 1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] |= inside[cut + 1]
    ends[cut - 1] |= inside[cut]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of which any substring's hash is taken by span_hash."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data), _BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end], the same wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), _BASE_INV)[start] + (end - start).astype(np.uint64) * PLACE[63])


def long_hash(data: np.ndarray, block: int) -> np.uint64:
    """span_hash of all of data, summed block by block."""
    total, scale = 0, 1
    for i in range(0, len(data), block):
        part = data[i : i + block]
        total += int((BYTE_VALUE[part] * powers(len(part), _BASE)).sum()) * scale
        scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    total += len(data) * int(PLACE[63])
    return mix(np.array([total % (1 << 64)], np.uint64))[0]


def word_hash(data: np.ndarray, w: Words, block: int = 1 << 18) -> np.ndarray:
    """Hash of each word. Blocks of bytes are hashed one after the other, so that the sums stay in the cache."""
    out = np.empty(len(w.start), dtype=np.uint64)
    i = 0
    while i < len(out):
        lo = w.start[i]
        if w.end[i] - lo > 4 * block:
            out[i] = long_hash(data[lo : w.end[i]], block)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(w.start, lo + block)))
        if w.end[j - 1] - lo > 4 * block:
            j -= 1
        prefix = prefix_hash(data[lo : w.end[j - 1]])
        out[i:j] = span_hash(prefix, w.start[i:j] - lo, w.end[i:j] - lo)
        i = j
    return out


def gram_hash(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive word hashes, by the place of the first. Whether they are of one document is for the caller."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, PLACE[60 + seed], dtype=np.uint64)
    for k in range(n):
        out += (h[k : k + m] ^ (PLACE[32 + seed] if seed else np.uint64(0))) * PLACE[k]
    return mix(out)


def gram_starts(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where n words from here on are of one document; length total - n + 1."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, dtype=bool)
    for k in range(1, n):
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < m)]
        ok[at] = False
    return ok


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """True for each place inside [s, s + width) of some start."""
    edge = np.zeros(total + width + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge, out=edge)[:total] > 0


def runs(flag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True that stays in one document."""
    n = len(flag)
    pad = np.zeros(n + 2, dtype=bool)
    pad[1:-1] = flag
    starts = pad[1 : n + 1] & ~pad[:n]
    ends = pad[1 : n + 1] & ~pad[2:]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] |= flag[cut]
    ends[cut - 1] |= flag[cut - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, lowest of all first: sorted and small values then compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel() if len(b) else np.zeros(0, dtype)


def group_bounds(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts, and its length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
