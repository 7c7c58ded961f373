"""Words with the word before and the word after, dealt out by word in blobs of a few bytes a word, and how often pairs and threes of them stand.

A word is a number: 0 is none, then the common words, then those of a blob or of a group of blobs alone, which go with it as strings.
The frames are in operators/language_model.py."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are dealt out at a time.
CHUNK = 1 << 20
ROWS = "part int, blob binary, side int, other int, word string, n long"
_TYPES = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
#: Pairs that a part asks for: how often its word stands behind the other, and before it; and how often the other, no common word, stands at all.
PAIRS = "word string, side int, other string, n long"
BEHIND, BEFORE, ALONE = 0, 1, 2


class Common:
    """Common words, the commonest first, with their counts; n words in all.

    A word's rows go to one part, those of a word that stands over `most` times to the cells of a square: a row for the word before, a column for the word after."""

    def __init__(self, words: pa.Array, counts: np.ndarray, n: int, share: int, most: int):
        self.words, self.counts = words, np.concatenate([[0], counts]).astype(np.int64)
        self.parts = max(24, -(-n // share))
        self.side = np.where(self.counts > most, np.ceil(np.sqrt(self.counts / most)), 1).astype(np.int64)
        cells = np.where(self.side > 1, self.side**2, 0)
        self.first = self.parts + np.cumsum(cells) - cells
        mixed = np.arange(len(self.counts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.hash = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32).astype(np.int64)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The words' numbers, and the strings of those that are not common."""
        found = pc.index_in(words, value_set=self.words.cast(words.type))
        ids = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        rare = ids == 0
        others = words.filter(pa.array(rare)).dictionary_encode()
        ids[rare] = len(self.counts) + others.indices.to_numpy(zero_copy_only=False)
        return ids, others.dictionary.cast(pa.string())

    def hashes(self, others: pa.Array) -> np.ndarray:
        """By number, with those of the other words behind."""
        return np.concatenate([self.hash, np.array([zlib.crc32(w.encode()) for w in others.to_pylist()], np.int64)])

    def part(self, before: np.ndarray, word: np.ndarray, after: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        side = np.ones(len(word), np.int64)
        common = word < len(self.counts)
        side[common] = self.side[word[common]]
        out = hashes[word] % self.parts
        hot = np.flatnonzero(side > 1)
        s = side[hot]
        out[hot] = self.first[word[hot]] + hashes[before[hot]] % s * s + hashes[after[hot]] % s
        return out


def _planes(a: np.ndarray) -> bytes:
    """How many bytes a number takes at most, then the first bytes of all, the second ones and so on: they pack better."""
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    width = next(w for w in (0, 1, 2, 4, 8) if low == high == 0 or w and -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + (a.astype(f"<i{width}").view(np.uint8).reshape(len(a), width).T.tobytes() if width else b"")


def _pack(keys: list[np.ndarray], numbers: list[np.ndarray], words: pa.Array) -> bytes:
    """keys and numbers have one length; a key stands as its step from the one before."""
    text = [w.encode() for w in words.to_pylist()]
    lengths = np.array([len(w) for w in text], np.int64)
    raw = b"".join([*(_planes(np.diff(a, prepend=np.int64(0))) for a in keys), *map(_planes, numbers), _planes(lengths), *text])
    head = np.array([len(numbers[0]), len(text), len(raw)], np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, keys: int, numbers: int) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    n, words, size = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    raw, at, out = pa.decompress(blob[24:], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for many in [n] * (keys + numbers) + [words]:
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, many * width, at + 1).reshape(width, many)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<i{width}").astype(np.int64) if width else np.zeros(many, np.int64))
        at += 1 + many * width
    offsets = np.concatenate([[0], np.cumsum(out[-1])]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), words, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at:])])
    return [np.cumsum(a) for a in out[:keys]], out[keys:-1], text.cast(pa.string())


def _rows(parts: np.ndarray, blobs: list[bytes] | None, *more: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array(parts.astype(np.int32)), pa.nulls(len(parts), pa.binary()) if blobs is None else pa.array(blobs, pa.binary()), *(more or [pa.nulls(len(parts), t) for t in _TYPES[2:]])]
    return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _TYPES, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with some CHUNK words (w) at a time."""
    held, size = [], 0
    for b in batches:
        n = np.cumsum(pc.list_value_length(b.column("w")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(n):
            before = n[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(n, before + CHUNK - size, side="right")))
            held.append(b.slice(at, end - at))
            size += int(n[end - 1] - before)
            at = end
            if size >= CHUNK or at < len(n):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _sides(common: Common, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """line, k, before, word, after of each word, and the strings of those that are not common."""
    w = t.column("w").combine_chunks()
    n = pc.list_value_length(w).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    word, others = common.numbers(w.flatten())
    first, line = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[first[n > 0]] = 0
    after[(first + n - 1)[n > 0]] = 0
    return line, np.arange(len(word)) - first[line], before, word, after, others


def deal(common: Common, keys: list[str]):
    """For mapInArrow: rows of keys (whole numbers) and w (a text's words) to ROWS, a blob for each part and chunk."""
    known = len(common.counts)

    def chunk(t: pa.Table) -> pa.RecordBatch:
        line, *numbers, others = _sides(common, t)
        part = common.part(*numbers[1:], common.hashes(others))
        order = np.argsort(part, kind="stable")
        part, line = part[order], line[order]
        # a key that is null stands as 0 and a one beside it
        own = [a for c in keys for a in (t.column(c).is_null().to_numpy().astype(np.int64), t.column(c).fill_null(0).to_numpy().astype(np.int64))]
        parts, bounds = np.unique(part, return_index=True)
        blobs = []
        for a, b in zip(bounds, [*bounds[1:], len(part)], strict=True):
            k, *ids = (x[order[a:b]] for x in numbers)
            ids = np.stack(ids)
            rare = ids >= known
            used, ids[rare] = np.unique(ids[rare], return_inverse=True)
            ids[rare] += known
            blobs.append(_pack([x[line[a:b]] for x in own], [k, *ids], others.take(pa.array(used - known))))
        return _rows(parts, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            yield chunk(t)

    return run


def asked(common: Common):
    """For mapInArrow: rows of w to PAIRS that the parts do not see whole, counted in a chunk: those of words in cells, and those with a word after that is not common."""
    known = len(common.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            _, _, before, word, after, others = _sides(common, t)
            names = pa.concat_arrays([common.words.cast(pa.string()), others])
            hot = common.side[np.minimum(word, known - 1)] * (word < known) > 1
            for side, other, some in ((BEHIND, before, hot & (before > 0)), (BEFORE, after, hot & (after > 0)), (ALONE, after, after >= known)):
                pair, n = np.unique((word[some] << 32) | other[some], return_counts=True)
                columns = [names.take(pa.array((pair >> 32) - 1)), pa.array(np.full(len(n), side, np.int32)), names.take(pa.array((pair & 0xFFFFFFFF) - 1)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "side", "other", "n"])

    return run


def cells(common: Common):
    """For mapInArrow: PAIRS, summed, to ROWS, one for each part that asks for the pair."""
    known = len(common.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            word, own = common.numbers(b.column("word"))
            other, others = common.numbers(b.column("other"))
            many = np.where(word < known, common.side[np.minimum(word, known - 1)], 1)
            first = np.where(many > 1, common.first[np.minimum(word, known - 1)], common.hashes(own)[word] % common.parts)
            at = np.repeat(np.arange(len(word)), many)
            step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            place = (common.hashes(others)[other] % many)[at]
            part = first[at] + np.where((b.column("side").to_numpy() == BEHIND)[at], place * many[at] + step, step * many[at] + place)
            rare = other >= known
            strings = pa.concat_arrays([others, pa.nulls(1, pa.string())]).take(pa.array(np.where(rare, other - known, len(others))))
            take = pa.array(at)
            yield _rows(part, None, b.column("side").take(take), pa.array(np.where(rare, 0, other)[at]), strings.take(take), b.column("n").take(take))

    return run


def _alike(*ids: np.ndarray) -> np.ndarray:
    """Equal numbers, from 0, for rows that are equal in all ids (under 2**31)."""
    code = np.unique(ids[0], return_inverse=True)[1]
    for a in ids[1:]:
        code = np.unique((code.astype(np.int64) << 32) | a, return_inverse=True)[1]
    return code


def _total(of: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(of, n)[of].astype(np.int64)  # sums under 2**53 are exact


def scored(common: Common, keys: dict[str, pa.DataType], total: float):
    """For applyInArrow, by part: keys, k and the probability p of each word, from how often it, the word before it, both, the two before it and all three stand; total: of all words, and what is added to them.

    Equal threes of a blob are one before all are compared, so one that stands everywhere needs little memory."""
    known = len(common.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        pairs = t.filter(t.column("blob").is_null())
        blobs = t.column("blob").drop_null()
        strings, heads, sizes = [], [], [0]
        for b in blobs:
            _, (_, before, word, after), own = _unpack(b.as_buffer().to_pybytes(), 2 * len(keys), 4)
            same = _alike(before, word, after)
            at, n = np.unique(same, return_index=True)[1], np.bincount(same)
            shift = sum(map(len, strings))
            heads.append([np.where(a[at] < known, a[at], a[at] + shift) for a in (before, word, after)] + [n, same.astype(np.int32)])
            strings.append(own)
            sizes.append(sizes[-1] + len(at))
        if not heads:
            return
        strings.append(pairs.column("word").drop_null().cast(pa.string()).combine_chunks())
        coded = pa.concat_arrays([s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s for s in strings]).dictionary_encode()
        words = coded.dictionary
        # numbers of the group, so that equal words have one
        renumber = np.concatenate([np.arange(known), known + coded.indices.to_numpy(zero_copy_only=False)]).astype(np.int64)
        before, word, after = (renumber[np.concatenate([h[i] for h in heads])] for i in range(3))
        n = np.concatenate([h[3] for h in heads])
        same = [h[4] for h in heads]
        del heads
        c1 = np.where(word < known, common.counts[np.minimum(word, known - 1)], _total(np.maximum(word - known + 1, 0), n))
        both = _alike(word, after)
        c12, c21, c123 = _total(both, n), _total(_alike(word, before), n), _total(_alike(both, before), n)
        counts = np.concatenate([common.counts, np.zeros(len(words), np.int64)])
        if pairs.num_rows:
            other, side, times = (pairs.column(c).to_numpy().astype(np.int64) for c in ("other", "side", "n"))
            other[other == 0] = renumber[len(renumber) - np.count_nonzero(other == 0) :]
            counts[other[side == ALONE]] = times[side == ALONE]
            for k, out, of in ((BEHIND, c21, before), (BEFORE, c12, after)):
                some = np.flatnonzero(side == k)
                if len(some):  # a word in cells: its pairs go beyond them
                    some = some[np.argsort(other[some])]
                    at = np.flatnonzero(of > 0)
                    out[at] = times[some[np.searchsorted(other[some], of[at])]]
        b = 0.7 * c12 / c1 + 0.3 * ((counts[after] + 0.1) / total)
        three = 0.6 * c123 / c21
        p, first = np.where(before > 0, three + 0.4 * b, b), (c1 + 0.1) / total  # first: of a text's first word
        for i, blob in enumerate(blobs):
            own, (k, *_), _ = _unpack(blob.as_buffer().to_pybytes(), 2 * len(keys), 4)
            at = same[i] + sizes[i]
            begin, behind = np.flatnonzero(k == 0), np.flatnonzero(after[at] > 0)
            row = np.concatenate([begin, behind])
            columns = [pa.array(own[2 * j + 1][row], mask=own[2 * j][row] == 1).cast(kind) for j, kind in enumerate(keys.values())]
            columns += [pa.array(np.concatenate([np.zeros_like(begin), k[behind] + 1]).astype(np.int32)), pa.array(np.concatenate([first[at[begin]], p[at[behind]]]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "k", "p"])

    return run
