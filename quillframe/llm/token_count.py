"""Token counts of a SentencePiece byte-pair model, by heap-and-linked-list merging.

Symbols of a unit stand in a linked list; a heap gives the adjacent pair whose
concatenation has the best rank, the leftmost of equals. A unit's count is its
initial symbols minus the merges, plus the extra bytes of symbols that the
vocabulary lacks (byte fallback). No identifier is made.

Merges cannot cross a place where no piece of the vocabulary has the two
characters side by side, so a text is cut before each run of word marks, at line
breaks and at such places, and the count of each distinct unit is kept in a
bounded table.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillframe.llm.common import map_batches

MARK = "▁"
#: Entries of the table of unit counts; it is emptied when full, which changes no result.
MEMO = 700_000
#: Longer units are counted each time, so that the table stays small.
MEMO_CHARS = 64


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """Ranks of a byte-pair vocabulary with byte fallback, as its model file gives them."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            raw = f.read()
        self.cost: dict[str, float] = {}
        byte_pieces, trainer, normalizer = 0, {}, {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                if kind == 6:
                    byte_pieces += 1
                elif kind == 1:
                    self.cost[piece[1].decode()] = -struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                elif kind not in (2, 3):
                    raise ValueError(f"pieces of kind {kind} are not supported")
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or byte_pieces != 256:
            raise ValueError("a byte-pair model with byte fallback is needed")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or normalizer.get(6):
            raise ValueError("only the identity normalizer with a leading mark is supported")
        if any(MARK in p.lstrip(MARK) for p in self.cost):
            raise ValueError("pieces with a mark inside are not supported")
        #: Characters that stand side by side in some piece; merges cross no other place.
        self.pairs = {p[i : i + 2] for p in self.cost for i in range(len(p) - 1)}
        self.known = {p for p in self.cost if len(p) == 1}
        self.line_break = not any("\n" in p for p in self.cost)
        self.memo = _Memo(self)

    def unit(self, u: str) -> int:
        """Tokens of a unit on its own. A symbol is u[i:end[i]]; end is 0 where no symbol starts any more."""
        n, get, pop, push = len(u), self.cost.get, heapq.heappop, heapq.heappush
        end, before = [*range(1, n + 1)], [*range(-1, n)]
        heap = [(c, i, i + 2) for i in range(n - 1) if (c := get(u[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if not 0 < j < n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            merges += 1
            if stop < n:
                before[stop] = i
                if (c := get(u[i : (k := end[stop])])) is not None:
                    push(heap, (c, i, k))
            if i and (c := get(u[(h := before[i]) : stop])) is not None:
                push(heap, (c, h, stop))
        if self.known.issuperset(u):
            return n - merges
        return n - merges + sum(len(u[i].encode()) - 1 for i in range(n) if end[i] == i + 1 and u[i] not in self.known)

    def count(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        get = self.memo.__getitem__
        total = 0
        for k, line in enumerate(text.split("\n") if self.line_break else [text]):
            marked = line.replace(" ", MARK)
            if k:
                total += 1
            else:
                marked = MARK + marked
            if MARK + MARK in marked:
                total += sum(map(get, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)))
                continue
            head, *units = marked.split(MARK)
            if head:
                total += get(head)
            total += sum(map(self.memo.marked.__getitem__, units))
        return total


class _Memo(dict):
    """Counts of units; .marked has those of units that follow a mark, by what follows."""

    def __init__(self, model: PieceModel, prefix: str = "", plain: _Memo | None = None):
        super().__init__()
        self.model, self.prefix = model, prefix
        self.plain = self if plain is None else plain
        if plain is None:
            self.marked = _Memo(model, MARK, self)

    def __missing__(self, unit: str) -> int:
        u, pairs, skip = self.prefix + unit, self.model.pairs, len(self.prefix)
        cuts = [i for i in range(skip + 1, len(u)) if u[i - 1 : i + 1] not in pairs]  # no merge crosses these
        if cuts:
            n = self[u[skip : cuts[0]]] + sum(self.plain[u[i:j]] for i, j in zip(cuts, [*cuts[1:], len(u)], strict=True))
        else:
            n = self.model.unit(u)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[unit] = n
        return n


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model, once for each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs; no shuffle.

    model: a file name that vocabulary() finds on each executor, or a path that has a slash.
    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; rows that repeat
    come out as often as they come in; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model if "/" in model else vocabulary(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [m.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
