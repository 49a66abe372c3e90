"""Sum-of-squares online packing of token ids into windows of equal length."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_arrow, small_batches
from .tokens import encoder

Piece = tuple[int | None, int, int, np.ndarray]  # document, its ids before the piece, all its ids, the piece's ids


class LevelPacker:
    """Windows of `length` ids, the open ones kept by fill level.

    count[h] is the number of open windows with h ids.  A remainder of r ids goes to the level h (0: a new
    window) at which the sum of count[h]**2 over partly filled levels becomes least; ties go to the fullest.
    Full stretches of a document need no choice and become windows of their own.  When more than most_open
    windows are open, and at the end, the open windows' pieces are laid one after another and cut at the
    window length, which leaves less than one window; at the end that is cut into powers of two.
    So every id is in exactly one piece, no window needs padding, and memory is bounded by most_open.
    """

    def __init__(self, length: int, emit: Callable[[list[Piece]], None], most_open: int = 4096):
        self.length, self.emit, self.most_open = length, emit, most_open
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(length)]
        self.n_open = 0

    def level(self, r: int) -> int:
        """The level that r ids join."""
        c, n = self.count, self.length
        to = c[r : n + 1] * 2 + 1
        to[-1] = 0  # a full window is not counted any more
        cost = to
        cost[1:] -= c[1 : n - r + 1] * 2 - 1
        cost[1:][c[1 : n - r + 1] == 0] = np.iinfo(np.int64).max
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, total = self.length, len(ids)
        full = total - total % n
        for s in range(0, full, n):
            self.emit([(doc, s, total, ids[s : s + n])])
        if r := total - full:
            self._place((doc, full, total, ids[full:]), r)
            if self.n_open > self.most_open:
                self.close(False)

    def _place(self, piece: Piece, r: int) -> None:
        h = self.level(r)
        window = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        window.append(piece)
        self._put(window, h + r)

    def _put(self, window: list[Piece], fill: int) -> None:
        if fill == self.length:
            self.emit(window)
        else:
            self.open[fill].append(window)
            self.count[fill] += 1
            self.n_open += 1

    def close(self, last: bool = True) -> None:
        """Lay the open windows one after another; last: also what then remains."""
        rest = [p for level in reversed(self.open) for w in level for p in w]
        self.open = [[] for _ in range(self.length)]
        self.count[:] = 0
        self.n_open = 0
        left = sum(len(p[3]) for p in rest)
        window, fill, room = [], 0, 0
        for doc, start, total, ids in rest:
            while len(ids):
                if not fill:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1) if last else left
                k = min(room - fill, len(ids))
                window.append((doc, start, total, ids[:k]))
                start, ids, fill, left = start + k, ids[k:], fill + k, left - k
                if fill == room:
                    if room == self.length or last:
                        self.emit(window)
                    else:
                        self._put(window, fill)
                    window, fill = [], 0


def pack(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, length: int = 1024, with_ids: bool = True, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents packed into sequences of at most `length` ids, one row a piece.

    A document's ids are its whole text's by the given vocabulary (a path and kind, see tokens.py) and then
    end_id; a null or empty text has end_id alone.  Columns: doc_id, start (the document's ids before the
    piece), length, ids_crc32 (unsigned, of little-endian 32-bit ids), doc_tokens, sequence_id, offset (in
    its sequence, gapless from 0), and ids unless with_ids is False.  Each input partition is packed where
    it is read, in its order: no shuffle; sequence_id is unique over all.  Rows with a null or repeated
    doc_id are packed like any others; an empty table gives none.  Other columns are ignored.
    """
    key = docs.schema[doc_col].dataType.simpleString()
    kinds = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary, kind).ids
        base, made = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        end = np.array([end_id], np.int32)
        schema = None

        def emit(window: list[Piece]) -> None:
            nonlocal made
            at = 0
            for doc, start, total, ids in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + made, at, *([ids] if with_ids else [])))
                at += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        packer = LevelPacker(length, emit)
        for batch in small_batches(batches, "text"):
            if schema is None:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
                schema = pa.schema(list(zip(names, [batch.schema.field("doc_id").type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids, strict=True)))
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.concatenate([ids_of(text), end]) if text else end)
            if len(rows) >= (500 if with_ids else 10_000):
                yield flush()
        packer.close()
        if rows:
            yield flush()

    return map_arrow(docs.select(docs[doc_col].alias("doc_id"), docs[text_col].alias("text")), run, kinds)
