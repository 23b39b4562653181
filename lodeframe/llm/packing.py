"""Packing documents into token windows: sum-of-squares online packing.

A document's ids, and one closing id, are cut at every `window` ids; full pieces are
sequences of their own. The rest goes where the sum of squared counts of open
sequences by fill level becomes least; the counts stand in a level array, so a
placement looks at `window` levels whatever the number of sequences. When more than
`most_open` sequences are open, and at the end, the open ones are laid end to end and
cut anew at every `window` ids. What is left at the very end becomes sequences of
falling powers of two, which need no padding.

Each task packs the rows it reads, in their order, as a stream: nothing is shuffled,
no window waits for another task, and a lost task is packed anew from its input.
Sequence ids hold the task's number. Memory: the ids of at most `most_open` sequences.

Defined cases: a null or empty text is the closing id alone; null ids and repeated rows
are packed like any other row; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.tokens import tokens

WINDOW, CLOSING = 2048, 1
#: sequence ids of one task
RANGE = 1 << 36


class SumOfSquares:
    """Levels of open sequences. place() gives a sequence's number; pieces are what the caller hands in."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.held: dict[int, list] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def choose(self, length: int) -> int:
        """The level after whose use the sum of squares is least; of equals the fullest."""
        n, top = self.counts, self.window - length
        change = 2 * (n[length:] - n[: top + 1]) + 2
        change[0] -= 1
        if top:
            change[top] -= 1
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, length: int, piece: object) -> tuple[int, list] | None:
        """Put in a piece shorter than the window; if its sequence is full, (number, its pieces)."""
        level = self.choose(length)
        if level:
            s = self.at[level].pop()
            self.counts[level] -= 1
        else:
            s = self.new()
            self.held[s] = []
        self.held[s].append(piece)
        if level + length == self.window:
            return s, self.held.pop(s)
        self.at[level + length].append(s)
        self.counts[level + length] += 1
        return None

    def clear(self) -> list:
        """All pieces of open sequences, the fullest sequence first; none is open then."""
        out = [p for level in range(self.window, 0, -1) for s in self.at[level] for p in self.held[s]]
        self.counts[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.held = {}
        return out


class Packer:
    """Rows of pieces: (document, start, length, crc32, document's ids, sequence, offset)."""

    def __init__(self, window: int, most_open: int, base: int):
        self.bins, self.window, self.most_open, self.base = SumOfSquares(window), window, most_open, base
        self.rows: list[tuple] = []

    def _emit(self, seq: int, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.base + seq, at))
            at += len(ids)

    def add(self, doc: object, ids: np.ndarray) -> None:
        ids = np.ascontiguousarray(ids, dtype="<u4")
        full = len(ids) // self.window * self.window
        for a in range(0, full, self.window):
            self._emit(self.bins.new(), [(doc, a, ids[a : a + self.window], len(ids))])
        if full < len(ids):
            done = self.bins.place(len(ids) - full, (doc, full, ids[full:].copy(), len(ids)))
            if done:
                self._emit(*done)
            if len(self.bins.held) > self.most_open:
                self.relay()

    def relay(self, last: bool = False) -> None:
        """Lay the open pieces end to end and cut them anew."""
        left = self.bins.clear()
        size = sum(len(p[2]) for p in left)
        room = [self.window] * (size // self.window)
        rest = size % self.window
        if last:
            room += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        left.reverse()
        for n in room:
            pieces = []
            while n:
                doc, start, ids, total = left.pop()
                pieces.append((doc, start, ids[:n], total))
                if len(ids) > n:
                    left.append((doc, start + n, ids[n:], total))
                n -= len(pieces[-1][2])
            self._emit(self.bins.new(), pieces)
        if not last and left:  # less than a window
            for doc, start, ids, total in reversed(left):
                self.bins.place(len(ids), (doc, start, ids, total))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, window: int = WINDOW, closing: int = CLOSING, path: str | None = None, most_open: int = 2048) -> DataFrame:
    """Of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row a piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer, id_type = tokens(path), Packer(window, most_open, TaskContext.get().partitionId() * RANGE), None

        def out() -> Iterator[pa.RecordBatch]:
            if rows := packer.take():
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        end = np.array([closing], dtype=np.uint32)
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                packer.add(doc, np.concatenate((tok.ids(text.as_py() or ""), end)))
            yield from out()
        packer.relay(last=True)
        yield from out()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
