"""Packing documents into training sequences by the sum-of-squares rule.

A document's ids fill whole sequences first; what is left over is one item.
``levels[h]`` counts the open sequences that hold h tokens.  An item goes to
the fill level that makes the sum of the squared counts least (a new sequence
being level 0, and a full one leaving the array), ties to the fullest.  A task
packs its own rows, in order, as they come.

Memory bounds the open sequences: beyond ``MOST_OPEN``, which lengths that fit
one another don't reach, the emptier half is taken apart and its pieces are laid
end to end, cut where a sequence is full.  So are those left at the end of a
task, which therefore pads one sequence at most, and none if that sequence holds
a power of two.

A null or empty text is its end id alone.  Rows are packed one by one, repeated
rows too; doc_id is only carried along.  Ids of sequences are unique, and those
of one task follow each other.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusmill.llm import frames, tokens, vectext


#: Sequences that a task holds open, of at most 16 kB each.
MOST_OPEN = 4096


class Packer:
    """Pieces are (doc, start, ids, doc_tokens); a sequence that closes is handed to ``out`` as its list of pieces."""

    def __init__(self, capacity: int, out, most_open: int = MOST_OPEN):
        self.capacity, self.out, self.most_open = capacity, out, most_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.count = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        for start in range(0, n - c + 1, c):
            self.out([(doc, start, ids[start : start + c], n)])
        rest = n % c
        if rest:
            self._place((doc, n - rest, ids[n - rest :], n))

    def _place(self, piece: tuple) -> None:
        c, size = self.capacity, len(piece[2])
        levels = self.levels
        have = levels[: c - size + 1]
        cost = 2 * (levels[size:] - have) + 2  # from level h = 0 .. c - size to h + size
        cost[-1] = 1 - 2 * have[-1]  # full: nothing is left open
        cost[have == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * levels[size] + 1
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if h:
            pieces = self.open[h].pop()
            levels[h] -= 1
            self.count -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == c:
            self.out(pieces)
            return
        levels[h + size] += 1
        self.open.setdefault(h + size, []).append(pieces)
        self.count += 1
        if self.count > self.most_open:
            self._merge(self.most_open // 2)

    def _merge(self, n: int) -> None:
        """Takes the n emptiest open sequences apart and fills sequences with their pieces."""
        held: list = []
        filled = 0
        for h in np.flatnonzero(self.levels).tolist():
            while self.open.get(h) and n:
                n -= 1
                self.levels[h] -= 1
                self.count -= 1
                for doc, start, ids, total in self.open[h].pop():
                    while len(ids):
                        part = ids[: self.capacity - filled]
                        held.append((doc, start, part, total))
                        filled, start, ids = filled + len(part), start + len(part), ids[len(part) :]
                        if filled == self.capacity:
                            self.out(held)
                            held, filled = [], 0
        if held:
            self.levels[filled] += 1
            self.open.setdefault(filled, []).append(held)
            self.count += 1

    def close(self) -> None:
        self._merge(self.count)
        for h, sequences in self.open.items():
            for pieces in sequences:
                self.out(pieces)
                self.levels[h] -= 1
        self.open, self.count = {}, 0


def _pack(path: str, end_id: int, capacity: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 36
        rows: list[tuple] = []
        kind = None

        def out(pieces: list) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, offset, raw))
                offset += len(ids)
            number += 1

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.binary())], names)

        packer = Packer(capacity, out)
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            doc_ids = batch.column("doc_id").to_pylist()
            for block in vectext.blocks(batch.column("bytes"), limit=tokens.BLOCK):
                ids, counts = encode(block)
                at = 0
                for r, n in enumerate(counts.tolist(), block.first):
                    packer.add(doc_ids[r], np.append(ids[at : at + n], np.uint32(end_id)))
                    at += n
                if len(rows) > 500:
                    yield batch_of()
        packer.close()
        if rows:
            yield batch_of()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit)."""
    frames.arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select("doc_id", frames.text_bytes().alias("bytes")).mapInArrow(_pack(tokenizer, end_id, capacity), shape)
