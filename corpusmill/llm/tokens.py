"""Token ids of whole texts by a public tokenizer, with the encoder's work shared between equal chunks.

A chunk is a run of white space with the run of other characters after it.  A
cut is made only where ASCII white space follows a character that surely isn't
white space; no pre-token of the supported tokenizers (byte-level and word BPE)
spans such a place, so the ids of a text are those of its chunks in order.  Chunks of a block are told apart by
their bytes; each distinct one is encoded once and remembered by a worker.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from corpusmill.llm import vectext

#: A worker remembers the first distinct chunks it meets, up to so many and so many bytes; others for one block.
REMEMBERED, REMEMBERED_BYTES = 800_000, 16 << 20
BLOCK = 2 << 20
_SPACE = ~vectext.NOT_SPACE
_GRAPH = vectext.lookup_table(lambda b: 0x21 <= b <= 0x7E)
_TWO = vectext.lookup_table(lambda b: 0xC3 <= b <= 0xDF)
_THREE = vectext.lookup_table(lambda b: 0xE4 <= b <= 0xEF)
_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def chunks(block: vectext.Block, space: np.ndarray = _SPACE) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct chunks of a block, the number of each of its chunks in that list, and the row of each; space: the bytes that a cut is made before."""
    buf = block.buf
    after = np.zeros(len(buf), dtype=bool)
    after[1:] = _GRAPH[buf[:-1]]
    after[2:] |= (buf[1:-1] >= 0x80) & _TWO[buf[:-2]]
    after[3:] |= (buf[2:-1] >= 0x80) & (buf[1:-2] >= 0x80) & _THREE[buf[:-3]]
    cut = after & space[buf]
    cut[block.start] = True
    cut[block.end] = True  # what stands between two texts is a piece of its own
    edge = np.flatnonzero(cut)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(np.append(edge, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
    between = np.zeros(len(buf), dtype=bool)
    between[block.end] = True
    own = ~between[edge]
    _, ends, data = pieces.dictionary.buffers()
    at, raw = np.frombuffer(ends, dtype=np.int64, count=len(pieces.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
    return [raw[a:z] for a, z in zip(at, at[1:], strict=False)], pieces.indices.to_numpy()[own], np.searchsorted(block.start, edge[own], side="right") - 1


class Grown:
    """An array that values are appended to."""

    def __init__(self, dtype: type, first: tuple = ()):
        self.held, self.n = np.zeros(1 << 14, dtype=dtype), len(first)
        self.held[: self.n] = first

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


def runs(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after another."""
    return np.arange(int(lens.sum())) + np.repeat(start - (np.cumsum(lens) - lens), lens)


class Memory:
    """Numbers distinct chunks in the order they are met; ``learn`` computes what is kept of each new one, ``size`` and ``cut`` tell how much is kept and drop what came later."""

    most = 1 << 40  # of what is heavier than token ids, fewer are remembered

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.weight = 0
        self.passing: tuple[list[bytes], tuple] | None = None

    def learn(self, new: list[bytes]) -> None:
        raise NotImplementedError

    def size(self) -> tuple:
        raise NotImplementedError

    def cut(self, size: tuple) -> None:
        raise NotImplementedError

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        known = self.known
        if self.passing:
            for c in self.passing[0]:
                del known[c]
            self.cut(self.passing[1])
            self.passing = None
        new = [c for c in distinct if c not in known]
        if new:
            more = sum(map(len, new))
            if len(known) + len(new) > min(self.most, REMEMBERED) or self.weight + more > REMEMBERED_BYTES:
                self.passing = new, self.size()
            else:
                self.weight += more
            self.learn(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))


class Encoder(Memory):
    def __init__(self, path: str, plain: bool = False):
        """plain: the strings of special tokens are ordinary text."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if plain:
            self.tokenizer.encode_special_tokens = True
        super().__init__()
        self.ids, self.ends = Grown(np.uint32), Grown(np.int64, (0,))

    def size(self) -> tuple:
        return self.ids.n, self.ends.n

    def cut(self, size: tuple) -> None:
        self.ids.n, self.ends.n = size

    def ids_of(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, joined, and the number of each."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in new], add_special_tokens=False)]
        n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(n.sum())), n

    def learn(self, new: list[bytes]) -> None:
        flat, n = self.ids_of(new)
        self.ends.add(self.ids.n + np.cumsum(n))
        self.ids.add(flat)

    def encode(self, block: vectext.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts, joined, and how many each text has."""
        distinct, of, row = chunks(block)
        at = self.numbers(distinct)[of]
        start = self.ends.held[at]
        lens = self.ends.held[at + 1] - start
        return self.ids.held[runs(start, lens)], np.bincount(row, weights=lens, minlength=len(block)).astype(np.int64)
