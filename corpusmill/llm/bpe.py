"""Byte-level BPE encoding and decoding by an index of pair occurrences.

The words (pre-tokens) of a partition's distinct chunks are laid end to end as
symbols, one for each byte, linked to their neighbours.  An index maps each
pair that has a merge rank to all its positions.  Active ranks are taken in
ascending order; all occurrences of the pair are merged at once, and the pairs
that this makes with the neighbours are put into the lists of their ranks.  A
merge can only make pairs of higher rank (checked when a vocabulary is read), so
one ascending sweep gives what merging word by word would.  Entries that a merge
has outdated are left out when their rank's turn comes.

Which bytes form a word, and which strings are special tokens, is as the
tokenizer file says; a special token's string in a text is that token.  Ids are
stored as little-endian unsigned 32-bit integers.  Decoding joins the tokens'
bytes; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary are
skipped.

A null text is empty and has no ids; null ids decode to the empty text.  Rows
are independent, so repeated doc_ids, ties and any order are kept as they are,
and an empty table gives none.  A text of any length is one unit of work whose
memory grows with its distinct chunks.  Columns other than doc_id, text and ids
are not returned.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm import frames, tokens, vectext

#: Bytes of text whose chunks are indexed together.
BLOCK = 4 << 20
#: A word of its own by any of the supported vocabularies' rules.
_PLAIN = re.compile(rb" ?[A-Za-z]+")
_OPEN: dict[str, tuple[PairEncoder, TokenBytes]] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is a visible Latin-1 character, else the next from U+0100."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Merges:
    """Pairs by rank, and the ranks of pairs as a sorted list."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        self.left, self.right, self.made = pairs[:, 0], pairs[:, 1], made
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        born = np.full(int(max(pairs.max(initial=0), made.max(initial=0))) + 1, -1, dtype=np.int64)
        born[made] = np.arange(len(made))
        rank = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (born[self.left] >= rank).any() or (born[self.right] >= rank).any():
            raise ValueError("a merge uses a token that a later merge makes: ascending ranks would not give the tokenizer's ids")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where a pair has none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def apply(self, symbol: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of the symbols, and where each stood; last: marks the last symbol of each word."""
        n = len(symbol)
        symbol = np.append(symbol, -1).astype(np.int64)
        after = np.arange(1, n + 1)
        after[last] = n  # no neighbour: a place that holds no symbol
        before = np.append(np.arange(-1, n - 1), n)
        before[np.append(True, last[:-1]).nonzero()[0]] = n
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            """Puts pairs that start at these places into their ranks' lists."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            has = rank >= 0
            at, rank = at[has], rank[has]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, a, z in zip(rank[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(at[a:z])

        if n and len(self.keys):
            index(np.flatnonzero(~last))
        while active:
            r = heapq.heappop(active)
            left, right = self.left[r], self.right[r]
            at = _distinct(np.concatenate(lists.pop(r)))
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:  # of pairs that share a symbol, every other one from the left
                place = np.arange(len(at))
                opens = np.append(True, after[at[:-1]] != at[1:])
                at = at[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = self.made[r], -1
            after[at] = after[gone]
            before[after[at]] = at
            side = before[at]
            index(_distinct(np.concatenate((side[side < n], at))))
        kept = np.flatnonzero(symbol[:n] >= 0)
        return symbol[kept], kept


class PairEncoder(tokens.Encoder):
    """The encoder of ``tokens`` with merges of its own."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        options = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        letters = byte_letters()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or options or not all(c in vocab for c in letters):
            raise ValueError("only a byte-level BPE without normalizer and further options is encoded here")
        if spec["pre_tokenizer"].get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("prefix spaces and special tokens that take in their surroundings are not encoded here")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(np.array([[vocab[a], vocab[b]] for a, b in pairs], dtype=np.int64).reshape(-1, 2), np.array([vocab[a + b] for a, b in pairs], dtype=np.int64))
        self.symbols = np.zeros(max(map(ord, letters)) + 1, dtype=np.int64)
        self.symbols[[ord(c) for c in letters]] = [vocab[c] for c in letters]
        self.space = next(c for c, b in letters.items() if b == 0x20)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        super().__init__(path)
        self.words = self.tokenizer.pre_tokenizer.pre_tokenize_str

    def ids_of(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        spelled: list[str] = []  # words of byte letters; None: a special token
        fixed: dict[int, int] = {}
        count = np.zeros(len(new), dtype=np.int64)
        for i, raw in enumerate(new):
            if _PLAIN.fullmatch(raw):
                spelled.append(raw.decode().replace(" ", self.space))
                count[i] = 1
                continue
            text, had, at = raw.decode("utf-8", "replace"), len(spelled), 0
            for m in self.split.finditer(text) if self.split else ():
                spelled += [w for w, _ in self.words(text[at : m.start()])]
                fixed[len(spelled)] = self.special[m[0]]
                spelled.append("\0")
                at = m.end()
            spelled += [w for w, _ in self.words(text[at:] if at else text)]
            count[i] = len(spelled) - had
        lens = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
        ends = np.cumsum(lens)
        symbol = self.symbols[np.frombuffer("".join(spelled).encode("utf-32-le"), dtype="<u4")]
        symbol[[ends[k] - 1 for k in fixed]] = list(fixed.values())
        last = np.zeros(len(symbol), dtype=bool)
        last[ends - 1] = True
        ids, at = self.merges.apply(symbol, last)
        bound = np.append(0, ends)[np.append(0, np.cumsum(count))]  # where each chunk's symbols begin
        return ids.astype(np.uint32), np.diff(np.searchsorted(at, bound))


class TokenBytes:
    """The bytes of each token, one after another; ids outside the vocabulary have none."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([*map(len, raw), 0], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        ids = np.minimum(ids, len(self.size) - 1).astype(np.int64)
        return self.pool[tokens.runs(self.start[ids], self.size[ids])]


def token_bytes(path: str) -> TokenBytes:
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    letters = byte_letters()
    known = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    told = [known.get(i, "") for i in range(max(known, default=-1) + 1)]
    return TokenBytes([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in told])


def _opened(path: str) -> tuple[PairEncoder, TokenBytes]:
    if path not in _OPEN:
        _OPEN[path] = PairEncoder(path), token_bytes(path)
    return _OPEN[path]


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _opened(tokenizer)[0]
        for batch in batches:
            for block in vectext.blocks(batch.column("bytes"), limit=BLOCK):
                ids, counts = encoder.encode(block)
                raw, ends = ids.astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(counts))
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(block)), pa.array(counts), column.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _opened(tokenizer)[1]
        for batch in batches:
            said = [table.join(np.frombuffer(raw or b"", dtype="<u4")).tobytes().decode("utf-8", "replace") for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, "text"])

    return run


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    frames.arrow_batches(docs.sparkSession, 4000, "8m")
    return docs.select("doc_id", frames.text_bytes().alias("bytes")), docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each text: doc_id, n_tokens, and ids (little-endian unsigned 32-bit)."""
    rows, kind = _texts(docs)
    return rows.mapInArrow(_encode(tokenizer), f"doc_id {kind}, n_tokens long, ids binary")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of encode() with the decoded ``text``."""
    frames.arrow_batches(coded.sparkSession, 4000, "8m")
    coded = coded.select("doc_id", "n_tokens", "ids")
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(_decode(tokenizer), f"doc_id {kind}, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """decode(encode(docs)) in one pass: doc_id, n_tokens, ids and the text decoded from them."""
    rows, kind = _texts(docs)
    first, second = _encode(tokenizer), _decode(tokenizer)
    return rows.mapInArrow(lambda batches: second(first(batches)), f"doc_id {kind}, n_tokens long, ids binary, text string")
