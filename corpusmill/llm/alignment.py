"""Alignment of the token boundaries of two tokenizers, and how often their tokens are linked.

A byte-level BPE (A) reads a space and the text; a piece model (B), which adds
that space itself, reads the text.  Every byte gets a label: n where no token
ends, a or b where one of A or B does, c where both do.  A regular expression
scans the labels for spans up to each c; the labels in a span count the tokens of
its group.  Between two neighbouring ends lies one token of A and one of B, so
the labelled places are the links: all pairs of tokens whose byte ranges
overlap.

Labels are made for distinct chunks, cut before spaces (``tokens.chunks``;
neither tokenizer has a token across such a cut).  Links are counted over the corpus by pairs of ids: each
block of texts keeps a list of its distinct pairs, those lists are counted,
joined with the counts, and brought back to the block; neither pairs nor counts
pass through the driver.  The highest count of each B id, at most one row for
each entry of B's vocabulary, is the only table that is broadcast.

Special tokens' strings are plain text.  A text that is null or empty, or whose
tokens' joined bytes differ from a space and the text, has no tokens: zeros, and
an empty groups_sha256.  Rows are kept one by one, so repeated doc_ids and ties
are as many rows; an empty table gives none.  A text of any length is handled
whole.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import frames, tokens, vectext
from corpusmill.llm.bpe import TokenBytes, token_bytes

#: Bytes of text that share a list of pairs.
BLOCK = 2 << 20
_GROUP = re.compile(rb"[nab]*c")
_LABELS = np.frombuffer(b"nabc", dtype=np.uint8)
_SPACE = np.arange(256) == 0x20
_OPEN: dict[tuple[str, str], Aligner] = {}
_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


class Pieces:
    """A piece model's ids, and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in named):
            raise ValueError("pieces that hold a space after other characters cannot be told apart by chunks")
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)])
        self.space = self.model.piece_to_id("▁")

    def ids_of(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, joined, and the number of each; chunks begin with a space, which the model adds itself."""
        got = self.model.encode([c[1:].decode("utf-8", "replace") for c in new], num_threads=1)
        got = [ids if len(c) > 1 else [self.space] for c, ids in zip(new, got, strict=True)]
        n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter(chain.from_iterable(got), dtype=np.int64, count=int(n.sum())), n


def spells(table: TokenBytes, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the tokens of each chunk, n by n, have the bytes of that chunk, size by size."""
    end = np.cumsum(np.append(0, table.size[ids]))[np.cumsum(n)]
    same = np.diff(end, prepend=0) == size
    told, asked = table.join(ids[np.repeat(same, n)]), raw[np.repeat(same, size)]
    wrong = np.cumsum(np.append(0, told != asked))[np.cumsum(size[same])]
    same[same] = np.diff(wrong, prepend=0) == 0
    return same


def links(labels: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ends, and the A and B id between each end and the one before."""
    at = np.flatnonzero(labels != _LABELS[0])
    ends_a, ends_b = np.isin(labels[at], _LABELS[[1, 3]]), np.isin(labels[at], _LABELS[[2, 3]])
    return at, a_ids[np.cumsum(ends_a) - ends_a], b_ids[np.cumsum(ends_b) - ends_b]


class Aligner(tokens.Memory):
    """What is kept of a chunk: numbers of tokens, groups and links (-1 tokens: the bytes differ), the pairs, the groups as printed."""

    most = 250_000

    def __init__(self, a: str, b: str):
        self.a, self.b = tokens.Encoder(a, plain=True), Pieces(b)
        self.a_bytes, self.b_bytes = token_bytes(a), self.b.bytes
        self.n_b = len(self.b_bytes.size) - 1
        super().__init__()
        self.counts = {c: tokens.Grown(np.int64) for c in _COLUMNS}
        self.pairs, self.ends, self.printed = tokens.Grown(np.int64), tokens.Grown(np.int64, (0,)), []

    def size(self) -> tuple:
        return len(self.printed), self.pairs.n, self.ends.n

    def cut(self, size: tuple) -> None:
        n, self.pairs.n, self.ends.n = size
        del self.printed[n:]
        for c in _COLUMNS:
            self.counts[c].n = n

    def learn(self, new: list[bytes]) -> None:
        size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        raw = np.frombuffer(b"".join(new), dtype=np.uint8)
        (a_ids, n_a), (b_ids, n_b) = self.a.ids_of(new), self.b.ids_of(new)
        good = spells(self.a_bytes, a_ids, n_a, raw, size) & spells(self.b_bytes, b_ids, n_b, raw, size)
        a_ids, b_ids, bound = a_ids[np.repeat(good, n_a)].astype(np.int64), b_ids[np.repeat(good, n_b)], np.cumsum(size[good])
        kind = np.zeros(int(bound[-1]) if len(bound) else 0, dtype=np.int64)
        kind[np.cumsum(self.a_bytes.size[a_ids]) - 1] |= 1
        kind[np.cumsum(self.b_bytes.size[b_ids]) - 1] |= 2
        labels = _LABELS[kind]
        stop = np.array([m.end() for m in _GROUP.finditer(labels.tobytes())], dtype=np.int64)  # groups; each chunk ends with one
        a_said, b_said = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        said, a0, b0 = [], 0, 0
        for a1, b1 in zip(np.cumsum(kind & 1)[stop - 1].tolist(), np.cumsum(kind >> 1)[stop - 1].tolist(), strict=True):
            said.append(f"{a_said[a0]}|{b_said[b0]}" if a1 - a0 == b1 - b0 == 1 else ",".join(a_said[a0:a1]) + "|" + ",".join(b_said[b0:b1]))
            a0, b0 = a1, b1
        at, left, right = links(labels, a_ids, b_ids)
        group_end = np.searchsorted(stop, bound, side="right")
        table = {"n_a": np.where(good, n_a, -1), "n_b": np.where(good, n_b, 0)}
        for c, ends in (("n_groups", group_end), ("n_links", np.searchsorted(at, bound))):
            table[c] = np.zeros(len(new), dtype=np.int64)
            table[c][good] = np.diff(ends, prepend=0)
        printed = iter(zip(np.append(0, group_end[:-1]).tolist(), group_end.tolist(), strict=True)) if len(bound) else iter(())
        self.printed += [";".join(said[slice(*next(printed))]) if ok else "" for ok in good.tolist()]
        self.ends.add(self.pairs.n + np.cumsum(table["n_links"]))
        self.pairs.add(left * self.n_b + right)
        for c in _COLUMNS:
            self.counts[c].add(table[c])


def _opened(a: str, b: str) -> Aligner:
    if (a, b) not in _OPEN:
        _OPEN[a, b] = Aligner(a, b)
    return _OPEN[a, b]


def _align(a: str, b: str):
    """doc_id, the counts, groups_sha256, block; links: the text's distinct pairs as steps in the block's list, and how often each; in a block's first row that list and its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _opened(a, b), TaskContext.get()
        number = (task.partitionId() if task else 0) << 36
        for batch in batches:
            for block in vectext.blocks(pa.array([b" " + t if t else b"" for t in batch.column("bytes").to_pylist()], pa.large_binary()), limit=BLOCK):
                distinct, of, row = tokens.chunks(block, _SPACE)
                at = aligner.numbers(distinct)[of]
                bad = np.isin(np.arange(len(block)), row[aligner.counts["n_a"].held[at] < 0])
                own = ~bad[row]
                at, row = at[own], row[own]
                counts = [np.bincount(row, weights=aligner.counts[c].held[at], minlength=len(block)).astype(np.int64) for c in _COLUMNS]
                start = aligner.ends.held[at]
                n = aligner.ends.held[at + 1] - start
                pairs, of_pair = np.unique(aligner.pairs.held[tokens.runs(start, n)], return_inverse=True)
                till, chunk_till = np.cumsum(counts[3]).tolist(), np.searchsorted(row, np.arange(len(block)), side="right").tolist()
                printed, shas, held = aligner.printed, [], []
                z0 = c0 = 0
                for z, c in zip(till, chunk_till, strict=True):
                    some, often = np.unique(of_pair[z0:z], return_counts=True)
                    held.append(np.concatenate((np.diff(some, prepend=0), often)).astype("<u4").tobytes())
                    shas.append(hashlib.sha256(";".join([printed[k] for k in at[c0:c].tolist()]).encode()).hexdigest() if c > c0 else "")
                    z0, c0 = z, c
                lists = [[x, *[None] * (len(block) - 1)] for x in (pairs, np.bincount(of_pair, minlength=len(pairs)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)), *map(pa.array, counts), pa.array(shas), pa.array([number] * len(block), pa.int64()), pa.array(held, pa.binary()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]],
                    ["doc_id", *_COLUMNS, "groups_sha256", "block", "links", "pairs", "often"],
                )
                number += 1

    return run


def _weigh(texts: pa.Table, found: pa.Table) -> pa.Table:
    """The links of a block's texts, by the counts of its pairs in ascending order."""
    names = ["doc_id", *_COLUMNS, "n_best", "count_sum", "groups_sha256"]
    found = found.sort_by("pair")
    count = found.column("n").to_numpy()
    best = found.column("best").to_numpy(zero_copy_only=False).astype(bool)
    n_best, total = [], []
    for raw in texts.column("links").to_pylist():
        some, often = np.frombuffer(raw, dtype="<u4").astype(np.int64).reshape(2, -1)
        some = np.cumsum(some)
        n_best.append(int(often[best[some]].sum()))
        total.append(int((often * count[some]).sum()))
    return texts.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).select(names)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    frames.arrow_batches(docs.sparkSession, 4000, "8m")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = "".join(f", {c} long" for c in _COLUMNS)
    made = frames.cut(docs.select("doc_id", frames.text_bytes().alias("bytes")).mapInArrow(_align(a, b), f"doc_id {kind}{counts}, groups_sha256 string, block long, links binary, pairs array<long>, often array<long>"))
    lists = made.where(F.col("pairs").isNotNull())
    n_b = len(Pieces(b).bytes.size) - 1
    counted = frames.cut(lists.select(F.explode(F.arrays_zip("pairs", "often")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.often").alias("n")))
    highest = counted.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))  # a row for each B id at most
    known = counted.withColumn("b", F.col("pair") % n_b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    found = lists.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(known, "pair")
    texts = made.drop("pairs", "often")
    shape = f"doc_id {kind}{counts}, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_weigh, shape)
