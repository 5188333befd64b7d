"""Document fingerprints: a Merkle tree of sections, paragraphs and passages.

Sections are separated by blank lines, paragraphs by line breaks.  A paragraph
falls into passages, cut after words whose hash is a multiple of ``spread``, so
that an edit moves no cut elsewhere.  A leaf is the digest of a passage with its
separators; a paragraph, a section and the root are digests of the ordered
digests below them (BLAKE2b of 128 bits, personalised by level).  Equal texts have equal roots; where roots differ, only
branches that differ are followed, down to the passages (``edits``).

The printed form is the root (32 hex digits, zeros for an empty text), a colon, and base64 of the
shape's size, the shape (number of sections, the paragraphs of each, the
passages of each paragraph, the length of each passage) and 4 bytes of digest
for each passage.  Only
this form is compared: likeness is 1 for equal roots, else the share of bytes in
sections that both have, in paragraphs of the other sections, and in passages of
the other paragraphs (as multisets).

A null text is empty; two empty texts are alike (1), an empty one and any other
are not (0).  Rows are put in descending order of doc_id (nulls last, ties by
text); the next of the last row is the first.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import frames, vectext
from corpusmill.llm.vectext import U64, mix

SPREAD = 6
#: Hex digits of a root.
ROOT = 32
_WORD = vectext.NOT_SPACE & (np.arange(256) > 0)


def _fold(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each run of hashes, in order; only tells branches of two printed forms apart."""
    n = np.diff(np.concatenate((first, [len(h)])))
    pos = np.arange(len(h)) - np.repeat(first, n)
    return mix(np.add.reduceat(h * vectext.places(int(n.max()))[pos], first) + n.astype(U64))


def _digests(parts: Iterable[bytes], level: bytes) -> list[bytes]:
    return [hashlib.blake2b(x, digest_size=ROOT // 2, person=level).digest() for x in parts]


def _above(below: list[bytes], first: np.ndarray, level: bytes) -> list[bytes]:
    """Digests of runs of digests."""
    at = [*first.tolist(), len(below)]
    return _digests((b"".join(below[a:z]) for a, z in zip(at, at[1:], strict=False)), level)


def _varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the size of each value: 7 bits a byte, low bits first, high bit: more follow."""
    v = values.astype(U64)
    size = np.maximum(1, -(-np.frexp(v.astype(np.float64))[1] // 7)).astype(np.int64)
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    out = (np.repeat(v, size) >> (step * 7).astype(U64) & U64(127)).astype(np.uint8)
    out[step < np.repeat(size, size) - 1] |= 128
    return out, size


def _values(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128) + 1
    first = np.concatenate(([0], ends[:-1]))
    step = np.arange(len(raw)) - np.repeat(first, ends - first)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * step), first)


def fingerprints(texts: list[bytes], spread: int = SPREAD) -> list[str]:
    """The printed form of each text's tree; all trees of the list are built together, level by level."""
    block = vectext.Block(texts, 0, sep=b"\x00")
    buf = block.buf
    words = vectext.Words(block, _WORD, buf=buf)
    marks = np.zeros(len(buf) + 1, dtype=bool)
    marks[words.end[words.hash % U64(spread) == 0]] = True  # a passage ends after such a word
    marks[np.flatnonzero(buf == 10) + 1] = True  # and after a line break
    marks[block.start] = True
    marks[block.end] = False
    start = np.flatnonzero(marks)
    if not len(start):
        return ["0" * ROOT + ":"] * len(texts)
    doc = np.searchsorted(block.start, start, side="right") - 1
    end = np.minimum(np.concatenate((start[1:], [len(buf)])), block.end[doc])
    whole = buf.tobytes()
    leaf = _digests((whole[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)), b"passage")
    closes = buf[end - 1] == 10
    opens = np.concatenate(([True], doc[1:] != doc[:-1]))
    first = np.flatnonzero(opens | np.concatenate(([True], closes[:-1])))  # first passage of each paragraph
    para = _above(leaf, first, b"paragraph")
    blank = closes[first] & (end[first] - start[first] == 1)
    at = np.flatnonzero(opens[first] | np.concatenate(([True], blank[:-1])))  # first paragraph of each section
    section = _above(para, at, b"section")
    roots = np.flatnonzero(opens[first][at])
    root = _above(section, roots, b"root")
    size = end - start
    per_para = np.diff(np.concatenate((first, [len(leaf)])))
    per_section = np.diff(np.concatenate((at, [len(first)])))
    of_doc = np.concatenate((roots, [len(at)]))
    of_para = np.concatenate((at, [len(first)]))[of_doc]
    of_leaf = np.concatenate((first, [len(leaf)]))[of_para]
    short = np.frombuffer(b"".join(x[:4] for x in leaf), dtype="<u4")
    shapes = []
    for i in range(len(roots)):
        shapes += [of_doc[i + 1 : i + 2] - of_doc[i], per_section[of_doc[i] : of_doc[i + 1]], per_para[of_para[i] : of_para[i + 1]], size[of_leaf[i] : of_leaf[i + 1]]]
    raw, sizes = _varint(np.concatenate(shapes))
    values = 1 + np.diff(of_doc) + np.diff(of_para) + np.diff(of_leaf)
    till = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(values)))]
    out = ["0" * ROOT + ":"] * len(texts)
    for i, r in enumerate(doc[of_leaf[:-1]].tolist()):
        shape = raw[till[i] : till[i + 1]].tobytes()
        body = len(shape).to_bytes(4, "little") + shape + short[of_leaf[i] : of_leaf[i + 1]].tobytes()
        out[r] = f"{root[i].hex()}:{base64.b64encode(body).decode()}"
    return out


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs of each section, passages of each paragraph, passage lengths and hashes."""
    body = base64.b64decode(fingerprint[ROOT + 1 :])
    if not body:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint32)
    n = 4 + int.from_bytes(body[:4], "little")
    v = _values(np.frombuffer(body, dtype=np.uint8)[4:n])
    a = 1 + int(v[0])
    b = a + int(v[1:a].sum())
    return v[1:a], v[a:b], v[b:], np.frombuffer(body, dtype="<u4", offset=n)


class Tree:
    """A printed form's tree: keys and bytes of sections, paragraphs and passages, and where the children of each branch begin."""

    __slots__ = ("first", "keys", "root", "size")

    def __init__(self, fingerprint: str):
        self.root = fingerprint[:ROOT]
        sections, paragraphs, lens, hashes = parse(fingerprint)
        leaf = (lens.astype(np.int64) << 32 | hashes).view(U64)
        starts = [np.concatenate(([0], np.cumsum(n))) for n in (sections, paragraphs)]
        keys, size = [leaf], [lens]
        for start in reversed(starts):
            keys.insert(0, _fold(mix(keys[0]), start[:-1]) if len(leaf) else leaf)
            size.insert(0, np.add.reduceat(size[0], start[:-1]) if len(leaf) else lens)
        self.keys, self.size, self.first = [k.tolist() for k in keys], [x.tolist() for x in size], [x.tolist() for x in starts]

    @property
    def total(self) -> int:
        return sum(self.size[0])

    def below(self, level: int, nodes: list[int]) -> list[int]:
        """Children of branches."""
        first = self.first[level]
        return [j for i in nodes for j in range(first[i], first[i + 1])]


def _alike(a: Tree, b: Tree) -> float:
    """From the top: a branch that both have counts whole; only the others' children are looked at."""
    if a.root == b.root:
        return 1.0
    whole = a.total + b.total
    if not a.total or not b.total:
        return 0.0
    shared, left, right = 0, list(range(len(a.keys[0]))), list(range(len(b.keys[0])))
    for level in range(3):
        have = Counter(b.keys[level][j] for j in right)
        taken: Counter = Counter()
        rest = []
        for i in left:
            k = a.keys[level][i]
            if taken[k] < have.get(k, 0):
                taken[k] += 1
                shared += a.size[level][i]
            else:
                rest.append(i)
        other = []
        for j in right:
            k = b.keys[level][j]
            if taken[k]:
                taken[k] -= 1
            else:
                other.append(j)
        if level < 2:
            left, right = a.below(level, rest), b.below(level, other)
    return round(2 * shared / whole, 6)


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    return _alike(Tree(a), Tree(b))


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Byte ranges (from, to in the first text; from, to in the second) outside which two texts are the same, from their fingerprints.

    Equal roots need no look further; sections are aligned in order, then the paragraphs of those that differ, then their passages.
    """
    x, y = Tree(a), Tree(b)
    if x.root == y.root:
        return []
    at = [[[0, *np.cumsum(size).tolist()] for size in t.size] for t in (x, y)]

    def apart(level: int, i0: int, i1: int, j0: int, j1: int):
        same = SequenceMatcher(None, x.keys[level][i0:i1], y.keys[level][j0:j1], autojunk=False)
        for kind, p, q, r, s in same.get_opcodes():
            if kind == "equal":
                continue
            p, q, r, s = p + i0, q + i0, r + j0, s + j0
            if level < 2 and p < q and r < s:
                yield from apart(level + 1, x.first[level][p], x.first[level][q], y.first[level][r], y.first[level][s])
            else:
                yield at[0][level][p], at[0][level][q], at[1][level][r], at[1][level][s]

    return list(apart(0, 0, len(x.keys[0]), 0, len(y.keys[0])))


def _edited(text: str, after: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def _rows(kind: str):
    """Rows of a bucket in order, each followed by its next; the last row of a bucket is only the next of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, fingerprint, tree
        for batch in batches:
            cols = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            buckets, ids, halo = (batch.column(c).to_pylist() for c in ("bucket", "doc_id", "halo"))
            texts = batch.column("bytes").to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= vectext.BLOCK_BYTES):
                    size += len(texts[j])
                    j += 1
                prints = fingerprints(texts[i:j])
                pending = []
                for k in range(i, j):
                    now = (buckets[k], ids[k], texts[k].decode("utf-8", "replace"), prints[k - i], Tree(prints[k - i]))
                    if held is not None and held[0] == now[0]:
                        pending.append((held, now, _edited(held[2], now[2])))
                    held = None if halo[k] else now
                changed = fingerprints([e.encode() for _, _, e in pending]) if pending else []
                for (own, after, text), fp in zip(pending, changed, strict=True):
                    cols["doc_id"].append(own[1])
                    cols["n_chars"].append(len(own[2]))
                    cols["edited_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    cols["fingerprint"].append(own[3])
                    cols["edited_fingerprint"].append(fp)
                    cols["near_edited"].append(_alike(own[4], Tree(fp)))
                    cols["near_next"].append(_alike(own[4], after[4]))
                i = j
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))

    return run


def compare_with_next(docs: DataFrame, rows_per_bucket: int = 4000) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The order is cut into buckets at quantiles of doc_id; a bucket also gets
    the first row of the following bucket, so that each row meets its next
    without one global sort.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pos = F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    src = docs.select("doc_id", pos.alias("pos"), frames.text_bytes().alias("bytes"))
    n = src.count()
    if not n:
        return spark.createDataFrame([], _schema(kind))
    parts = max(1, min(n // rows_per_bucket, frames.MOST_BUCKETS))
    rows = src.withColumn("bucket", frames.order_bucket(src, parts))
    heads = rows.groupBy("bucket").agg(F.min("pos").alias("pos")).orderBy("bucket").collect()
    leads = ",".join(f'{{"pos":"{heads[(i + 1) % len(heads)].pos}","to":{h.bucket}}}' for i, h in enumerate(heads))
    leads = spark.range(1).select(F.inline(F.from_json(F.lit(f"[{leads}]"), "array<struct<pos:string,to:int>>"))).select(F.col("pos").cast("decimal(20,0)").alias("pos"), "to")
    first = rows.join(F.broadcast(leads), "pos")
    every = rows.select("bucket", F.lit(0).alias("halo"), "pos", "doc_id", "bytes").unionByName(first.select(F.col("to").alias("bucket"), F.lit(1).alias("halo"), "pos", "doc_id", "bytes"))
    dealt = every.repartition(len(heads), "bucket").sortWithinPartitions("bucket", "halo", "pos", F.sha2("bytes", 256))
    return dealt.select("bucket", "halo", "doc_id", "bytes").mapInArrow(_rows(kind), _schema(kind))


def _schema(kind: str) -> str:
    return f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
