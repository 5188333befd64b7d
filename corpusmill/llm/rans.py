"""Token ids on disk: static range asymmetric numeral systems in independent blocks.

Documents are tokenized, put in ascending order of doc_id (nulls last, ties by
text) and written in segments.  A segment has one frequency table, counted
over all its ids and shared by its blocks; each block is coded on its own by
interleaved 64-bit states with 32-bit words, and carries its place in the
segment, its states (the checkpoint from which it decodes) and a checksum of
its ids.  So any block decodes without the others.

Files are Parquet with one row for a segment, written and read by Spark, hence
in whatever store the path names: order of the segment (bucket, segment),
n_tokens, doc_ids, doc_tokens, table, blocks.  Layouts, all little-endian:

table: "RT01", crc32 of the rest, number of symbols, then symbols and frequencies
block: "RB01", crc32 of the ids, first id's place, ids, lanes, words, then
       states (8 bytes each) and words (4 bytes each)

A null text is empty; it still has its end id.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import frames, tokens, vectext
from corpusmill.llm.vectext import U64

SCALE = 18
LOWEST = U64(1 << 31)
BLOCK_IDS, MOST_LANES = 1 << 18, 1024
SEGMENT_IDS = 1 << 21


class Table:
    """Frequencies that add up to 2**SCALE; every symbol that occurs has at least 1."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq
        start = np.cumsum(freq) - freq
        size = int(symbols[-1]) + 1 if len(symbols) else 0
        self.f, self.c = np.zeros(size, dtype=U64), np.zeros(size, dtype=U64)
        self.f[symbols], self.c[symbols] = freq, start
        self._slots = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        if len(symbols) > 1 << (SCALE - 1):
            raise ValueError("more symbols than the frequency table can tell apart")
        share = counts[symbols] / counts.sum() * (1 << SCALE)
        freq = np.maximum(1, np.floor(share)).astype(np.int64)
        over = int(freq.sum()) - (1 << SCALE)
        if over > 0:  # take from the largest
            for i in np.argsort(-freq, kind="stable"):
                take = min(over, int(freq[i]) // 2)
                freq[i] -= take
                over -= take
                if not over:
                    break
        else:
            freq[np.argmax(freq)] -= over
        return cls(symbols, freq)

    def dump(self) -> bytes:
        body = np.uint32(len(self.symbols)).tobytes() + self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return b"RT01" + zlib.crc32(body).to_bytes(4, "little") + body

    @classmethod
    def load(cls, raw: bytes) -> Table:
        if raw[:4] != b"RT01" or zlib.crc32(raw[8:]) != int.from_bytes(raw[4:8], "little"):
            raise ValueError("damaged frequency table")
        n = int.from_bytes(raw[8:12], "little")
        both = np.frombuffer(raw, dtype="<u4", offset=12).astype(np.int64)
        return cls(both[:n], both[n:])

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(self.symbols, self.freq)
        return self._slots


def encode_block(ids: np.ndarray, table: Table, first: int = 0) -> bytes:
    n = len(ids)
    lanes = max(1, min(MOST_LANES, n // 256))
    x = np.full(lanes, LOWEST, dtype=U64)
    f, c = table.f[ids], table.c[ids]
    limit = f << U64(63 - SCALE)
    words: list[np.ndarray] = []
    for a in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        z = min(a + lanes, n)
        s = x[: z - a]
        full = s >= limit[a:z]
        out = s[full]
        words.append(out.astype("<u4"))
        s[full] = out >> U64(32)
        q, r = np.divmod(s, f[a:z])
        x[: z - a] = (q << U64(SCALE)) + r + c[a:z]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype="<u4")
    head = np.array([zlib.crc32(ids.astype("<u4").tobytes()), first, n, lanes, len(stream)], dtype="<u4")
    return b"RB01" + head.tobytes() + x.astype("<u8").tobytes() + stream.tobytes()


def decode_block(raw: bytes, table: Table) -> np.ndarray:
    if raw[:4] != b"RB01":
        raise ValueError("not a block")
    crc, _, n, lanes, count = np.frombuffer(raw, dtype="<u4", count=5, offset=4).tolist()
    x = np.frombuffer(raw, dtype="<u8", count=lanes, offset=24).astype(U64)
    words = np.frombuffer(raw, dtype="<u4", count=count, offset=24 + 8 * lanes).astype(U64)
    slots, low = table.slots, U64((1 << SCALE) - 1)
    out = np.empty(n, dtype=np.uint32)
    at = 0
    for a in range(0, n, lanes):
        z = min(a + lanes, n)
        s = x[: z - a]
        slot = s & low
        ids = slots[slot.astype(np.int64)]
        out[a:z] = ids
        s = table.f[ids] * (s >> U64(SCALE)) + slot - table.c[ids]
        need = np.flatnonzero(s < LOWEST)
        s[need] = s[need] << U64(32) | words[at : at + len(need)]
        at += len(need)
        x[: z - a] = s
    if at != count or (x != LOWEST).any() or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return out


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            out = []
            for block in vectext.blocks(batch.column("bytes"), limit=tokens.BLOCK):
                ids, counts = encode(block)
                ends = np.cumsum(counts)
                out += [np.append(ids[b - n : b], np.uint32(end_id)).astype("<u4") for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            wide = [len(x) and int(x.max()) > 0xFFFF for x in out]
            raw = pa.array([x.tobytes() if w else x.astype("<u2").tobytes() for x, w in zip(out, wide, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "doc_id", "tie")), pa.array(wide, pa.bool_()), raw], ["bucket", "doc_id", "tie", "wide", "ids"])

    return run


def _segments(kind):
    names = ["bucket", "segment", "n_tokens", "doc_ids", "doc_tokens", "table", "blocks"]

    def written(bucket: int, number: int, docs: list, kind) -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in docs])
        table = Table.of(ids)
        blocks = [encode_block(ids[a : a + BLOCK_IDS], table, a) for a in range(0, len(ids), BLOCK_IDS)]
        cols = [pa.array([bucket], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([[d for d, _ in docs]], pa.list_(kind)), pa.array([[len(x) for _, x in docs]], pa.list_(pa.int64())), pa.array([table.dump()], pa.binary()), pa.array([blocks], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket, number, kind = [], 0, None, 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for b, d, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "wide", "ids")), strict=True):
                if held and (b != bucket or size >= SEGMENT_IDS):
                    yield written(bucket, number, held, kind)
                    held, size, number = [], 0, number + 1
                if b != bucket:
                    bucket, number = b, 0
                held.append((d, np.frombuffer(raw, dtype="<u4" if wide else "<u2").astype(np.uint32)))
                size += len(held[-1][1])
        if held:
            yield written(bucket, number, held, kind)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, rows_per_bucket: int = 4000) -> None:
    """Writes the ids of all texts, each followed by the end id, in ascending doc_id order."""
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("pos"), frames.text_bytes().alias("bytes"), F.xxhash64("text").alias("tie"))
    parts = max(1, min(src.count() // rows_per_bucket, frames.MOST_BUCKETS))
    ids = src.select(frames.order_bucket(src, parts).alias("bucket"), "doc_id", "tie", "bytes").mapInArrow(_tokenize(tokenizer, end_id), f"bucket int, doc_id {kind}, tie long, wide boolean, ids binary")
    dealt = ids.repartition(parts, "bucket").sortWithinPartitions("bucket", F.asc_nulls_last("doc_id"), "tie")
    shape = f"bucket int, segment int, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, table binary, blocks array<binary>"
    dealt.mapInArrow(_segments(kind), shape).write.option("compression", "none").parquet(path)


def _read(kind):
    names = ["bucket", "segment", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("bucket", "segment", "doc_ids", "doc_tokens", "table", "blocks")}
                table = Table.load(row["table"])
                ids = np.concatenate([decode_block(b, table) for b in row["blocks"]]).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                raw = [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), row["doc_tokens"], strict=True)]
                n = len(raw)
                cols = [pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), batch.column("doc_ids")[i].values, pa.array(ends - np.array(row["doc_tokens"]), pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_ids(spark, path: str) -> DataFrame:
    """What write_ids wrote: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    frames.arrow_batches(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    buckets = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before("bucket")), F.lit(0)).alias("first"))  # MOST_BUCKETS rows at most
    starts = files.select("bucket", "segment", F.coalesce(F.sum("n_tokens").over(before("bucket", "segment")), F.lit(0)).alias("base"))  # a row for each segment
    starts = starts.join(F.broadcast(buckets), "bucket").select("bucket", "segment", (F.col("base") + F.col("first")).alias("base"))
    docs = files.mapInArrow(_read(kind), f"bucket int, segment int, doc_id {kind}, at long, n_tokens long, ids_crc32 long, ids binary")
    n = files.count()
    return docs.join(F.broadcast(starts) if n <= frames.BROADCAST_ROWS else starts, ["bucket", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def new_path(spark) -> str:
    return frames.new_path(spark, "ids")
