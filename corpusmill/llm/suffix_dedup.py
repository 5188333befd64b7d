"""Removal of repeated byte strings: windows grouped by digits of growing depth.

Only the first ``length`` bytes of a suffix matter; two that agree so far are
the same repeated window.  Ordering every suffix by its leading bytes over the
cluster would send each byte of text many times, so the first digit is one that
neighbouring windows share: a window's anchor, the k-gram with the least hash
in it.  Equal windows have equal anchors at equal places, so windows only ever
meet within a digit, and windows that follow each other mostly go through the
first pass as one row.  The passes:

1. by anchor (one row for each anchor and segment of text).  If all windows
   around an anchor are the same everywhere, the group is decided here: all but
   its earliest member repeat.
2. by anchor and surroundings, for the anchors whose surroundings differ
   somewhere: again all but the earliest of a class repeat.
3. for the windows around what is left of these classes, a radix sort to depth
   ``length``, the most significant bytes first: a pass of eight bytes orders
   only the windows that are equal so far and drops those that stand alone, and
   what is equal at the end repeats.  Anchors with many classes send each window
   by its hash instead.

A segment sends one row for each digit at most, as later members of a group
repeat an earlier one whatever other segments hold.  Hence no group is larger
than the number of segments, however often a passage occurs.

Nulls and ties: a null text is empty; rows without a doc_id come after all
others, in the order of a digest of their texts.  Rows that share a doc_id are
told apart by 60 bits of the text's SHA-256; strings at the same doc_id and start
are not earlier than one another.  Texts under ``length``
bytes lose nothing.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import frames, vectext
from corpusmill.llm.vectext import U64, mix, signed

ANCHOR = 32
BLOCK = 1 << 18
#: Bytes of text that a task holds the anchors of.
SEGMENT = 24 << 20
#: An anchor with more classes than these has its windows dealt out one by one.
MANY = 8192
#: So many anchors with differing surroundings are sent to all tasks; beyond, they are joined.
BROADCAST_KEYS = 8_000_000
_POS = 28
#: Bytes of a text whose anchors are found at a time.
LARGEST = 1 << (_POS - 1)
_ROW = "key long, sc long, doc long, tag long, place long"


def _anchored(block: vectext.Block, length: int):
    """Of each anchor: k-gram hash, hash of all its windows, and the first and last start in the buffer."""
    if len(block.buf) <= LARGEST:
        return _anchored_part(block.buf, block.start, block.end, length)
    parts = []  # a text so long is a block of its own; its windows are dealt out by their starts
    for a in range(0, len(block.buf), LARGEST - length + 1):
        z = min(a + LARGEST, int(block.end[0]))
        kg, sc, lo, hi = _anchored_part(block.buf[a:z], np.array([0]), np.array([max(0, z - a)]), length)
        parts.append((kg, sc, lo + a, hi + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchored_part(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int):
    w = length - ANCHOR + 1
    none = np.zeros(0, dtype=np.int64)
    ok = end - start >= length
    if not ok.any():
        return none.view(U64), none.view(U64), none, none
    gram, whole = vectext.rolling(buf, (ANCHOR, length), 11)
    key = (gram >> U64(_POS)) << U64(_POS) | np.arange(len(gram), dtype=U64)
    n = -(-len(key) // w) * w
    padded = np.full(n, 2**64 - 1, dtype=U64)
    padded[: len(key)] = key
    square = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(square, axis=1).ravel()
    suffix = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(key) - w + 1
    least = np.minimum(suffix[:m], prefix[w - 1 : w - 1 + m])
    at = (least & U64((1 << _POS) - 1)).astype(np.int64)
    valid = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(start[ok], end[ok], strict=True)])
    a = at[valid]
    new = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    lo = valid[new]
    hi = valid[np.concatenate((new[1:], [len(valid)])) - 1]
    anchor = a[new]
    sc = mix(whole[lo] * U64(0x9E3779B97F4A7C15) + whole[hi] * U64(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(U64) * U64(131) + (anchor - lo).astype(U64))
    return gram[anchor], sc, lo, hi


def _source(docs: DataFrame) -> DataFrame:
    """doc_id; doc: it, or for null one of the text's own beyond all others; tag: of the text; bytes."""
    tag = F.conv(F.substring(F.sha2("bytes", 256), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", frames.text_bytes().alias("bytes")).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), tag + (1 << 62)).alias("doc"), tag.alias("tag"), "bytes")


def _runs(doc, tag, lo, hi):
    """Start ranges of the same text that touch, merged."""
    if not len(doc):
        return doc, tag, lo, hi
    o = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[o], tag[o], lo[o], hi[o]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] > hi[:-1] + 1)))
    first = np.flatnonzero(new)
    return doc[first], tag[first], lo[first], np.maximum.reduceat(hi, first)


def _segments(batches: Iterator[pa.RecordBatch], length: int, want):
    """Arrays of a segment: kg, sc, doc, tag, lo, hi, and what finds the bytes: the blocks, each anchor's block and start in it.

    want: keeps the anchors of these hashes; True: of those in the row's kgs; None: all.
    """
    held, parts, size = [], [], 0
    for batch in batches:
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
        kgs = batch.column("kgs").to_pylist() if want is True else None
        for block in vectext.blocks(batch.column("bytes"), limit=BLOCK):
            kg, sc, lo, hi = _anchored(block, length)
            size += len(block.buf)
            if len(kg):
                row = np.searchsorted(block.start, lo, side="right") - 1
                got = np.ones(len(kg), dtype=bool)
                if want is True:
                    for r in np.unique(row):
                        got[row == r] = np.isin(signed(kg[row == r]), kgs[block.first + r])
                elif want is not None:
                    got = want[np.minimum(np.searchsorted(want, kg), len(want) - 1)] == kg if len(want) else ~got
                if got.any():
                    kg, sc, lo, hi, row = (x[got] for x in (kg, sc, lo, hi, row))
                    base = block.start[row]
                    held.append((kg, sc, ids[block.first + row], tags[block.first + row], lo - base, hi - base, np.full(len(kg), len(parts)), lo))
                    parts.append(block.buf if want is not None else None)
            if size >= SEGMENT:
                if held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)], parts
                held, parts, size = [], [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)], parts


def _emit(key, sc, doc, tag, place, more=None) -> Iterator[pa.RecordBatch]:
    """more: gives the bytes column for a slice."""
    for i in range(0, len(key), 1 << 14):
        j = slice(i, i + (1 << 14))
        cols = [pa.array(np.ascontiguousarray(x[j])) for x in (signed(key), signed(sc), doc, tag, place)]
        if more:
            cols.append(more(j))
        yield pa.RecordBatch.from_arrays(cols, ["key", "sc", "doc", "tag", "place", "ctx"][: len(cols)])


def _ordered(kg, sc, doc, lo):
    """Order by digit, class, document and place; where classes and digits begin; which members are later than the first of their class."""
    o = np.lexsort((lo, doc, sc, kg))
    kg, sc, doc, lo = kg[o], sc[o], doc[o], lo[o]
    new_kg = np.concatenate(([True], kg[1:] != kg[:-1]))
    new = new_kg | np.concatenate(([True], sc[1:] != sc[:-1]))
    first = np.flatnonzero(new)
    of = np.repeat(first, np.diff(np.concatenate((first, [len(kg)]))))
    return o, new_kg, new, (doc != doc[of]) | (lo != lo[of])


def _run_rows(doc, tag, lo, hi, ctx: bool = False):
    d, t, a, b = _runs(doc, tag, lo, hi)
    return _emit(mix(d.view(U64)), b.view(U64), d, t, -2 - a, (lambda j: pa.nulls(len(d[j]), pa.binary())) if ctx else None)


def _by_anchor(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kg, sc, doc, tag, lo, hi, _, _), _ in _segments(batches, length, None):
            o, new_kg, new, later = _ordered(kg, sc, doc, lo)
            kg, sc, doc, tag, lo, hi = (x[o] for x in (kg, sc, doc, tag, lo, hi))
            at = np.flatnonzero(new_kg)
            many = np.add.reduceat(new.astype(np.int64), at) > 1  # a digit whose windows differ within the segment is only named
            yield from _emit(kg[at], sc[at], doc[at], tag[at], np.where(many, -1, _place(lo, hi)[at]))
            yield from _run_rows(doc[later], tag[later], lo[later], hi[later])

    return run


def _place(lo, hi):
    return (lo << 7) | (hi - lo + 1)


def _by_class(length: int, want):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kg, sc, doc, tag, lo, hi, part, start), parts in _segments(batches, length, want if want is True else want.value):
            o, _, new, later = _ordered(kg, sc, doc, lo)
            kg, sc, doc, tag, lo, hi, part, start = (x[o] for x in (kg, sc, doc, tag, lo, hi, part, start))
            f = np.flatnonzero(new)
            p, a, z = part[f], start[f], start[f] + hi[f] - lo[f] + length
            yield from _emit(kg[f], sc[f], doc[f], tag[f], _place(lo, hi)[f], lambda j, p=p, a=a, z=z, parts=parts: pa.array([parts[i][x:y].tobytes() for i, x, y in zip(p[j], a[j], z[j], strict=True)], pa.binary()))
            yield from _run_rows(doc[later], tag[later], lo[later], hi[later], True)

    return run


def _set_out(batches: list[pa.RecordBatch], length: int):
    """Every window of the rows' bytes: two hashes, doc, tag and start."""
    ctx = [x for b in batches for x in b.column("ctx").to_pylist()]
    doc, tag, lo = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("doc", "tag", "lo"))
    block = vectext.Block(ctx, 0)
    n = block.end - block.start - length + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = step + np.repeat(block.start, n)
    one, two = (vectext.rolling(block.buf, (length,), seed)[0][at] for seed in (11, 12))
    return one, two, np.repeat(doc, n), np.repeat(tag, n).astype(np.int64), step + np.repeat(lo, n)


def _radix(batches: list[pa.RecordBatch], length: int):
    """Every window of the rows' bytes that has an equal, by most-significant-digit passes: group, doc, tag and start.

    A digit is eight bytes; a pass orders only windows that are equal so far, and drops those that no other equals any more.
    """
    ctx = [x for b in batches for x in b.column("ctx").to_pylist()]
    doc, tag, lo = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("doc", "tag", "lo"))
    block = vectext.Block(ctx, 0)
    n = block.end - block.start - length + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    row, at = np.repeat(np.arange(len(n)), n), step + np.repeat(block.start, n)
    digits = np.lib.stride_tricks.sliding_window_view(np.concatenate((block.buf, np.zeros(8, dtype=np.uint8))), 8)
    group = np.zeros(len(at), dtype=np.int64)
    for d in range(0, length, 8):
        if not len(at):
            break
        digit = np.ascontiguousarray(digits[at + min(d, length - 8)]).view(">u8").ravel().astype(U64)
        o = np.lexsort((digit, group))
        digit, group, at, row, step = digit[o], group[o], at[o], row[o], step[o]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        many = ~(new & np.concatenate((new[1:], [True])))
        group = (np.cumsum(new) - 1)[many]
        at, row, step = at[many], row[many], step[many]
    return group, doc[row], tag[row].astype(np.int64), step + lo[row]


def _group_windows(length: int):
    """Rows in order of kg: the window starts that repeat an earlier one of the same anchor."""

    def found(held):
        group, doc, tag, at = _radix(held, length)
        o, _, _, later = _ordered(group, group, doc, at) if len(group) else (group, group, group, group.astype(bool))
        d, t, a, b = _runs(doc[o][later], tag[o][later], at[o][later], at[o][later])
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kg = batch.column("kg").to_numpy()
            change = np.flatnonzero(kg[1:] != kg[:-1]) + 1
            last = held[-1].column("kg")[-1].as_py() if held else None
            cuts = [*([0] if last is not None and last != kg[0] else []), *change.tolist()]
            i = 0
            for c in cuts:
                if n + c - i >= 8192 or c == 0 and n >= 8192:
                    if c > i:
                        held.append(batch.slice(i, c - i))
                    yield found(held)
                    held, n, i = [], 0, c
            if i < batch.num_rows:
                held.append(batch.slice(i))
                n += batch.num_rows - i
        if held:
            yield found(held)

    return run


def _each_window(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two, doc, tag, at = _set_out([batch], length)
                o, _, new, later = _ordered(one, two, doc, at)
                one, two, doc, tag, at = (x[o] for x in (one, two, doc, tag, at))
                yield from _emit(one[new], two[new], doc[new], tag[new], _place(at, at)[new])
                yield from _run_rows(doc[later], tag[later], at[later], at[later])

    return run


def _decided(rows: DataFrame, by: list[str]) -> DataFrame:
    """Start ranges (doc, tag, lo, hi) that repeat; besides rows with ask: members that the next pass needs."""
    w = Window.partitionBy(*by)
    whole = w.orderBy("doc", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.col("place") >= 0
    many = F.lit(False)
    if by == ["key"]:
        real = F.when(F.col("place") >= -1, F.col("sc"))
        many = (F.min(real).over(whole) != F.max(real).over(whole)) | (F.min(F.when(F.col("place") >= -1, F.col("place"))).over(whole) == -1)
    rows = rows.withColumn("many", many).withColumn("lead", F.min(F.when(own, F.struct("doc", F.col("place").alias("p")))).over(whole)).withColumn("nth", F.row_number().over(w.orderBy("doc", "place")))
    run = F.col("place") <= -2
    repeat = own & ~F.col("many") & ((F.col("doc") != F.col("lead.doc")) | (F.col("place") != F.col("lead.p")))
    ask = ~run & F.col("many") & (F.col("nth") == 1)
    if "ctx" in rows.columns:
        ask = own & (F.col("nth") == 1)
    lo = F.when(run, -2 - F.col("place")).otherwise(F.shiftright("place", 7))
    return rows.where(run | repeat | ask).select(
        ask.alias("ask"),
        F.col("key").alias("kg"),
        "doc",
        "tag",
        lo.cast("int").alias("lo"),
        F.when(run, F.col("sc")).otherwise(lo + F.col("place").bitwiseAND(127) - 1).cast("int").alias("hi"),
        *([F.when(ask, F.col("ctx")).alias("ctx")] if "ctx" in rows.columns else []),
    )


def _cover(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            out = []
            for text, found in zip(batch.column("bytes").to_pylist(), spans, strict=True):
                n = len(text)
                got = np.array([(x["lo"], x["hi"]) for x in found or ()], dtype=np.int64).reshape(-1, 2) if found else np.zeros((0, 2), dtype=np.int64)
                if not len(got):
                    out.append((n, 0, 0, hashlib.sha256(text).hexdigest(), []))
                    continue
                step = np.zeros(n + 1, dtype=np.int32)
                np.add.at(step, got[:, 0], 1)
                np.add.at(step, np.minimum(got[:, 1] + length, n), -1)
                gone = np.cumsum(step[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                out.append((n, int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(cols[i], type=pa.int64()) for i in range(3)), pa.array(cols[3], type=pa.string()), pa.array(cols[4], type=pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges"],
            )

    return run


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """For each text with a repeated string: doc and tag as in _source, spans of window starts (lo, hi)."""
    if not ANCHOR <= length < ANCHOR + 127:
        raise ValueError(f"strings of {ANCHOR} to {ANCHOR + 126} bytes are found")
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    src = _source(docs).select("doc", "tag", "bytes").where(F.length("bytes") >= length)
    one = frames.cut(_decided(src.mapInArrow(_by_anchor(length), _ROW), ["key"]))
    asked = one.where("ask").select("kg")
    n = asked.count()
    if n <= BROADCAST_KEYS:
        held = spark.sparkContext.broadcast(np.sort(frames.fetch(asked)["kg"].astype(np.int64).view(U64)))
        two = src.mapInArrow(_by_class(length, held), _ROW + ", ctx binary")
    else:

        def named(batches):
            for x, _ in _segments(batches, length, None):
                for b in _emit(x[0], x[0], x[2], x[3], x[2]):
                    yield b.select(["key", "doc"])

        marks = src.mapInArrow(named, "key long, doc long").join(asked.withColumnRenamed("kg", "key"), "key", "left_semi").groupBy("doc").agg(F.collect_set("key").alias("kgs"))
        two = src.join(marks, "doc").mapInArrow(_by_class(length, True), _ROW + ", ctx binary")
    two = frames.cut(_decided(two, ["key", "sc"]))
    classes = two.where("ask").select("kg", "doc", "tag", "lo", "ctx")
    sizes = frames.cut(classes.groupBy("kg").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = classes.join(sizes.where(F.col("n") <= MANY), "kg", "left_semi").repartition("kg").sortWithinPartitions("kg").mapInArrow(_group_windows(length), "doc long, tag long, lo int, hi int")
    most = sizes.where(F.col("n") > MANY).select("kg")
    most = _decided(frames.keep_keys(classes, most, ["kg"], most.count()).mapInArrow(_each_window(length), _ROW), ["key", "sc"]).select("doc", "tag", "lo", "hi")
    both = one.where("not ask").select("doc", "tag", "lo", "hi").unionByName(two.where("not ask").select("doc", "tag", "lo", "hi")).unionByName(few).unionByName(most)
    return both.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Removed byte spans of each document and a digest of what is left.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and edges (start
    and end of each removed run in turn).
    """
    spans = frames.cut(repeated_spans(docs, length))
    n = spans.count()
    src = _source(docs)
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>"
    if n > frames.BROADCAST_ROWS:
        return src.join(spans, ["doc", "tag"], "left").mapInArrow(_cover(length), shape)
    keys = F.broadcast(spans.select("doc", "tag"))
    hit = src.join(keys, ["doc", "tag"], "left_semi").join(spans, ["doc", "tag"])
    return hit.mapInArrow(_cover(length), shape).unionByName(src.join(keys, ["doc", "tag"], "left_anti").mapInArrow(_cover(length), shape))
