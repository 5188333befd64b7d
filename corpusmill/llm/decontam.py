"""Benchmark passages in documents: a prefix-filtered set join with exact check.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
characters.  An item gives windows of ``window`` consecutive words; a shorter
item is one window.  A document word inside any occurrence of a window is hit.

A window is a set of word shingles (``shingle`` words, or the whole window if
it is shorter), and containment must be complete, so the prefix that the filter
needs is one shingle.  Shingles are ordered by rarity, counted over all
documents; the rarest of each window is its prefix.  Where it occurs in a
document, the length bound (the document has words for the window on both
sides) and the position bound (the shingle's place in the window) leave one
stretch of words, which is compared with the window word for word.

The documents are read twice and never shuffled; only occurrences are.  Tasks
hold a filter of the shingles in question of at most ``filters.FILTER_BITS``; what
passes is joined exactly, so a full filter costs time but no result.

A null text has no words.  A null item_id counts as the empty id.  Repeated
rows of either table are judged one by one; an item_id counts once however
often it occurs.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import filters, frames, vectext
from corpusmill.llm.vectext import signed

#: Places of a document that go in one row.
PLACES = 1000


def _words(block: vectext.Block) -> tuple[np.ndarray, vectext.Words]:
    low = vectext.LOWER[block.buf]
    return low, vectext.Words(block, vectext.ALNUM, buf=low)


def _text(low: np.ndarray, words: vectext.Words, lo: int, hi: int) -> str:
    return b" ".join(low[words.start[i] : words.end[i]].tobytes() for i in range(lo, hi)).decode("utf-8", "backslashreplace")


def _windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts, sizes, shingles = [], [], [], []
            ids = batch.column("item").to_pylist()
            for block in vectext.blocks(batch.column("bytes")):
                low, words = _words(block)
                for r, (lo, hi) in enumerate(zip(words.lo, words.hi, strict=True)):
                    n = int(min(window, hi - lo))
                    for i in range(lo, hi - n + 1) if n else ():
                        items.append(ids[block.first + r])
                        texts.append(_text(low, words, i, i + n))
                        sizes.append(n)
                        shingles.append(signed(vectext.grams(words.hash[i : i + n], min(n, shingle))).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], ["item", "words", "n", "shingles"])

    return run


def _found(block: vectext.Block, words: vectext.Words, sizes: list[int], wanted: filters.Filter):
    for s in sizes:
        g = vectext.grams(words.hash, s)
        hit = wanted.find(g)
        hit = hit[words.doc[hit] == words.doc[hit + s - 1]]
        if len(hit):
            yield g[hit], hit


def _counts(sizes: list[int], wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vectext.blocks(batch.column("bytes")):
                _, words = _words(block)
                for g, _ in _found(block, words, sizes, wanted.value):
                    key, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n.astype(np.int64))], ["sh", "n"])

    return run


def _candidates(sizes: list[int], wanted, window: int, shingle: int, ids: list[str]):
    place = pa.list_(pa.struct([("sh", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("near", pa.string())]))

    def batch_of(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, n, places = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ids), pa.array(n, pa.int64()), pa.array(places, place)], [*ids, "n_words", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []  # row of the batch, words (only in its first row), places
            for block in vectext.blocks(batch.column("bytes")):
                low, words = _words(block)
                own: list[list] = [[] for _ in range(len(block))]
                for g, hit in _found(block, words, sizes, wanted.value):
                    for h, i in zip(signed(g).tolist(), hit.tolist(), strict=True):
                        r = words.doc[i]
                        a, b = max(words.lo[r], i - window + 1), min(words.hi[r], i + window)
                        own[r].append({"sh": h, "pos": i - int(words.lo[r]), "left": i - int(a), "near": _text(low, words, a, b)})
                        if len(own[r]) == PLACES:
                            rows.append((block.first + int(r), None, own[r]))
                            own[r] = []
                rows += [(block.first + r, int(n), p) for r, (n, p) in enumerate(zip(words.hi - words.lo, own, strict=True))]
                if len(rows) >= PLACES:
                    yield batch_of(batch, rows)
                    rows = []
            if rows:
                yield batch_of(batch, rows)

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """For each row: rid (names the row), doc_id, text_hash, n_words, n_hit and items (sorted ids of the items with occurring windows: no more than there are items)."""
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_hash"), frames.text_bytes().alias("bytes"))
    asked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), frames.text_bytes().alias("bytes"))
    wins = frames.cut(asked.mapInArrow(_windows(window, shingle), "item string, words string, n int, shingles array<long>").distinct())

    sizes = sorted(r[0] for r in wins.select(F.least("n", F.lit(shingle))).distinct().collect())
    filt = spark.sparkContext.broadcast(filters.build(wins.select(F.explode("shingles")).distinct()))
    counts = frames.cut(src.select("bytes").mapInArrow(_counts(sizes, filt), "sh long, n long").groupBy("sh").agg(F.sum("n").alias("freq")))
    each = wins.select("item", "words", "n", F.posexplode("shingles").alias("at", "sh"))
    rare = each.join(counts, "sh", "left").groupBy("item", "words", "n").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "at", "sh")).alias("x"))
    prefix = frames.cut(rare.where("x.freq > 0").select("item", "words", "n", F.col("x.at").alias("at"), F.col("x.sh").alias("sh")))

    n = prefix.count()
    filt = spark.sparkContext.broadcast(filters.build(prefix.select("sh").distinct()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = sorted(r[0] for r in prefix.select(F.least("n", F.lit(shingle))).distinct().collect())
    rows = frames.cut(src.mapInArrow(_candidates(sizes, filt, window, shingle, ["rid", "doc_id", "text_hash"]), f"rid long, doc_id {kind}, text_hash long, n_words long, places array<struct<sh:long,pos:int,left:int,near:string>>"))

    at = rows.where(F.size("places") > 0).select("rid", F.explode("places").alias("p")).select("rid", "p.*")
    at = at.join(F.broadcast(prefix) if n <= frames.BROADCAST_ROWS // 8 else prefix, "sh")
    first = F.col("left") - F.col("at")
    near = F.split("near", " ")
    at = at.where((first >= 0) & (first + F.col("n") <= F.size(near))).where(F.array_join(F.slice(near, first + 1, F.col("n")), " ") == F.col("words"))
    hits = at.select("rid", "item", (F.col("pos") - F.col("at")).alias("lo"), (F.col("pos") - F.col("at") + F.col("n")).alias("hi"))
    hits = frames.cut(hits.distinct())
    before = F.max("hi").over(Window.partitionBy("rid").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("rid", "lo", "hi").distinct().withColumn("from", F.greatest("lo", F.coalesce(before, F.lit(0))))
    n_hit = spans.groupBy("rid").agg(F.sum(F.greatest(F.col("hi") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    found = hits.select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = rows.where("n_words is not null").select("rid", "doc_id", "text_hash", "n_words").join(n_hit.join(found, "rid"), "rid", "left")
    return out.select("rid", "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The documents without any benchmark window; all columns stay. Rows are named by doc_id and a hash of the text."""
    bad = frames.cut(contamination(docs, items, window, shingle).where("n_hit > 0").select(F.col("doc_id").alias("__corpusmill_id"), F.col("text_hash").alias("__corpusmill_of")).distinct())
    n = bad.count()
    named = docs.withColumn("__corpusmill_hash", F.xxhash64("text"))
    return named.join(F.broadcast(bad) if n <= frames.BROADCAST_ROWS else bad, F.col("doc_id").eqNullSafe(F.col("__corpusmill_id")) & (F.col("__corpusmill_hash") == F.col("__corpusmill_of")), "left_anti").drop("__corpusmill_hash")
