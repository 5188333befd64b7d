"""Compression of vectors to codes: product quantization by Lloyd's rounds over distinct parts.

Components become integers floor(4096 * x); a vector is cut into equal
consecutive parts.  Equal parts of one position are one row with a weight, so
rounds read each distinct value once, however often it occurs.  A round assigns
every distinct value to the nearest entry of its position's codebook (squared
Euclidean distance, ties to the lower index) and replaces each entry by the
floor of the weighted mean of its values; an unused entry stays.  Sums of a
round are folded by task before they are shuffled; the codebooks (positions x
entries x components, a size fixed by the parameters) are all that reaches the
driver.  At last the codes and errors of the distinct values are joined back to
the vectors.

Rows whose vector is null, empty or holds a null or non-finite component are
dropped, as are those whose length is not the most frequent one (ties: the
longer).  A length that the number of parts does not divide is cut as evenly as
possible.  Integers are held within +-2**(29 - log2(length)/2), so that no error
leaves 63 bits; a sum of errors that does is null.  The codebooks start with the
smallest vec_ids (nulls last, ties by the vector); with fewer vectors than
entries there are as many entries as vectors.  Repeated rows are kept as rows of
their own; null labels are one label; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import frames

SCALE = 4096


def _bounds(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def _integers(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """id, vec_id, label and the parts as little-endian 64-bit integers, p0, p1, .."""
    most, at = 1 << (29 - (max(length, 2) - 1).bit_length() // 2), _bounds(length, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten(), dtype=np.float64).reshape(-1, length)
            with np.errstate(over="ignore"):
                ints = np.clip(np.floor(SCALE * x), -most, most).astype("<i8")
            cut = [pa.array([p.tobytes() for p in ints[:, a:b]], pa.binary()) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec_id"), batch.column("label"), *cut], ["id", "vec_id", "label", *[f"p{i}" for i in range(parts)]])

    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "vec_id", "label"))
    return rows.mapInArrow(run, kind + "".join(f", p{i} binary" for i in range(parts)))


def _nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest of the nearest entries, and the squared distance to it."""
    best = np.full(len(values), np.iinfo(np.int64).max)
    code = np.zeros(len(values), dtype=np.int64)
    for i, entry in enumerate(book):
        d = values - entry
        far = np.einsum("ij,ij->i", d, d)
        closer = far < best
        best[closer], code[closer] = far[closer], i
    return code, best


def _arrays(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each position in a batch: its rows, and their values."""
    position = batch.column("position").to_numpy()
    raw = np.array(batch.column("value").to_pylist(), dtype=object)
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p)
        yield p, at, np.frombuffer(b"".join(raw[at]), dtype="<i8").reshape(len(at), books[p].shape[1])


def _sums(distinct: DataFrame, books: list[np.ndarray]) -> list[tuple]:
    """(position, code, weight, component sums) of one assignment."""
    width = max(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), len(books[0]), width + 1), dtype=np.int64)
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, at, values in _arrays(batch, books):
                code, _ = _nearest(values, books[p])
                np.add.at(total[p, :, 0], code, weight[at])
                np.add.at(total[p, :, 1 : values.shape[1] + 1], code, values * weight[at, None])
        p, c = np.nonzero(total[:, :, 0])
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, c, *total[p, c].T)], names)

    names = ["position", "code", "weight", *[f"s{i}" for i in range(width)]]
    found = distinct.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("position", "code")
    return [tuple(r) for r in found.agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()]  # positions x entries rows


def _coded(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for p, at, values in _arrays(batch, books):
                code[at], error[at] = _nearest(values, books[p])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("value"), pa.array(code), pa.array(error)], ["position", "value", "code", "error"])

    return distinct.select("position", "value").mapInArrow(run, "position int, value binary, code long, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """A row for each kept vector: vec_id, label, code, error, label_error; and the codebooks, an array of entries for each position.

    vectors: vec_id, embedding (array of numbers), label.  At most 256 entries;
    a code is the hexadecimal digits of each part's entry, two each, in order.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two digits names 1 to 256 entries")
    spark = vectors.sparkSession
    frames.arrow_batches(spark, 10_000)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector")).where(F.coalesce(F.forall("vector", finite), F.lit(False)) & (F.size("vector") > 0))
    most = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if not most:
        return good.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    length = most["n"]
    rows = frames.cut(_integers(good.where(F.size("vector") == length).withColumn("id", F.monotonically_increasing_id()).select("id", "vec_id", "label", "vector"), length, parts))
    exploded = rows.select("id", "vec_id", "label", F.posexplode(F.array(*[f"p{i}" for i in range(parts)])).alias("position", "value"))
    distinct = frames.cut(exploded.groupBy("position", "value").agg(F.count(F.lit(1)).alias("weight")))
    start = good.where(F.size("vector") == length).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries)
    start = _integers(start.withColumn("id", F.monotonically_increasing_id()).select("id", "vec_id", "label", "vector"), length, parts)
    first = start.select("vec_id", *[f"p{i}" for i in range(parts)]).toPandas()
    books = [np.stack([np.frombuffer(v, dtype="<i8") for v in first[f"p{i}"]]) for i in range(parts)]
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for p, c, weight, *total in _sums(distinct, books):
            books[p][c] = np.array(total[: books[p].shape[1]]) // weight
    coded = _coded(distinct, books)
    spread = exploded.join(coded, ["position", "value"]).groupBy("id", "vec_id", "label").agg(*[F.max(F.when(F.col("position") == p, F.col("code"))).alias(f"c{p}") for p in range(parts)], F.sum("error").alias("error"))
    digits = F.lower(F.concat(*[F.lpad(F.hex(f"c{p}"), 2, "0") for p in range(parts)]))
    done = frames.cut(spread.select("vec_id", "label", digits.alias("code"), "error"))
    by_label = done.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error")
    frames.release(rows)
    frames.release(distinct)
    return out, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
