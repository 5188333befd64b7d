"""Mini-batch k-means over a table of vectors.

Rows fall into batches by a hash of their key and are written once in folders by batch, so an epoch reads each vector
once. A batch assigns its rows to the nearest centre and moves each centre by the mean of its own rows with the rate
n_batch / n_so_far, so later batches move it less. A centre that holds less than ``starved`` of the fullest one's share
begins anew at a row of the batch, the one with the least hash. Sums are taken over integers (components times
2**``bits``), so the result doesn't depend on how rows are dealt to tasks. Only centres and their counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import storage

#: The start is drawn from so many rows for each centre, those with the least hash.
START = 50


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest of the nearest centres and the squared distance."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    at = np.round(d, 9).argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def _sums(centres: np.ndarray, bits: int):
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                at, _ = _nearest(x, centres)
                np.add.at(total, at, np.round(x * (1 << bits)).astype(np.int64))
                count += np.bincount(at, minlength=k)
        c, j = np.nonzero(np.repeat(count[:, None], width, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(j), pa.array(total[c, j]), pa.array(count[c])], ["centre", "axis", "total", "n"])

    return run


def _spread(some: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Greedy k-means++: of some rows drawn in proportion to their squared distance from those before, the one that leaves the least."""
    rng = np.random.default_rng(seed)
    at = [0]
    far = ((some - some[0]) ** 2).sum(axis=1)
    while len(at) < k and far.max() > 0:
        drawn = np.searchsorted(np.cumsum(far), rng.random(4 + k.bit_length()) * far.sum(), side="right").clip(max=len(some) - 1)
        left = [np.minimum(far, ((some - some[i]) ** 2).sum(axis=1)) for i in drawn]
        best = int(np.argmin([x.sum() for x in left]))
        at.append(int(drawn[best]))
        far = left[best]
    return some[at]


def fit(vectors: DataFrame, key: str, column: str, k: int, batches: int = 8, epochs: int = 3, seed: int = 1, starved: float = 0.01, bits: int = 24) -> np.ndarray:
    """Centres. Rows without a vector, or with null components, take no part."""
    storage.ship(vectors.sparkSession)
    order = F.xxhash64(F.col(key), F.lit(seed))
    rows = vectors.select(order.alias("order"), F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(batches)).cast("int").alias("batch"), F.col(column).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    path = storage.new_path(vectors.sparkSession, "kmeans")
    rows.write.partitionBy("batch").parquet(path)
    kept = vectors.sparkSession.read.schema(rows.schema).parquet(path)
    some = np.array([r.vector for r in kept.select("order", "vector").distinct().orderBy("order", "vector").limit(START * k).collect()], dtype=np.float64)
    if not len(some):
        storage.delete(vectors.sparkSession, path)
        return np.zeros((0, 0))
    centres = _spread(some, k, seed)
    seen = np.zeros(len(centres))
    for _ in range(epochs):
        for b in range(batches):
            own = kept.where(F.col("batch") == b).select("vector")
            found = own.mapInArrow(_sums(centres, bits), "centre long, axis long, total long, n long").groupBy("centre", "axis").agg(F.sum("total"), F.sum("n")).collect()  # k x components rows
            total, n = np.zeros_like(centres), np.zeros(len(centres))
            for c, j, t, m in found:
                total[c, j], n[c] = t / (1 << bits), m
            seen += n
            moved = n > 0
            centres = centres.copy()
            centres[moved] += (total[moved] - n[moved, None] * centres[moved]) / seen[moved, None]
            weak = np.flatnonzero(seen < starved * seen.max())
            if len(weak):
                fresh = kept.where(F.col("batch") == b).select("order", "vector").distinct().orderBy("order", "vector").limit(len(weak)).collect()
                for c, r in zip(weak, fresh, strict=False):
                    centres[c], seen[c] = r.vector, 1
    storage.delete(vectors.sparkSession, path)
    return centres


def assign(vectors: DataFrame, key: str, column: str, centres: np.ndarray) -> DataFrame:
    """(key, centre, distance): squared distance, ties to the lower centre."""
    storage.ship(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = _nearest(_matrix(batch), centres)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(at.astype(np.int32)), pa.array(d)], ["key", "centre", "distance"])

    rows = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    return rows.mapInArrow(run, f"key {kind}, centre int, distance double").withColumnRenamed("key", key)


def inertia(vectors: DataFrame, key: str, column: str, centres: np.ndarray) -> float:
    return assign(vectors, key, column, centres).agg(F.sum("distance")).first()[0]
