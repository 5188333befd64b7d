"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Two faults are judged: toxic, and of low quality.  For each:

* Document evidence: log ratios of features that the fault raises significantly
  (words, word beginnings, and bins of style shares), summed over the distinct
  words, for each the largest of its own and its beginnings', plus the largest
  of style; calibrated by a logistic fit on labelled rows that the ratios were
  not taken from.
* Site priors: the faults' rates by host and by path under the host, from
  grouped counts of all labelled rows.  A host's rate is shrunk toward the
  global one and a path's toward its host's, with the strength that the spread
  between sites supports (method of moments), so sparse sites say little.

A document's log odds are its evidence plus its path's.  It is kept if both
faults are less likely than not.

The evidence is fitted on at most about ``max_fit`` labelled rows, picked by a
hash of doc_id; rates and judgements cover all rows.

A null text is empty.  Null host or path is a site of its own.  Labels without
a document are left out, and so is a null label for its fault; of several labels
of a document the worst counts; without labels everything is kept.  Repeated rows are judged alike.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import filters, frames, vectext
from corpusmill.llm.vectext import U64, mix, signed

FAULTS = ("toxic", "low")
BEGINNINGS = (4, 5, 6)
BINS = np.array([0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.4, 0.6, 0.85])
_UPPER = vectext.lookup_table(lambda b: 65 <= b <= 90)
_LETTER = vectext.lookup_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC3)
_SYMBOL = vectext.lookup_table(lambda b: chr(b) in "!#$%&*@^~<>{}[]=+_\\/|")
_STYLE = 1 << 62  # style features have hashes of their own


def _parts(block: vectext.Block):
    """Words of a block with, for each, its hash and those of its beginnings (0: too short); and style hashes by row."""
    low = vectext.LOWER[block.buf]
    words = vectext.Words(block, vectext.ALNUM, buf=low)
    hashes = [words.hash]
    for k in BEGINNINGS:
        long = words.end - words.start > k
        s = words.start[long]
        h = np.zeros(len(words.hash), dtype=U64)
        h[long] = mix(vectext.range_hash(low, s, s + k, 20 + k))
        hashes.append(h)
    n = len(block)
    share = lambda mask, of: np.add.reduceat(np.append(mask[block.buf].astype(np.int64), 0), np.stack((block.start, block.end), axis=1).ravel())[::2] / np.maximum(1, of)
    size = block.end - block.start
    letters = share(_LETTER, np.ones(n))
    again = np.zeros(len(words.hash))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    count = np.maximum(1, words.hi - words.lo)
    shares = [share(_UPPER, letters), share(_SYMBOL, size), np.bincount(words.doc, weights=again, minlength=n) / count, np.minimum(1, np.bincount(words.doc, weights=words.end - words.start, minlength=n) / count / 40)]
    style = [mix((_STYLE + 16 * i + np.where(size == 0, 15, np.searchsorted(BINS, x))).astype(U64)) for i, x in enumerate(shares)]
    return words, hashes, style


def _features(block: vectext.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a block."""
    words, hashes, style = _parts(block)
    h = np.concatenate([x[x > 0] for x in hashes] + style)
    row = np.concatenate([words.doc[x > 0] for x in hashes] + [np.arange(len(block))] * len(style))
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    return row[new], h[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch and feature: for each fault the documents that are labelled for it, and those with it."""
    for batch in batches:
        y = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in FAULTS])  # null: nan
        y = np.concatenate((~np.isnan(y), np.nan_to_num(y)))
        hs, ys = [], []
        for block in vectext.blocks(batch.column("bytes")):
            row, h = _features(block)
            hs.append(h)
            ys.append(y[:, block.first + row])
        if hs:
            key, of = np.unique(np.concatenate(hs), return_inverse=True)
            every = np.concatenate(ys, axis=1)
            sums = [np.bincount(of, weights=x, minlength=len(key)) for x in every]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *(pa.array(x.astype(np.int64)) for x in sums)], ["h", *(f"n_{f}" for f in FAULTS), *FAULTS])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two min-hashes of five-word shingles: copies mostly share one."""
    for batch in batches:
        got = []
        for block in vectext.blocks(batch.column("bytes")):
            words = vectext.Words(block)
            for lo, hi in zip(words.lo, words.hi, strict=True):
                g = vectext.grams(words.hash[lo:hi], int(min(5, max(1, hi - lo))))
                got.append((int(g.min() >> U64(1)), int(mix(g).min() >> U64(1))) if len(g) else (0, 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], [*batch.schema.names, "k1", "k2"])


class Evidence:
    """Sorted feature hashes and each fault's log ratios (0 where a fault isn't raised)."""

    def __init__(self, h: np.ndarray, weights: np.ndarray):
        o = np.argsort(h)
        self.h, self.weights = h[o], weights[:, o]
        self.filter = filters.Filter.of(self.h)

    def _of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.weights), len(h)))
        hit = self.filter.find(h)
        out[:, hit] = self.weights[:, np.searchsorted(self.h, h[hit])]
        return out

    def score(self, block: vectext.Block) -> np.ndarray:
        words, hashes, style = _parts(block)
        each = np.max([self._of(h) for h in hashes], axis=0)
        hit = np.flatnonzero(each.any(axis=0))
        _, first = np.unique(np.stack((words.doc[hit].astype(U64), words.hash[hit])), axis=1, return_index=True) if len(hit) else (0, hit)
        hit = hit[first]
        look = np.max([self._of(h) for h in style], axis=0)
        return np.stack([np.bincount(words.doc[hit], weights=w[hit], minlength=len(block)) for w in each]) + look


def _scores(held, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.score(block) for block in vectext.blocks(batch.column("bytes"))]
            s = np.concatenate(got, axis=1) if got else np.zeros((len(FAULTS), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x) for x in s)], [*keep, *(f"s_{f}" for f in FAULTS)])

    return run


def _ratios(n: np.ndarray, k: np.ndarray, total: int, faulty: int, significance: float, support: float) -> np.ndarray:
    """Log ratio of the feature's rate among faulty and other rows, where it is raised significantly, not by a few rows only, and often faulty."""
    if not faulty or faulty == total:
        return np.zeros(len(n))
    rate = faulty / total
    z = (k - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-9)
    ratio = np.log((k + 0.5) / (faulty + 1)) - np.log((n - k + 0.5) / (total - faulty + 1))
    return np.where((z >= significance) & (k >= max(5, support * faulty)) & (4 * k >= n), ratio, 0.0)


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    if not len(y):
        return 1.0, 0.0
    x = np.stack((s, np.ones(len(s))))
    b = np.array([1.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    start = b.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.1 * np.eye(2), x @ (y - p) - 0.1 * (b - start))
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 0.0)), float(b[1])


def fit(labelled: DataFrame, significance: float = 6.0, support: float = 0.02) -> tuple[Evidence, dict[str, tuple[float, float]]]:
    """Evidence weights from three quarters of the rows (doc_id, bytes, toxic, low), calibration from the rest.

    Of copies only one counts: a feature must be raised in independent documents.
    """
    spark = labelled.sparkSession
    shape = f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, bytes binary, toxic int, low int, k1 long, k2 long"
    labelled = labelled.select("doc_id", "bytes", *FAULTS).mapInArrow(_sketch, shape)
    for k in ("k1", "k2"):  # the copy of the smallest doc_id, however the rows are dealt
        labelled = labelled.groupBy(k).agg(F.min(F.struct(*[c for c in labelled.columns if c != k])).alias("x")).select(k, "x.*")
    labelled = frames.cut(labelled.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0))
    first = labelled.where("not part").select("bytes", *FAULTS)
    sizes = first.agg(*[F.count(f) for f in FAULTS], *[F.sum(f) for f in FAULTS]).first()
    total, faulty = ([int(x or 0) for x in sizes[i : i + len(FAULTS)]] for i in (0, len(FAULTS)))
    counts = first.mapInArrow(_count, "h long, n_toxic long, n_low long, toxic long, low long").groupBy("h").agg(*[F.sum(c).alias(c) for f in FAULTS for c in (f"n_{f}", f)])
    raised = F.lit(False)
    for f, n, k in zip(FAULTS, total, faulty, strict=True):
        rate, own = k / n if n else 0.0, F.col(f"n_{f}")
        raised = raised | (own >= 5) & (F.col(f) > own * rate + significance * F.sqrt(own * (rate * (1 - rate))))
    got = counts.where(raised).toPandas()  # features of a bounded number of rows that stand out
    weights = np.stack([_ratios(got[f"n_{f}"].to_numpy(np.float64), got[f].to_numpy(np.float64), n, k, significance, support) for f, n, k in zip(FAULTS, total, faulty, strict=True)])
    use = (weights > 0).any(axis=0)
    evidence = Evidence(got["h"].to_numpy(np.int64).view(U64)[use], weights[:, use])
    held = spark.sparkContext.broadcast(evidence)
    rest = labelled.where("part").mapInArrow(_scores(held, list(FAULTS)), "toxic int, low int, s_toxic double, s_low double").toPandas()
    line = {}
    for f in FAULTS:
        y, s = rest[f].to_numpy(np.float64), rest[f"s_{f}"].to_numpy(np.float64)
        y, s = y[~np.isnan(y)], s[~np.isnan(y)]
        a, b = _logistic(s, y)
        line[f] = (a, b - math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))  # without the sample's own prior
    return evidence, line


def site_rates(labelled: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Rates by (host, path), shrunk toward the host's and that toward the global rate; and the global rates."""
    both = [c for f in FAULTS for c in (f"n_{f}", f)]
    path = frames.cut(labelled.groupBy("host", "path").agg(*[x for f in FAULTS for x in (F.count(f).alias(f"n_{f}"), F.coalesce(F.sum(f), F.lit(0)).alias(f))]))
    host = path.groupBy("host").agg(*[F.sum(c).alias(c) for c in both])
    row = path.agg(*[F.sum(c).alias(c) for c in both]).first()
    base = {f: ((row[f] or 0) + 0.5) / ((row[f"n_{f}"] or 0) + 1) for f in FAULTS}

    def strength(df: DataFrame, mean) -> dict[str, float]:
        """Prior weight in rows: rate variance within over the variance between sites beyond chance."""
        of = lambda f, x: F.sum(F.when(F.col(f"n_{f}") > 1, x))
        r = df.agg(*[x.alias(f"{f}{i}") for f in FAULTS for n in (F.col(f"n_{f}"),) for i, x in enumerate((of(f, F.pow(F.col(f) / n - mean(f), 2) * n), of(f, mean(f) * (1 - mean(f))), of(f, n)))]).first()
        out = {}
        for f in FAULTS:
            seen, chance, rows = (float(r[f"{f}{i}"] or 0) for i in range(3))
            between = (seen - chance) / rows if rows else 0.0
            within = base[f] * (1 - base[f])
            out[f] = min(1e4, max(2.0, within / between)) if between > 0 else 1e4
        return out

    mh = strength(host, lambda f: F.lit(base[f]))
    host = host.select("host", *[((F.col(f) + mh[f] * base[f]) / (F.col(f"n_{f}") + mh[f])).alias(f"h_{f}") for f in FAULTS])
    path = path.join(host, path["host"].eqNullSafe(host["host"])).drop(host["host"])
    mp = strength(path, lambda f: F.col(f"h_{f}"))
    path = path.select("host", "path", *[f"h_{f}" for f in FAULTS], *[((F.col(f) + mp[f] * F.col(f"h_{f}")) / (F.col(f"n_{f}") + mp[f])).alias(f"r_{f}") for f in FAULTS])
    return path, base


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, max_fit: int = 20_000) -> DataFrame:
    """Each row's doc_id, text_hash, site rates (r_toxic, r_low), p_toxic, p_low and kept.

    host and path default to the source, and the language below it.
    """
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    src = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), host.cast("string").alias("host"), path.cast("string").alias("path"), frames.text_bytes().alias("bytes"))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"), F.max((F.col("quality") < 1).cast("int")).alias("low")).where("toxic is not null or low is not null")
    told = frames.cut(told)
    n = told.count()
    share = int(min(1.0, max_fit / max(1, n)) * (1 << 20))
    some = told.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share)
    evidence, line = fit(src.select("doc_id", "bytes").join(F.broadcast(some), "doc_id"))
    sites, base = site_rates(src.select("doc_id", "host", "path").join(F.broadcast(told) if n <= frames.BROADCAST_ROWS else told, "doc_id"))
    held = spark.sparkContext.broadcast(evidence)
    rows = src.mapInArrow(_scores(held, ["doc_id", "text_hash", "host", "path"]), f"doc_id {kind}, text_hash long, host string, path string, s_toxic double, s_low double")
    m = sites.count()
    sites = sites.withColumnRenamed("host", "h").withColumnRenamed("path", "p")
    rows = rows.join(F.broadcast(sites) if m <= frames.BROADCAST_ROWS // 8 else sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    for f in FAULTS:
        rate = F.coalesce(f"r_{f}", F.lit(base[f]))
        a, b = line[f]
        odds = a * F.col(f"s_{f}") + b + F.log(rate / (1 - rate))
        rows = rows.withColumn(f"r_{f}", F.round(rate, 9)).withColumn(f"p_{f}", F.round(1 / (1 + F.exp(-odds)), 9))
    kept = (F.col("p_toxic") < 0.5) & (F.col("p_low") < 0.5) if n else F.lit(True)
    return rows.select("doc_id", "text_hash", "host", "path", "r_toxic", "r_low", "p_toxic", "p_low", kept.alias("kept"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept documents; all columns stay. Rows are named by doc_id and a hash of the text."""
    bad = frames.cut(judge(docs, labels, **options).where("not kept").select(F.col("doc_id").alias("__corpusmill_id"), F.col("text_hash").alias("__corpusmill_of")).distinct())
    n = bad.count()
    named = docs.withColumn("__corpusmill_hash", F.xxhash64("text"))
    return named.join(F.broadcast(bad) if n <= frames.BROADCAST_ROWS else bad, F.col("doc_id").eqNullSafe(F.col("__corpusmill_id")) & (F.col("__corpusmill_hash") == F.col("__corpusmill_of")), "left_anti").drop("__corpusmill_hash")
