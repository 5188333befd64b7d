"""Sets and tables of 64-bit hashes that tasks hold: a bitmap probed twice, and exact keys where they are few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import frames
from corpusmill.llm.vectext import U64

#: A bitmap has no more bits than these; beyond, it lets more pass, and what passes is joined exactly.
FILTER_BITS = 1 << 30
#: Up to so many keys are also held as a sorted list, and so tested exactly.
EXACT_KEYS = 2_000_000
#: 64-bit words of a bitmap that the driver receives at a time.
SLICE = 1 << 20


class Places:
    """Where hashes stand among sorted keys: a hash's leading bits name the first key that can be it."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.heads = keys, None

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash that is a key; for others any place."""
        keys, bits = self.keys, len(self.keys).bit_length()
        if self.heads is None:  # not on the driver, so it is not sent
            self.heads = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
        last = len(keys) - 1
        at = np.minimum(self.heads[h >> U64(64 - bits)], last)
        late = np.flatnonzero(keys[at] < h)
        while len(late):
            at[late] += 1
            late = late[at[late] <= last]
            late = late[keys[at[late]] < h[late]]
        return np.minimum(at, last)


class Filter:
    """Which hashes are of interest."""

    def __init__(self, words: np.ndarray, keys: np.ndarray | None = None):
        self.words, self.keys, self.places = words, keys, None if keys is None else Places(keys)
        self.mask = U64(64 * len(words) - 1)

    @classmethod
    def of(cls, keys: np.ndarray) -> Filter:
        keys = np.unique(keys.view(U64))
        words = np.zeros(_bits(len(keys)) >> 6, dtype=U64)
        mask = U64(64 * len(words) - 1)
        for at in (keys & mask, (keys >> U64(32)) & mask):
            np.bitwise_or.at(words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        return cls(words, keys)

    def near(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that the bitmap lets pass."""
        at = h & self.mask
        hit = np.flatnonzero(self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1))
        at = (h[hit] >> U64(32)) & self.mask
        return hit[(self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes of interest; exact where the keys are held."""
        if self.keys is None:
            return self.near(h)
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64)
        hit = self.near(h)
        return hit[self.keys[self.places(h[hit])] == h[hit]]


class Table:
    """Values by hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        o = np.argsort(keys.view(U64))
        self.keys, self.values = keys.view(U64)[o], values[o]
        self.filter, self.places = Filter(Filter.of(self.keys).words), Places(self.keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that have a value, and the values."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), self.values
        hit = self.filter.near(h)
        at = self.places(h[hit])
        ok = self.keys[at] == h[hit]
        return hit[ok], self.values[at[ok]]


def _bits(n: int) -> int:
    return min(FILTER_BITS, max(1 << 16, 1 << int(32 * n).bit_length()))


def build(keys: DataFrame, n: int | None = None) -> Filter:
    """The filter of a frame's one column. Beyond EXACT_KEYS its bitmap is put together by Spark, and the driver receives it in slices."""
    keys = keys.toDF("k")
    if n is None:
        n = keys.count()
    if n <= EXACT_KEYS:
        return Filter.of(frames.fetch(keys)["k"].astype(np.int64))
    bits = _bits(n)
    at = keys.select(F.explode(F.array(F.col("k").bitwiseAND(bits - 1), F.shiftrightunsigned("k", 32).bitwiseAND(bits - 1))).alias("at"))
    words = frames.cut(at.groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w")))
    out = np.zeros(bits >> 6, dtype=U64)
    for lo in range(0, len(out), SLICE):
        part = frames.fetch(words.where((F.col("at") >= lo) & (F.col("at") < lo + SLICE)))
        out[part["at"].astype(np.int64)] = part["w"].astype(np.int64).view(U64)
    frames.release(words)
    return Filter(out)
