"""Similarity join of names by the sequence-match ratio, without holding all pairs against each other.

The ratio of two strings is 2M/T: M characters in matching blocks, T the sum of their lengths. For a ratio of t or more:

* lengths: the shorter is at least t/(2-t) of the longer;
* characters: at least t*T/2 are common, as multisets;
* pairs of characters: blocks are no more than the unmatched characters and one, and a block of k characters keeps k-1
  pairs, so at least T*(1.5t-1)-1 are common, as multisets.

Distinct names are indexed by the rarest of their pairs, as many as must be looked at to meet a common one (prefix filter);
names so short that no common pair is sure, and those that may match them, by their rarest characters. Candidates
pass the length and count filters on built-in functions; only what is left goes to the exact ratio, in batches.
Equal names are one row until the end.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _numbered(items: Column) -> Column:
    """Each item with how often it came before, so that sets of these compare as multisets."""
    seen = F.array_sort(items)
    return F.transform(seen, lambda x, i: F.struct(x.alias("g"), (i - F.array_position(seen, x) + 1).cast("int").alias("i")))


def _grams(name: Column, n: int) -> Column:
    return F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _needed(total: Column, n: int, t: float) -> Column:
    """How many grams two names of this total length must share."""
    sure = total * (t / 2) if n == 1 else total * (1.5 * t - 1) - 1
    return F.ceil(sure - 1e-9).cast("int")


def _candidates(names: DataFrame, n: int, t: float) -> DataFrame:
    """(block, a, b): pairs of names, a before b, that share a gram of their prefixes and pass the filters."""
    rows = names.withColumn("grams", _numbered(_grams(F.col("name"), n))).withColumn("len", F.length("name"))
    each = rows.select("block", "name", "len", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    least = F.ceil(F.col("len") * (t / (2 - t)) - 1e-9)
    reach = F.col("len") - (n - 1) - _needed(F.col("len") + least, n, t) + 1
    w = Window.partitionBy("block", "name").orderBy("often", "gram")
    prefix = each.join(often, "gram").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= reach).select("block", "gram", "name", "len", "nth")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = (F.col("x.name") < F.col("y.name")) & (F.least("x.len", "y.len") >= F.greatest("x.len", "y.len") * (t / (2 - t)) - 1e-9)
    pairs = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.gram") == F.col("y.gram")) & near).select(F.col("x.block").alias("block"), F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    common = F.size(F.array_intersect(_numbered(_grams(F.col("a"), n)), _numbered(_grams(F.col("b"), n))))
    total = F.length("a") + F.length("b")
    pairs = pairs.where(common >= _needed(total, n, t))
    if n == 2:
        pairs = pairs.where(F.size(F.array_intersect(_numbered(_grams(F.col("a"), 1)), _numbered(_grams(F.col("b"), 1)))) >= _needed(total, 1, t))
    return pairs


def _similar(df: DataFrame, name: str, threshold: float, block: list[str]) -> DataFrame:
    """(block columns, a, b, ratio) for both orders of two names, as the ratio may depend on the order."""
    if not 2 / 3 < threshold <= 1:
        raise ValueError("a threshold above 2/3 and at most 1")
    names = df.where(F.coalesce(name, F.lit("")) != "").select(F.struct(*block).alias("block"), F.col(name).alias("name")).distinct()
    short = int(2 / ((1 + threshold / (2 - threshold)) * (1.5 * threshold - 1))) + 1  # names up to here may share no pair
    size = F.length("name")
    found = [_candidates(names.where(size > short), 2, threshold), _candidates(names.where(size <= short * (2 - threshold) / threshold + 1), 1, threshold)]
    pairs = reduce(DataFrame.unionByName, found).distinct()
    pairs = pairs.select("block", F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return pairs.withColumn("ratio", F.round(ratio("a", "b"), 6)).where(F.col("ratio") >= threshold).select(*[F.col(f"block.{c}").alias(c) for c in block], "a", "b", "ratio")


def similar(df: DataFrame, name: str, threshold: float, block: list[str]) -> DataFrame:
    """(block columns, a, b, ratio): distinct names of one block, a before b, with a ratio of ``threshold`` or more. Null and empty names match none.

    threshold: above 2/3, where pairs of characters tell something.
    """
    return _similar(df, name, threshold, block).where("a < b")


def pairs_of_rows(df: DataFrame, key: str, name: str, threshold: float, block: list[str]) -> DataFrame:
    """(a, b, ratio): keys of rows, a below b, whose names are similar, in that order, or equal; copies are joined at the end."""
    rows = df.where(F.coalesce(name, F.lit("")) != "").select(*block, F.col(key).alias("_key"), F.col(name).alias("_name"))
    one, two = rows.withColumnsRenamed({"_key": "_k1", "_name": "a"}), rows.withColumnsRenamed({"_key": "_k2", "_name": "b"})
    same = one.join(two.withColumnRenamed("b", "a"), [*block, "a"]).where("_k1 < _k2").select("_k1", "_k2", F.lit(1.0).alias("ratio"))
    near = _similar(df, name, threshold, block).join(one, [*block, "a"]).join(two, [*block, "b"]).where("_k1 < _k2")
    return same.unionByName(near.select("_k1", "_k2", "ratio")).select(F.col("_k1").alias("a"), F.col("_k2").alias("b"), "ratio")
