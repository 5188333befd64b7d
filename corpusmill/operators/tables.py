"""Relational operators: deduplication, change detection, joins, folds and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows; beyond it Spark chooses.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a check of the size; the check stops at the bound."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def argmax(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def change_kind(new: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """new, updated or unchanged, against a table of digests."""
    old = known.select(F.col(key), F.col(digest).alias("_old"))
    return new.join(old, key, "left").withColumn("change", F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "updated").otherwise("unchanged")).drop("_old")


def upsert(base: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both; the given columns are taken from the fresh side where it has the key."""
    a, b = base.alias("a"), fresh.alias("b")
    there = F.col(f"b.{key}").isNotNull()
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in columns else F.coalesce(f"a.{c}", f"b.{c}")).alias(c) for c in base.columns if c != key])


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status: added, removed, changed or same."""
    a, b = before.select(key, F.col(digest).alias("da")), after.select(F.col(key).alias("k2"), F.col(digest).alias("db"))
    j = a.join(b, F.col(key) == F.col("k2"), "full_outer")
    status = F.when(F.col("k2").isNull(), "removed").when(F.col(key).isNull(), "added").when(F.col("da") != F.col("db"), "changed").otherwise("same")
    return j.select(F.coalesce(key, "k2").alias(key), status.alias("status"))


def unique_key(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys that lead to one target only."""
    return df.groupBy(*keys).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")


def overlapping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of half-open spans (lo, hi) of the same text that intersect, with intersection and IoU."""
    x, y = a.alias("x"), b.alias("y")
    cond = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in on]) & (F.col("x.lo") < F.col("y.hi")) & (F.col("y.lo") < F.col("x.hi"))
    inter = F.least("x.hi", "y.hi") - F.greatest("x.lo", "y.lo")
    union = F.greatest("x.hi", "y.hi") - F.least("x.lo", "y.lo")
    return x.join(y, cond).select(*[F.col(f"x.{k}") for k in on], F.col("x.lo").alias("a_lo"), F.col("x.hi").alias("a_hi"), F.col("y.lo").alias("b_lo"), F.col("y.hi").alias("b_hi"), inter.alias("intersection"), F.round(inter / union, 6).alias("iou"))


def greedy_pairs(pairs: DataFrame, group: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """One-to-one assignment: pairs in order, each taken if both sides are free. A group is one text's candidates."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, take = set(), set(), []
        for i, r in enumerate(rows.sort_values(order, kind="stable").to_dict("records")):
            if r[a] not in left and r[b] not in right:
                left.add(r[a])
                right.add(r[b])
                take.append(r)
        return pd.DataFrame(take, columns=rows.columns)

    return pairs.groupBy(*group).applyInPandas(run, pairs.schema)


def top_counts(df: DataFrame, value: str, limit: int) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(value)).limit(limit)


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows in which each field is present; one pass."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields])).alias("x")).select("x.field", "x.present", F.round(F.col("x.present") / F.col("rows"), 6).alias("coverage"))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule; one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.rule", "x.violations")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("a page has at least one row and no negative offset")
    return df.orderBy(*order).offset(offset).limit(limit)


def optional(df: DataFrame, *tests: Column | None) -> DataFrame:
    """Conjunction of those tests that are given."""
    use = [t for t in tests if t is not None]
    return df.where(reduce(lambda a, b: a & b, use)) if use else df


def tri_state(flag: str, wanted: bool | None) -> Column | None:
    """None: no test; True and False both filter, null as False."""
    return None if wanted is None else F.coalesce(F.col(flag), F.lit(False)) == wanted


def one_sided(flag: str, wanted: bool) -> Column | None:
    """Only True filters."""
    return F.coalesce(F.col(flag), F.lit(False)) if wanted else None


def year_quota(df: DataFrame, year: str, order: list[Column], limit: int) -> DataFrame:
    """Up to limit rows, as even over years as the first years' remainder allows; years with fewer rows aren't refilled."""
    years = df.select(year).distinct().withColumn("_i", F.row_number().over(Window.orderBy(year))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    quota = F.floor(F.lit(limit) / F.col("_all")) + (F.col("_i") <= F.lit(limit) % F.col("_all")).cast("int")
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(year).orderBy(*order)))
    return ranked.join(small(years.withColumn("_q", quota).select(year, "_q")), year).where("_n <= _q").drop("_n", "_q")


def hash_sample(df: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """The n rows of each stratum with the least hash of seed and key."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return argmax_n(df.withColumn("selection_hash", h), [stratum], [F.asc("selection_hash")], n)


def argmax_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(rule, violations): rows beyond the first of each key."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("violations")).select(F.lit("duplicate_ids").alias("rule"), "violations")


def row_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rule, violations): by how many rows two tables differ."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a, "_a").join(n(b, "_b")).select(F.lit("same_rows").alias("rule"), F.abs(F.col("_a") - F.col("_b")).alias("violations"))


def by_text(*columns: str) -> list[Column]:
    """Order by the columns as texts, null as empty."""
    return [F.asc(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]


def holds(value: str, *lists: Column) -> Column:
    """Any of the lists has the value."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(c, value), F.lit(False)) for c in lists])


def parity(files: DataFrame, store: DataFrame, group: str, key: str) -> DataFrame:
    """(k, same_ids, same_pairs, missing) by group: counts of distinct keys and of rows on both sides."""
    n = lambda df, i: df.groupBy(F.col(group).alias("k")).agg(F.countDistinct(key).alias(f"n{i}"), F.count(F.lit(1)).alias(f"p{i}"))
    j = n(files, 0).join(n(store, 1), "k", "full_outer")
    return j.select("k", (F.col("n0") == F.col("n1")).alias("same_ids"), (F.col("p0") == F.col("p1")).alias("same_pairs"), (F.coalesce("p0", F.lit(0)) - F.coalesce("p1", F.lit(0))).alias("missing"))
