"""Canonical records from source observations: merge rules as data, compiled to one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """How a field's values become one.

    preferred: largest (priority of the source, length if longer, value); longest: most characters, then priority, then
    first; first: first non-empty in input order; min, max; any: true if any is true, else false if any is false, else
    null; union: ordered distinct list in any case, first spelling; count and distinct count rows and values.
    """

    name: str
    how: str
    priority: dict[str, int] = field(default_factory=dict)
    longer: bool = False


def priority(source: Column, ranks: dict[str, int]) -> Column:
    if not ranks:
        return F.lit(0)
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), source), F.lit(0))


def _compiled(rule: Rule, source: str, seq: str) -> Column:
    c = F.col(rule.name)
    there = c.isNotNull() & (F.trim(c.cast("string")) != "")
    rank = priority(F.col(source), rule.priority)
    value = {
        "preferred": lambda: F.max(F.when(there, F.struct(rank.alias("p"), F.length(c) if rule.longer else F.lit(0), c.alias("v"))))["v"],
        "longest": lambda: F.max_by(c, F.when(there, F.struct(F.length(c), rank, -F.col(seq)))),
        "first": lambda: F.min_by(c, F.when(there, F.col(seq))),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "any": lambda: F.bool_or(c),
        "union": lambda: F.aggregate(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), c.alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>")))),
            F.array().cast("array<string>"),
            lambda acc, v: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))),
        ),
        "count": lambda: F.count(F.lit(1)),
        "distinct": lambda: F.countDistinct(c),
    }[rule.how]()
    return value.alias(rule.name if rule.how not in ("count", "distinct") else f"{rule.name}_{rule.how}")


def reconcile(observations: DataFrame, key: str, rules: list[Rule], source: str = "source", seq: str = "seq") -> DataFrame:
    """One row for each key; a single shuffle on the key."""
    return observations.groupBy(key).agg(*[_compiled(r, source, seq) for r in rules])


def richness(present: dict[str, float], capped: dict[str, tuple[str, int]]) -> Column:
    """Additive score: weights of present fields, and sizes of lists or maps up to a cap."""
    total = F.lit(0.0)
    for name, weight in present.items():
        c = F.col(name)
        total = total + F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), weight).otherwise(0.0)
    for name, (kind, cap) in capped.items():
        n = F.size(name) if kind == "size" else F.length(name)
        total = total + F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(cap))
    return total
