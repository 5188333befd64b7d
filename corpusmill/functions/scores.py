"""Column builders for scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def log_score(c: Column, cap: float) -> Column:
    return clamp01(F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))) / F.log1p(F.lit(float(cap))))


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of clamped signals by positive weight, 6 places."""
    use = {k: w for k, w in weights.items() if w > 0 and k in signals}
    if not use:
        return F.lit(0.0)
    return F.round(reduce(lambda a, b: a + b, [clamp01(signals[k]) * w for k, w in use.items()]) / sum(use.values()), 6)


def recency(year: Column, current: int, window: int) -> Column:
    return F.coalesce(clamp01((year - (current - window)) / F.lit(float(window))), F.lit(0.0))


def completeness(*present: Column) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(False)).cast("int") for p in present]) / len(present), 4)


def confidence(base: Column, context: Column) -> Column:
    return F.round(F.least(F.greatest(base, context), F.lit(1.0)), 4)


def minmax(score: Column, w: WindowSpec) -> Column:
    """(x - min) / (max - min) over a candidate set; a constant set is all 1."""
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(score.isNull(), None).when(F.abs(hi - lo) < 1e-12, 1.0).otherwise((score - lo) / (hi - lo))


def result_recency(year: Column, w: WindowSpec) -> Column:
    lo, hi = F.min(year).over(w), F.max(year).over(w)
    return F.when(year.isNull(), 0.0).when(hi == lo, 1.0).otherwise((year - lo) / (hi - lo))


def source_support(n: Column, w: WindowSpec) -> Column:
    hi = F.max(n).over(w)
    return F.when(n <= 0, 0.0).when(hi <= 1, 1.0).otherwise((n - 1) / (hi - 1))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(precision.isNull() | recall.isNull(), None).when(b * precision + recall == 0, 0.0).otherwise(F.round((1 + b) * precision * recall / (b * precision + recall), 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def by_set(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)
