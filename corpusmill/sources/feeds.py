"""State of polled feeds: kinds of errors, cooldowns and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an error's text tells, in order, and minutes to wait by kind.
ERRORS = [("rate_limited", ["429", "rate exceeded"]), ("service_unavailable", ["503", "service unavailable"]), ("timeout", ["timeout", "timed out"]), ("network_error", ["nameresolutionerror", "failed to resolve", "getaddrinfo failed", "connectionerror", "maxretryerror"])]
COOLDOWN = {"rate_limited": 60, "service_unavailable": 30, "timeout": 15, "network_error": 15}


def error_kind(said: Column) -> Column:
    t = F.lower(said)
    out = F.when(t.isNull(), None)
    for kind, parts in ERRORS:
        test = F.lit(False)
        for p in parts:
            test = test | t.contains(p)
        out = out.when(test, kind)
    return out.otherwise("fatal_error")


def cooldown_minutes(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COOLDOWN.items() for x in kv]), kind), F.lit(0))


def advanced(batches: DataFrame, profile: str, fetched: str, size: int) -> DataFrame:
    """(profile, next_start, documents, failures, runs): where each profile's cursor stands after its batches; a failed one (null) doesn't move it."""
    ok = F.col(fetched).isNotNull()
    return batches.groupBy(profile).agg((F.count_if(ok) * size).alias("next_start"), F.coalesce(F.sum(fetched), F.lit(0)).alias("documents"), F.count_if(~ok).alias("failures"), F.count(F.lit(1)).alias("runs"))
