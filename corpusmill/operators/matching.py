"""One-to-one matching of spans: optimal assignment, and greedy evaluation in phases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of largest total weight among the largest matchings; entries that aren't positive can't be used.

    Shortest augmenting paths with potentials over a square cost matrix.
    """
    n = max(weight.shape) if weight.size else 0
    if not n:
        return []
    big = 1e6
    cost = np.full((n, n), big)
    cost[: weight.shape[0], : weight.shape[1]] = np.where(weight > 0, 1.0 - weight / (weight.max() + 1.0), big)
    u, v, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        col, owner[n] = n, row
        least, came, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, dtype=bool)
        while owner[col] != -1:
            done[col] = True
            r = owner[col]
            slack = cost[r] - u[r] - v[:n]
            better = ~done[:n] & (slack < least)
            least[better], came[better] = slack[better], col
            nxt = int(np.argmin(np.where(done[:n], np.inf, least)))
            step = least[nxt]
            used = np.flatnonzero(done)
            u[owner[used]] += step
            v[used] -= step
            least[~done[:n]] -= step
            col = nxt
        while col != n:
            owner[col] = owner[came[col]]
            col = came[col]
    return sorted((int(owner[c]), c) for c in range(weight.shape[1]) if owner[c] < weight.shape[0] and weight[owner[c], c] > 0)


def _iou(a, b) -> float:
    inter = min(a.hi, b.hi) - max(a.lo, b.lo)
    return inter / (max(a.hi, b.hi) - min(a.lo, b.lo)) if inter > 0 else 0.0


def optimal_pairs(gold: DataFrame, predicted: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """(by, gold lo, predicted lo, iou): the matching of each text's spans (lo, hi) with the most pairs, then the largest overlap."""

    def run(key, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        a, b = list(g.sort_values(["lo", "hi"]).itertuples()), list(p.sort_values(["lo", "hi"]).itertuples())
        w = np.array([[_iou(x, y) if _iou(x, y) >= threshold else 0.0 for y in b] for x in a]).reshape(len(a), len(b))
        return pd.DataFrame([(key[0], a[i].lo, b[j].lo, round(w[i, j], 6)) for i, j in best_assignment(w)], columns=["key", "gold_lo", "predicted_lo", "iou"])

    return gold.groupBy(by).cogroup(predicted.groupBy(by)).applyInPandas(run, f"key {gold.schema[by].dataType.simpleString()}, gold_lo long, predicted_lo long, iou double")


PHASES = ("exact", "relaxed", "type_mismatch", "boundary_mismatch")


def evaluate(gold: DataFrame, predicted: DataFrame, by: str, relaxed: float = 0.5) -> DataFrame:
    """(key, outcome, gold_lo, predicted_lo): each span in one outcome.

    Phases in order, each greedy by overlap then place: same type and bounds; same type and overlap of at least
    ``relaxed``; other type; same type and less overlap. What is left is a false negative or a false positive.
    """

    def run(key, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        a, b = list(g.sort_values(["lo", "hi", "kind"]).itertuples()), list(p.sort_values(["lo", "hi", "kind"]).itertuples())
        pairs = sorted(((-_iou(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if _iou(x, y) > 0))
        tests = {
            "exact": lambda x, y, s: x.kind == y.kind and s == 1.0,
            "relaxed": lambda x, y, s: x.kind == y.kind and s >= relaxed,
            "type_mismatch": lambda x, y, s: x.kind != y.kind and s >= relaxed,
            "boundary_mismatch": lambda x, y, s: x.kind == y.kind,
        }
        left, right, out = set(range(len(a))), set(range(len(b))), []
        for phase in PHASES:
            for s, i, j in pairs:
                if i in left and j in right and tests[phase](a[i], b[j], -s):
                    left.discard(i)
                    right.discard(j)
                    out.append((key[0], phase, a[i].lo, b[j].lo))
        out += [(key[0], "false_negative", a[i].lo, None) for i in sorted(left)] + [(key[0], "false_positive", None, b[j].lo) for j in sorted(right)]
        return pd.DataFrame(out, columns=["key", "outcome", "gold_lo", "predicted_lo"]).astype({"gold_lo": "Int64", "predicted_lo": "Int64"})

    return gold.groupBy(by).cogroup(predicted.groupBy(by)).applyInPandas(run, f"key {gold.schema[by].dataType.simpleString()}, outcome string, gold_lo long, predicted_lo long")
