"""Comparisons of retrieval runs: modes, variants, rankings and repeats. Runs are rows (run, query_id, key, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite(recall: Column, ndcg: Column, mrr: Column) -> Column:
    return F.round(0.4 * recall + 0.4 * ndcg + 0.2 * mrr, 6)


def top_lists(runs: DataFrame, k: int) -> DataFrame:
    """(run, query_id, ids): at most k keys in order of rank."""
    near = runs.where(F.col("rank") <= k)
    return near.groupBy("run", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("ids"))


def summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of the metrics that didn't fail, latency, and the share of empty results. metrics: by, recall, ndcg, mrr, latency, results, error."""
    ok = F.col("error").isNull()
    mean = lambda c: F.round(F.avg(F.when(ok, F.col(c))), 6).alias(c)
    at = lambda q, name: F.round(F.round(F.percentile(F.when(ok, F.col("latency")), q), 6), 3).alias(name)
    out = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.count_if(~ok).alias("errors"), mean("recall"), mean("ndcg"), mean("mrr"), at(0.5, "p50"), at(0.95, "p95"), F.round(F.avg(F.when(ok, (F.col("results") == 0).cast("double"))), 6).alias("empty"))
    return out.withColumn("composite", composite(F.col("recall"), F.col("ndcg"), F.col("mrr")))


def pairwise(modes: DataFrame, mode: str, metrics: list[str]) -> DataFrame:
    """(a, b, metric, delta, winner) for each pair of modes."""
    x, y = modes.alias("x"), modes.alias("y")
    j = x.join(y, F.col(f"x.{mode}") < F.col(f"y.{mode}"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"x.{m}") - F.col(f"y.{m}"), 6).alias("delta")) for m in metrics])
    rows = j.select(F.col(f"x.{mode}").alias("a"), F.col(f"y.{mode}").alias("b"), F.inline(each))
    return rows.withColumn("winner", F.when(F.col("delta") > 0, F.col("a")).when(F.col("delta") < 0, F.col("b")).otherwise("tie"))


def query_winners(metrics: DataFrame, run: str, score: str) -> DataFrame:
    """(query_id, winner, score, margin): the best run of each query, ties by name, and its lead."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), run)
    rows = metrics.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_n = 1")
    return rows.select("query_id", F.col(run).alias("winner"), F.col(score).alias("score"), F.round(F.col(score) - F.coalesce("_next", F.col(score)), 6).alias("margin"))


def flag_effects(variants: DataFrame, same: list[str], flag: str, metrics: list[str]) -> DataFrame:
    """Metrics with a flag less those without it, among variants equal otherwise."""
    on, off = (variants.where(F.col(flag) == v).select(*same, *[F.col(m).alias(f"_{m}{int(v)}") for m in metrics]) for v in (True, False))
    return on.join(off, same).select(*same, *[F.round(F.col(f"_{m}1") - F.col(f"_{m}0"), 6).alias(m) for m in metrics])


def ranking_effects(before: DataFrame, after: DataFrame, grades: DataFrame, k: int, tolerance: float = 1e-9) -> DataFrame:
    """(query_id, effect, added, removed): what a ranking did to the relevant keys among the first k.

    In order: insufficient_labels, ranking_removed_relevant_from_top_k, ranking_added_relevant_to_top_k, then by the sum of
    grades over log2 of the rank: ranking_hurt_order, ranking_helped; then ranking_no_effect or tie_or_boundary_effect.
    """
    lists = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias(name))
    gain = lambda df, name: df.where(F.col("rank") <= k).join(grades.where("grade > 0"), ["query_id", "key"]).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias(name))
    good = grades.where("grade > 0").groupBy("query_id").agg(F.array_sort(F.collect_list("key")).alias("good"))
    labelled = grades.select("query_id").distinct().withColumn("labelled", F.lit(True))
    j = lists(before, "b").join(lists(after, "a"), "query_id", "full_outer").join(good, "query_id", "left").join(labelled, "query_id", "left").join(gain(before, "gb"), "query_id", "left").join(gain(after, "ga"), "query_id", "left")
    b, a, g = (F.coalesce(c, F.slice(F.coalesce("a", "b"), 1, 0)) for c in ("b", "a", "good"))
    removed, added = F.array_except(F.array_intersect(b, g), a), F.array_except(F.array_intersect(a, g), b)
    delta = F.coalesce("ga", F.lit(0.0)) - F.coalesce("gb", F.lit(0.0))
    effect = F.when(F.col("labelled").isNull(), "insufficient_labels").when(F.size(removed) > 0, "ranking_removed_relevant_from_top_k").when(F.size(added) > 0, "ranking_added_relevant_to_top_k").when(delta < -tolerance, "ranking_hurt_order").when(delta > tolerance, "ranking_helped").when(a == b, "ranking_no_effect").otherwise("tie_or_boundary_effect")
    return j.select("query_id", effect.alias("effect"), F.size(added).alias("added"), F.size(removed).alias("removed"))


def pool_sensitivity(smaller: DataFrame, larger: DataFrame, k: int) -> DataFrame:
    """By query: candidates that both pools have, how their scores moved, and what the first k have in common."""
    a, b = smaller.select("query_id", "key", F.col("score").alias("sa"), F.col("rank").alias("ra")), larger.select("query_id", "key", F.col("score").alias("sb"), F.col("rank").alias("rb"))
    j = a.join(b, ["query_id", "key"])
    gap = F.abs(F.col("sb") - F.col("sa"))
    near = (F.col("ra") <= k) & (F.col("rb") <= k)
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg(gap), 6).alias("mean_change"), F.round(F.max(gap), 6).alias("max_change"), F.count_if(gap > 1e-12).alias("changed"), F.count_if(near).alias("overlap"), F.round(F.count_if(near) / k, 6).alias("overlap_ratio"), (F.count_if(near & (F.col("ra") == F.col("rb"))) == k).alias("same_order"))


def mismatches(reference: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """(query_id, missed, replacement, missed_rank, replacement_rank, gap): keys that only the reference has among its first k, against those that only the candidate has; ranks and scores by the reference. At most k * k rows a query."""
    first = lambda df: df.where(F.col("rank") <= k)
    missed = first(reference).join(first(candidate), ["query_id", "key"], "left_anti").select("query_id", F.col("key").alias("missed"), F.col("rank").alias("missed_rank"), F.col("score").alias("_m"))
    new = first(candidate).join(first(reference), ["query_id", "key"], "left_anti").select("query_id", F.col("key").alias("replacement"))
    ranked = reference.select("query_id", F.col("key").alias("replacement"), F.col("rank").alias("replacement_rank"), F.col("score").alias("_r"))
    return missed.join(new.join(ranked, ["query_id", "replacement"], "left"), "query_id").select("query_id", "missed", "replacement", "missed_rank", "replacement_rank", F.round(F.col("_m") - F.col("_r"), 6).alias("gap"))


def determinism(runs: DataFrame, k: int) -> DataFrame:
    """(query_id, runs, deterministic, spread): whether repeats gave the same first k keys in the same order, and the largest difference of a key's score."""
    same = top_lists(runs, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("runs"), (F.countDistinct(F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256)) == 1).alias("deterministic"))
    spread = runs.where(F.col("rank") <= k).groupBy("query_id", "key").agg((F.max("score") - F.min("score")).alias("d")).groupBy("query_id").agg(F.round(F.max("d"), 6).alias("spread"))
    return same.join(spread, "query_id")


def pooled(runs: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """(query_id, key, best_rank, modes, position): the union of the modes' results for labelling, best rank first, then most modes, then title."""
    rows = runs.groupBy("query_id", "key").agg(F.min("rank").alias("best_rank"), F.countDistinct("run").alias("modes")).join(titles, "key", "left")
    w = Window.partitionBy("query_id").orderBy("best_rank", F.desc("modes"), F.asc_nulls_first("title"), "key")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).drop("title")


def relevance_grade(results: DataFrame, grades: DataFrame, strict: DataFrame, all_of: dict[str, list[str]], any_of: dict[str, list[str]], column: str) -> DataFrame:
    """Adds grade: the explicit one; 0 for other keys of a strictly judged query; else 1 if the text has all, or any, of the query's phrases."""
    j = results.join(grades, ["query_id", "key"], "left").join(strict.select("query_id").distinct().withColumn("_strict", F.lit(True)), "query_id", "left")
    t = F.lower(F.coalesce(F.col(column), F.lit("")))
    weak = F.lit(False)
    for q, phrases in all_of.items():
        test = F.lit(bool(phrases))
        for p in phrases:
            test = test & t.contains(p.lower())
        weak = weak | ((F.col("query_id") == q) & test)
    for q, phrases in any_of.items():
        for p in phrases:
            weak = weak | ((F.col("query_id") == q) & t.contains(p.lower()))
    return j.withColumn("grade", F.coalesce("grade", F.when(F.col("_strict"), 0).otherwise(weak.cast("int")))).drop("_strict")


def candidate_pool(top_k: int, offset: int, corpus: int) -> int:
    """How many candidates a search takes before it filters and pages."""
    return min(corpus, max(top_k + offset, 5 * top_k, 50))
