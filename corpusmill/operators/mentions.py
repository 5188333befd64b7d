"""Mentions of entities: extraction by windows, policies, comparisons of builds, and checks of annotations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import scores, text

#: A model: a text and its (start, end, kind, score).
Model = Callable[[str], list[tuple[int, int, str, float]]]


def extract(docs: DataFrame, key: str, column: str, model: Model, width: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, s, e, kind, score): a model's mentions over overlapping windows of characters, the best score of each span.

    A mention cut off by a window's end is found in the next one if it is no longer than the overlap.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[column], strict=True):
                t, best = t or "", {}
                for at in range(0, max(1, len(t) - overlap), width - overlap):
                    for s, e, name, score in model(t[at : at + width]):
                        span = (s + at, e + at, name)
                        best[span] = max(score, best.get(span, score))
                rows += [(k, s, e, name, score) for (s, e, name), score in best.items()]
            yield pd.DataFrame(rows, columns=["key", "s", "e", "kind", "score"])

    return docs.select(key, column).mapInPandas(run, f"key {kind}, s long, e long, kind string, score double").withColumnRenamed("key", key)


def selected(mentions: DataFrame, thresholds: dict[str, float], default: float, parent: str, build: str) -> DataFrame:
    """Mentions at or above their kind's threshold, with a new evidence_id, the parent's, and the builds; mention_id stays."""
    bar = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("kind")), F.lit(default)) if thresholds else F.lit(default)
    rows = mentions.where(F.col("score") >= bar)
    new = F.concat(F.lit("sha256:"), text.stable_hash(F.concat_ws("|", F.lit(build), F.col("mention_id"))))
    return rows.withColumn("parent_evidence_id", F.col("evidence_id")).withColumn("evidence_id", new).withColumn("parent_build", F.lit(parent)).withColumn("build", F.lit(build))


def expect(df: DataFrame, rows: int) -> DataFrame:
    """The frame, if it has so many rows."""
    if (n := df.count()) != rows:
        raise ValueError(f"{n} rows where {rows} are expected")
    return df


def per_class(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1) for each class, null where there is nothing to divide by; and kind null: over all."""
    each = df.select(F.inline(F.array(F.struct(F.col(truth).alias("kind"), (F.col(truth) == F.col(said)).cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.col(truth).eqNullSafe(F.col(said))).cast("int").alias("fn")), F.struct(F.col(said).alias("kind"), F.lit(0).alias("tp"), (~F.col(truth).eqNullSafe(F.col(said))).cast("int").alias("fp"), F.lit(0).alias("fn"))))).where("kind is not null")
    sums = each.rollup("kind").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("tp", "fp", "fn")])
    rate = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(other)), 6))
    return sums.withColumn("precision", rate("fp")).withColumn("recall", rate("fn")).withColumn("f1", scores.f_beta(F.col("precision"), F.col("recall"), 1.0))


def macro_f1(classes: DataFrame) -> DataFrame:
    """(macro_f1, classes): the mean over classes with reference support; null unless all have an F1."""
    own = classes.where("kind is not null and tp + fn > 0")
    return own.agg(F.when(F.count("f1") == F.count(F.lit(1)), F.round(F.avg("f1"), 6)).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def revision(df: DataFrame, truth: Column, base: Column, candidate: Column) -> DataFrame:
    """(cases, corrected, regressed, net, regression_rate): a candidate against a baseline."""
    was, now = F.coalesce(base == truth, F.lit(False)), F.coalesce(candidate == truth, F.lit(False))
    out = df.agg(F.count(F.lit(1)).alias("cases"), F.count_if(~was & now).alias("corrected"), F.count_if(was & ~now).alias("regressed"), F.count_if(was).alias("_was"))
    return out.select("cases", "corrected", "regressed", (F.col("corrected") - F.col("regressed")).alias("net"), F.when(F.col("_was") > 0, F.round(F.col("regressed") / F.col("_was"), 6)).alias("regression_rate"))


def margin_sweep(df: DataFrame, truth: Column, base: Column, candidate: Column, margin: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, changed, corrected, regressed): the candidate counts only where its margin reaches the threshold. One pass."""
    was, now = base == truth, candidate == truth
    aggs = []
    for i, x in enumerate(thresholds):
        on = (margin >= x) & (base != candidate)
        aggs += [F.count_if(on).alias(f"n{i}"), F.count_if(on & ~was & now).alias(f"c{i}"), F.count_if(on & was & ~now).alias(f"r{i}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"n{i}").alias("changed"), F.col(f"c{i}").alias("corrected"), F.col(f"r{i}").alias("regressed")) for i, x in enumerate(thresholds)])))


def annotation_faults(template: DataFrame, completed: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(rule, key): rows missing, not asked for, given twice, changed in a fixed column, or not complete."""
    fault = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    was = template.select(key, *[F.col(c).alias(f"_{c}") for c in fixed])
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = fault("missing", template.join(completed, key, "left_anti")).unionByName(fault("unknown", completed.join(template, key, "left_anti")))
    out = out.unionByName(fault("twice", completed.groupBy(key).count().where("count > 1")))
    return out.unionByName(fault("changed", completed.join(was, key).where(~same))).unionByName(fault("incomplete", completed.where(~F.coalesce("complete", F.lit(False)))))


def overlap_panel(gold: DataFrame, predicted: DataFrame, by: str, relaxed: float = 0.5) -> DataFrame:
    """(typed, relaxed, tp, predicted, reference): best-overlap pairs of each text, each span once, by kind or not and by exact or relaxed bounds.

    gold has ``uncertain``; a prediction that overlaps uncertain spans only is left out. Pairs are taken where each is the other's best.
    """
    g = gold.select(F.col(by).alias("k"), F.col("lo").alias("glo"), F.col("hi").alias("ghi"), F.col("kind").alias("gkind"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
    p = predicted.select(F.col(by).alias("k"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("kind").alias("pkind"))
    pairs = p.join(g, "k").where("glo < phi and plo < ghi").withColumn("iou", (F.least("ghi", "phi") - F.greatest("glo", "plo")) / (F.greatest("ghi", "phi") - F.least("glo", "plo")))
    sure = pairs.groupBy("k", "plo", "phi", "pkind").agg(F.min("uncertain").alias("only_uncertain"))
    kept = p.join(sure, ["k", "plo", "phi", "pkind"], "left").where(~F.coalesce("only_uncertain", F.lit(False)))
    n, m = kept.agg(F.count(F.lit(1)).alias("predicted")), g.where("not uncertain").agg(F.count(F.lit(1)).alias("reference"))
    rows = pairs.where("not uncertain")
    out = None
    for typed in (True, False):
        for loose in (True, False):
            ok = rows.where((F.col("gkind") == F.col("pkind")) if typed else F.lit(True)).where((F.col("iou") >= relaxed) if loose else (F.col("iou") == 1))
            mine = F.row_number().over(Window.partitionBy("k", "plo", "phi", "pkind").orderBy(F.desc("iou"), "glo", "ghi", "gkind"))
            its = F.row_number().over(Window.partitionBy("k", "glo", "ghi", "gkind").orderBy(F.desc("iou"), "plo", "phi", "pkind"))
            tp = ok.withColumn("a", mine).withColumn("b", its).where("a = 1 and b = 1").agg(F.count(F.lit(1)).alias("tp"))
            row = tp.join(n).join(m).select(F.lit(typed).alias("typed"), F.lit(loose).alias("relaxed"), "tp", "predicted", "reference")
            out = row if out is None else out.unionByName(row)
    return out
