"""Labels of topic clusters from their words, and samples for audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import phrases, text
from corpusmill.operators.tables import hash_sample

# Weights of phrases by where they come from.
WEIGHTS = {"title": {3: 14.0, 2: 10.0, 1: 5.0}, "body": {3: 3.5, 2: 2.0, 1: 0.5}}


def candidates(docs: DataFrame, cluster: str, title: str, body: str, least: int = 2, most: int = 200) -> DataFrame:
    """(cluster, phrase, score, docs): phrases of one to three topic words by summed weight, those of at least ``least`` documents, the best ``most`` of each cluster."""
    each = []
    for source, column in (("title", title), ("body", body)):
        words = text.topic_tokens(F.col(column))
        for n, w in WEIGHTS[source].items():
            each.append(F.transform(F.array_distinct(text.ngrams(words, n)), _weighted(w)))
    rows = docs.select(cluster, F.explode(F.concat(*each)).alias("x"), F.monotonically_increasing_id().alias("doc")).select(cluster, "doc", "x.phrase", "x.w")
    sums = rows.groupBy(cluster, "phrase").agg(F.sum("w").alias("score"), F.countDistinct("doc").alias("docs")).where(F.col("docs") >= least)
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), "phrase")
    return sums.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def _weighted(w: float):
    return lambda p: F.struct(p.alias("phrase"), F.lit(w).alias("w"))


def labels(found: DataFrame, cluster: str, most: int = 3, family: int = 2) -> DataFrame:
    """(cluster, position, phrase, rank_score): greedy pick by 30 * log(1 + score) and a bonus for length; no phrase inside or around one that is taken, at most ``family`` with the same last word. A cluster's candidates are few."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        import math

        scored = sorted(((-(30 * math.log1p(s) + 5 * (len(p.split()) - 1)), p) for p, s in zip(rows["phrase"], rows["score"], strict=True)))
        taken, heads = [], {}
        for s, p in scored:
            inside = any(f" {p} " in f" {q} " or f" {q} " in f" {p} " for _, q in taken)
            head = p.split()[-1]
            if inside or heads.get(head, 0) >= family:
                continue
            heads[head] = heads.get(head, 0) + 1
            taken.append((-s, p))
            if len(taken) == most:
                break
        return pd.DataFrame([(rows[cluster].iloc[0], i, p, round(s, 6)) for i, (s, p) in enumerate(taken, 1)], columns=[cluster, "position", "phrase", "rank_score"])

    return found.groupBy(cluster).applyInPandas(pick, f"{cluster} {found.schema[cluster].dataType.simpleString()}, position int, phrase string, rank_score double")


def stratified_audit(df: DataFrame, key: str, strata: dict[str, Column], each: int, total: int, seed: str) -> DataFrame:
    """(key, stratum): up to ``each`` rows of every stratum by hash, a row under its first stratum only; topped up to ``total`` from the rest."""
    name = F.lit(None).cast("string")
    for stratum, test in reversed(strata.items()):
        name = F.when(F.coalesce(test, F.lit(False)), stratum).otherwise(name)
    rows = df.select(key, name.alias("stratum"))
    first = hash_sample(rows.where("stratum is not null"), "stratum", key, seed, each).select(key, "stratum")
    n = first.count()  # at most each * strata
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    rest = rows.join(first.select(key), key, "left_anti").orderBy(h).limit(max(0, total - n)).select(key, F.lit("top_up").alias("stratum"))
    return first.unionByName(rest)


# What a mention in each kind of evidence counts, and how many mentions there must be; then the weights where nothing is left.
EVIDENCE = {"title_3": (14.0, 2), "title_2": (10.0, 2), "body_3": (5.0, 3), "body_2": (3.5, 3), "keywords": (2.0, 2), "concepts": (1.5, 2), "title_1": (0.5, 3)}
LAST_RESORT = {"title_3": 10.0, "title_2": 8.0, "body_3": 4.0, "body_2": 3.0, "keywords": 2.0, "concepts": 1.5, "categories": 0.5, "tags": 0.5, "title_1": 0.5}
LISTS = ["keywords", "concepts", "categories", "tags"]


def _said_phrases(docs: DataFrame, cluster: str, title: str, body: str) -> DataFrame:
    """(cluster, kind, phrase, n): mentions of each phrase in each kind of evidence; phrases rewritten and without poor ones, single words and list members as they are."""

    def of_words(kind: str, found: Column, n: int) -> Column:
        # a phrase of one word over and over says nothing
        runs = F.transform(text.ngrams(found, n), lambda p: F.split(p, " "))
        told = F.filter(runs, lambda w: F.size(F.array_distinct(w)) > 1) if n > 1 else runs
        return F.transform(told, lambda w: F.struct(F.lit(kind).alias("kind"), F.array_join(w, " ").alias("phrase")))

    t, b = (phrases.words(F.col(c), phrases.PHRASE_STOPWORDS) for c in (title, body))
    kinds = [of_words("title_3", t, 3), of_words("title_2", t, 2), of_words("title_1", phrases.words(F.col(title), phrases.TERM_STOPWORDS), 1), of_words("body_3", b, 3), of_words("body_2", b, 2)]
    members = lambda name: F.transform(F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("kind"), phrases.term(v).alias("phrase")))
    kinds += [members(n) for n in LISTS if n in docs.columns]
    counts = docs.select(F.col(cluster), F.explode(F.concat(*kinds)).alias("x")).groupBy(cluster, "x.kind", "x.phrase").agg(F.count(F.lit(1)).alias("n"))
    grams = F.col("kind").rlike("_[23]$")
    as_said = F.when(grams, phrases.rewritten(F.col("phrase"))).otherwise(F.col("phrase"))
    good = F.when(grams, ~phrases.is_poor(F.col("phrase"))).otherwise((F.col("phrase") != "") & ~F.col("phrase").isin(phrases.TERM_STOPWORDS))
    return counts.withColumn("phrase", as_said).where(good).groupBy(cluster, "kind", "phrase").agg(F.sum("n").alias("n"))


def _most_said(counts: DataFrame, cluster: str, most: int) -> DataFrame:
    """The most frequent phrases of each kind; the first by alphabet among equals."""
    w = Window.partitionBy(cluster, "kind").orderBy(F.desc("n"), "phrase")
    return counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)


def topic_candidates(docs: DataFrame, cluster: str, title: str, body: str, most: int = 20) -> DataFrame:
    """(cluster, phrase, score, last_resort): label candidates of each cluster by weighted mentions.

    Evidence is the ``most`` most frequent phrases of two and three words of title and body, title words (the first 15),
    and the members of those of LISTS that the documents have. score sums EVIDENCE over what is mentioned often enough,
    each share rounded half to even; last_resort sums LAST_RESORT over all. Documents without a cluster are a cluster of
    their own, null; empty texts and lists say nothing.
    """
    raw = _most_said(_said_phrases(docs, cluster, title, body), cluster, most).select(cluster, "kind", phrases.rewritten(F.col("phrase")).alias("phrase"), "n")
    clean = raw.where(~phrases.is_poor(F.col("phrase"))).groupBy(cluster, "kind", "phrase").agg(F.sum("n").alias("n"))
    ranked = _most_said(clean, cluster, most)
    kind, n = F.col("kind"), F.col("n")
    weight = F.coalesce(*[F.when((kind == k) & (n >= least), F.lit(w)) for k, (w, least) in EVIDENCE.items()], F.lit(0.0))
    weight = F.when((kind == "title_1") & (F.col("_n") > 15), 0.0).otherwise(weight)
    last = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in LAST_RESORT.items()], F.lit(0.0))
    share = lambda w: F.sum(F.bround(w * n, 0).cast("bigint"))
    told = F.max(weight > 0)
    return ranked.groupBy(cluster, "phrase").agg(F.when(told, share(weight)).alias("score"), share(last).alias("last_resort"))


def topic_labels(found: DataFrame, cluster: str, most: int = 5) -> DataFrame:
    """(cluster, position, label, family, score): the labels of each cluster from topic_candidates.

    By 30 * log(1 + score) and specificity, then specificity, then length, then the alphabet, each is taken that says
    nothing taken already, at most two of a family; then, if there are fewer than ``most``, whatever family they are of.
    Where no scored candidate can be taken, by last_resort. A cluster has at most a few hundred candidates, so its fold
    is one row.
    """
    label = phrases.term(F.col("phrase"))
    rows = found.where(~phrases.is_poor(F.col("phrase"))).select(cluster, label.alias("label"), phrases.family(label).alias("family"), phrases.specificity(label).alias("points"), "score", "last_resort")

    def ranked(by: str) -> Column:
        score = F.log1p(F.greatest(F.col(by), F.lit(0)).cast("double")) * 30 + F.col("points")
        one = F.struct((-score).alias("o"), (-F.col("points")).alias("p"), (-F.length("label")).alias("n"), "label", "family", score.alias("score"))
        return F.array_sort(F.collect_list(F.when(F.col(by).isNotNull(), one)))

    def taken(every: Column) -> Column:
        none = F.filter(every, lambda x: F.lit(False))
        names = lambda acc: F.transform(acc, lambda y: y["label"])
        full = lambda acc: F.size(acc) >= most
        apart = lambda acc, x: full(acc) | phrases.is_redundant(x["label"], names(acc))
        two = lambda acc, x: F.size(F.filter(acc, lambda y: y["family"] == x["family"])) >= 2
        add = lambda acc, x: F.concat(acc, F.array(x))
        first = F.aggregate(every, none, lambda acc, x: F.when(two(acc, x) | apart(acc, x), acc).otherwise(add(acc, x)))
        return F.aggregate(every, first, lambda acc, x: F.when(apart(acc, x), acc).otherwise(add(acc, x)))

    each = rows.groupBy(cluster).agg(ranked("score").alias("a"), ranked("last_resort").alias("b")).select(cluster, taken(F.col("a")).alias("a"), "b")
    best = each.select(cluster, F.when(F.size("a") > 0, F.col("a")).otherwise(taken(F.col("b"))).alias("x"))
    return best.select(cluster, F.posexplode("x").alias("i", "x")).select(cluster, (F.col("i") + 1).alias("position"), "x.label", "x.family", F.round("x.score", 6).alias("score"))
