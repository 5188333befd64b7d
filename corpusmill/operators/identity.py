"""Grouping of source observations into papers, and folds over a paper's observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import records, text
from corpusmill.operators.reconcile import Rule, reconcile


def reconciliation_keys(df: DataFrame, doi: str, arxiv: str, title: str, year: str) -> DataFrame:
    """Adds key: by DOI; where a DOI comes with several arXiv ids, by arXiv id, or apart without one; then by arXiv id; then by title and year.

    doi and arxiv are normalized keys. Only rows with a DOI are grouped by it.
    """
    bases = df.where(F.col(doi).isNotNull()).groupBy(F.col(doi).alias("_doi")).agg(F.countDistinct(arxiv).alias("_bases")).where("_bases > 1")
    j = df.join(bases, F.col(doi) == F.col("_doi"), "left")
    tagged = lambda name, c: F.concat(F.lit(f"{name}::"), c)
    by_title = F.concat_ws("::", F.lit("title_year"), text.title_key(F.coalesce(title, F.lit(""))), F.coalesce(F.col(year).cast("string"), F.lit("unknown")))
    conflict = F.col("_bases").isNotNull()
    key = F.when(conflict & F.col(arxiv).isNotNull(), tagged("arxiv", F.col(arxiv))).when(conflict, tagged("doi_conflict", F.col(doi))).when(F.col(doi).isNotNull(), tagged("doi", F.col(doi))).when(F.col(arxiv).isNotNull(), tagged("arxiv", F.col(arxiv))).otherwise(by_title)
    return j.withColumn("key", key).drop("_doi", "_bases")


# Sources by priority for a kind of field.
BIBLIOGRAPHIC = {"crossref": 100, "openalex": 95, "semantic_scholar": 80, "arxiv": 60}
VENUE = {"openalex": 100, "crossref": 95, "semantic_scholar": 80, "arxiv": 60}

#: The fields of a canonical record and how each is merged.
CANONICAL = [
    Rule("title", "longest", BIBLIOGRAPHIC),
    Rule("abstract", "longest", BIBLIOGRAPHIC),
    Rule("doi", "preferred", BIBLIOGRAPHIC),
    Rule("arxiv_id", "first"),
    Rule("venue", "preferred", VENUE, longer=True),
    Rule("journal", "preferred", VENUE, longer=True),
    Rule("year", "min"),
    Rule("published", "min"),
    Rule("cited_by", "max"),
    Rule("open_access", "any"),
    Rule("authors", "union"),
    Rule("categories", "union"),
    Rule("source", "distinct"),
    Rule("seq", "count"),
]


def canonical_records(observations: DataFrame, key: str = "key", source: str = "source", seq: str = "seq") -> DataFrame:
    """One canonical record for each key: CANONICAL's fields that are there, canonical_id, license, and strict flags where their fields are there."""
    have = set(observations.columns)
    out = reconcile(observations, key, [r for r in CANONICAL if r.name in have], source, seq)
    more = []
    if "license" in have:
        more.append(F.max(records.license_rank(records.license_label(F.col("license")), F.col(source)))["label"].alias("license"))
    if {"is_preprint", "publication_type"} <= have:
        published = F.max((F.coalesce("publication_type", F.lit("")) != "") & ~F.coalesce("is_preprint", F.lit(False)))
        kind = F.max(F.when(F.coalesce("publication_type", F.lit("")) != "", F.struct(records_priority(source).alias("p"), F.col("publication_type").alias("v"))))["v"]
        more.append(records.preprint_flag(published, F.bool_or("is_preprint"), kind).alias("is_preprint"))
    if "open_access" in have:
        more.append(F.bool_or(F.when(F.coalesce(source, F.lit("")) != "arxiv", F.col("open_access"))).alias("strict_open_access"))
    if more:
        out = out.join(observations.groupBy(key).agg(*more), key)
    return out.withColumn("canonical_id", text.stable_hash(F.col(key).cast("string")))


def records_priority(source: str) -> Column:
    from corpusmill.operators.reconcile import priority

    return priority(F.col(source), BIBLIOGRAPHIC)


def winners(observations: DataFrame, key: str, field: str, rule: Rule, seq: str = "seq") -> DataFrame:
    """(key, value, seqs): the merged value of a field and the observations that hold it, in order."""
    merged = reconcile(observations, key, [rule]).select(key, F.col(field).alias("_value"))
    same = observations.join(merged, key).where(F.col(field) == F.col("_value"))
    return same.groupBy(key).agg(F.first("_value").alias("value"), F.sort_array(F.collect_list(seq)).alias("seqs"))


def first_of(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by order of arrival."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def artifact_details(links: DataFrame) -> DataFrame:
    """For each paper, artifact and relation: best confidence, evidence and the fields it came from. links: paper, artifact, relation, confidence, field."""
    return links.groupBy("paper", "artifact", "relation").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def lost_rows(before: DataFrame, after: DataFrame, key: str, values: str) -> DataFrame:
    """(key, status, lost, gained): removed, added or retained rows, and the members of an array column that went or came."""
    a, b = before.select(F.col(key), F.col(values).alias("_a")), after.select(F.col(key).alias("_k"), F.col(values).alias("_b"))
    none = F.array().cast("array<string>")
    x, y = F.coalesce("_a", none), F.coalesce("_b", none)
    status = F.when(F.col("_k").isNull(), "removed").when(F.col(key).isNull(), "added").otherwise("retained")
    said = lambda c: F.array_join(F.array_sort(c), ",")
    return a.join(b, F.col(key) == F.col("_k"), "full_outer").select(F.coalesce(key, "_k").alias(key), status.alias("status"), said(F.array_except(x, y)).alias("lost"), said(F.array_except(y, x)).alias("gained"))


def alignment_losses(lost: DataFrame, keys: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, reason) for each row that lost a source: no_keys, missing_from_snapshot, present. lost: id; keys: id, key; snapshot: key."""
    found = keys.join(snapshot.select("key").distinct(), "key", "left_semi").select("id").distinct().withColumn("_found", F.lit(True))
    have = keys.select("id").distinct().withColumn("_have", F.lit(True))
    j = lost.join(have, "id", "left").join(found, "id", "left")
    return j.select("id", F.when(F.col("_have").isNull(), "no_keys").when(F.col("_found").isNull(), "missing_from_snapshot").otherwise("present").alias("reason"))
