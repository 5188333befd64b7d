"""Citation graph: references of papers, resolved to papers where an identifier leads to one only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import links, text


def normalized_reference(kind: Column, value: Column) -> Column:
    """An identifier in the form of its kind (doi, arxiv, openalex, s2, raw); null if it has none."""
    t = F.trim(value)
    return (
        F.when(kind == "doi", text.doi_key(t))
        .when(kind == "arxiv", text.arxiv_key(t))
        .when(kind == "openalex", F.nullif(F.upper(F.regexp_extract(t, r"(?i)(W[0-9]+)", 1)), F.lit("")))
        .when(kind == "s2", F.when(F.lower(t).rlike("^[0-9a-f]{40}$"), F.lower(t)))
        .otherwise(F.nullif(t, F.lit("")))
    )


def references(papers: DataFrame) -> DataFrame:
    """(paper, field, kind, value): distinct references. papers: paper, dois, arxiv_ids, ids array<struct<type,id>>."""
    def listed(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.lit(column).alias("field"), F.lit(kind).alias("kind"), x.alias("raw")))

    each = [listed("dois", "doi"), listed("arxiv_ids", "arxiv")]
    ids = F.coalesce("ids", F.array().cast("array<struct<type:string,id:string>>"))
    each.append(F.transform(ids, lambda x: F.struct(F.lit("ids").alias("field"), links.reference_type(x["id"], x["type"]).alias("kind"), x["id"].alias("raw"))))
    rows = papers.select("paper", F.inline(F.concat(*each)))
    return rows.withColumn("value", normalized_reference(F.col("kind"), F.col("raw"))).where("value is not null").select("paper", "field", "kind", "value").distinct()


def identifiers(papers: DataFrame) -> DataFrame:
    """(kind, value, target): identifiers that lead to one paper only. papers: paper, doi, arxiv, openalex."""
    kinds = {"doi": text.doi_key(F.col("doi")), "arxiv": text.arxiv_key(F.col("arxiv")), "openalex": normalized_reference(F.lit("openalex"), F.col("openalex"))}
    rows = papers.select("paper", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]))).where("value is not null")
    return rows.groupBy("kind", "value").agg(F.min("paper").alias("target"), F.max("paper").alias("_last")).where("target = _last").drop("_last")


def edges(papers: DataFrame) -> DataFrame:
    """(edge_id, paper, kind, value, target, fields, evidence): a reference of a paper, resolved (target) or external; never to itself."""
    refs = references(papers).groupBy("paper", "kind", "value").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.count(F.lit(1)).alias("evidence"))
    j = refs.join(identifiers(papers), ["kind", "value"], "left").where("target is null or target <> paper")
    to = F.coalesce(F.col("target").cast("string"), F.concat_ws(":", "kind", "value"))
    return j.select(text.edge_id(F.when(F.col("target").isNotNull(), "cites_paper").otherwise("cites_external"), F.col("paper"), to).alias("edge_id"), "paper", "kind", "value", "target", "fields", "evidence")


def nodes(papers: DataFrame, links_: DataFrame) -> DataFrame:
    """(node_id, node_type, status): papers with references or cited, and references that lead nowhere."""
    own = links_.select(F.col("paper").alias("p")).unionByName(links_.where("target is not null").select(F.col("target").alias("p"))).distinct()
    paper = own.select(F.concat(F.lit("paper:"), F.col("p").cast("string")).alias("node_id"), F.lit("paper").alias("node_type"), F.lit(None).cast("string").alias("status"))
    ext = links_.where("target is null").select(F.concat(F.lit("external_reference:"), F.concat_ws(":", "kind", "value")).alias("node_id"), F.lit("external_reference").alias("node_type"), F.lit("unresolved_external").alias("status")).distinct()
    return paper.unionByName(ext)


def hydrated(links_: DataFrame, papers: DataFrame, title: str) -> DataFrame:
    """Edges with the titles at both ends."""
    t = papers.select(F.col("paper").alias("_p"), F.col(title).alias("_t"))
    a = links_.join(t.withColumnRenamed("_t", "source_title"), F.col("paper") == F.col("_p"), "left").drop("_p")
    return a.join(t.withColumnRenamed("_t", "target_title"), F.col("target") == F.col("_p"), "left").drop("_p")


def query(links_: DataFrame, **by) -> DataFrame:
    """Edges by exactly one selector: paper, target, reference ("kind:value"), or top (most cited targets)."""
    if len(by) != 1:
        raise ValueError("one selector: paper, target, reference or top")
    (name, value), = by.items()
    if name in ("paper", "target"):
        return links_.where(F.col(name) == value).orderBy("edge_id")
    if name == "reference":
        return links_.where(F.concat_ws(":", "kind", "value") == value).orderBy("edge_id")
    if name == "top":
        return links_.where("target is not null").groupBy("target").agg(F.countDistinct("paper").alias("papers")).orderBy(F.desc("papers"), "target").limit(value)
    raise ValueError(f"unknown selector {name}")
