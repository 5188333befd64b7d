"""How far sources hold the same papers by several keys, and the orders of artifact lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import documents, text


def paper_keys(doi: Column, arxiv: Column, title: Column, year: Column) -> dict[str, Column]:
    """The four keys that a paper is told by: DOI and arXiv id in lower case, title, title with year; null where there is none."""
    said = F.lower(text.normalize_text(title))
    bare = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", ""), r"^[\s/]+|[\s/]+$", ""), F.lit(""))
    with_year = F.concat_ws("::", said, F.coalesce(year.cast("string"), F.lit("None")))
    return {"doi": bare, "arxiv_id": F.nullif(F.lower(F.trim(arxiv)), F.lit("")), "title": F.nullif(said, F.lit("")), "title_year": F.nullif(with_year, F.lit("::None"))}


def key_overlap(rows: DataFrame, source: str, keys: dict[str, Column]) -> DataFrame:
    """(key, source_a, source_b, shared, a_values, b_values) for each key and each pair of sources, a before b, that share a value.

    Values are distinct; null ones and rows without a source don't count. Values meet once, as the set of their sources;
    pairs are made of the distinct sets, not of rows, so a value that many rows hold costs no more than another.
    """
    each = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in keys.items()])
    held = rows.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.explode(each).alias("x")).where("x.value is not null")
    sets = held.groupBy("x.key", "x.value").agg(F.array_sort(F.collect_set("source")).alias("sources")).groupBy("key", "sources").agg(F.count(F.lit(1)).alias("n"))
    total = sets.select("key", F.explode("sources").alias("source"), "n").groupBy("key", "source").agg(F.sum("n").alias("values"))
    pairs = sets.select("key", "n", F.posexplode("sources").alias("i", "a"), "sources").select("key", "n", "a", F.explode(F.slice("sources", F.col("i") + 2, F.size("sources"))).alias("b"))
    shared = pairs.groupBy("key", "a", "b").agg(F.sum("n").alias("shared"))
    side = lambda s: total.select("key", F.col("source").alias(s), F.col("values").alias(f"{s}_values"))
    return shared.join(side("a"), ["key", "a"]).join(side("b"), ["key", "b"]).select("key", F.col("a").alias("source_a"), F.col("b").alias("source_b"), "shared", "a_values", "b_values")


def artifact_order(name: str = "linked_papers_desc") -> list[Column]:
    """An order of artifacts by its name; an unknown name is that of linked papers. Ties go by provider and URL, nulls last.

    Reads provider, artifact_type, owner, normalized_url, last_seen_at, updated_at, stars, forks, metadata (JSON) and
    linked_papers_count, each only where the order needs it.
    """
    last = [F.asc_nulls_last("provider"), F.asc_nulls_last("normalized_url")]
    if name == "provider_asc":
        return last
    if name == "type_asc":
        return [F.asc_nulls_last("artifact_type"), *last]
    if name == "owner_asc":
        return [F.asc_nulls_last("owner"), *last]
    newest = {"last_seen_desc": "last_seen_at", "stars_desc": "stars", "forks_desc": "forks", "updated_desc": "updated_at"}
    if name in newest:
        return [F.desc_nulls_last(newest[name]), *last]
    if name == "pushed_desc":
        return [documents.value_at(documents.parsed(F.col("metadata")), "github.pushed_at").try_cast("timestamp").desc_nulls_last(), *last]
    return [F.coalesce("linked_papers_count", F.lit(0)).desc(), *last]


ORDERS = ["provider_asc", "type_asc", "owner_asc", "last_seen_desc", "stars_desc", "forks_desc", "pushed_desc", "updated_desc", "linked_papers_desc"]
