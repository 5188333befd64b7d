"""Projections of providers' public JSON records onto one observation schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text

COLUMNS = ["source", "record_id", "title", "abstract", "year", "published", "doi", "authors", "venue", "cited_by", "open_access"]
SCHEMAS = {
    "openalex": "id string, doi string, title string, publication_year int, publication_date string, cited_by_count long, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, open_access struct<is_oa:boolean>, primary_location struct<source:struct<display_name:string>>",
    "crossref": "DOI string, title array<string>, abstract string, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, `is-referenced-by-count` long",
    "semantic_scholar": "paperId string, title string, abstract string, year int, publicationDate string, citationCount long, authors array<struct<name:string>>, venue string, isOpenAccess boolean, externalIds map<string,string>",
}


def date_of_parts(parts: Column) -> Column:
    """[y, m, d] with missing month or day as 1."""
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(1))
    return F.when(F.get(parts, F.lit(0)).isNotNull(), F.make_date(F.get(parts, F.lit(0)), at(1), at(2)))


def sane_year(year: Column, published: Column, now: int) -> Column:
    """A year before 1900 or after next year gives way to the publication's."""
    return F.when(year.between(1900, now + 1), year).otherwise(F.year(published))


def observations(raw: DataFrame, provider: str, now: int, column: str = "value") -> DataFrame:
    """Rows of COLUMNS from a column of JSON records; a record that isn't JSON gives nulls."""
    r = raw.select(F.from_json(column, SCHEMAS[provider]).alias("r")).select("r.*")
    if provider == "openalex":
        day = F.try_to_timestamp("publication_date", F.lit("yyyy-MM-dd")).cast("date")
        cols = [F.col("id"), F.col("title"), text.abstract_of(F.col("abstract_inverted_index")), sane_year(F.col("publication_year"), day, now), day, text.doi_key(F.col("doi")), F.transform("authorships", lambda a: a["author"]["display_name"]), F.col("primary_location.source.display_name"), F.col("cited_by_count"), F.col("open_access.is_oa")]
    elif provider == "crossref":
        day = date_of_parts(F.get(F.col("issued.date-parts"), F.lit(0)))
        cols = [F.col("DOI"), F.get("title", F.lit(0)), F.regexp_replace("abstract", "<[^>]*>", ""), sane_year(F.year(day), day, now), day, text.doi_key(F.col("DOI")), F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"])), F.get(F.col("container-title"), F.lit(0)), F.col("is-referenced-by-count"), F.lit(None).cast("boolean")]
    else:
        day = F.try_to_timestamp("publicationDate", F.lit("yyyy-MM-dd")).cast("date")
        cols = [F.col("paperId"), F.col("title"), F.col("abstract"), sane_year(F.col("year"), day, now), day, text.doi_key(text.map_lookup(F.col("externalIds"), "doi")), F.transform("authors", lambda a: a["name"]), F.col("venue"), F.col("citationCount"), F.col("isOpenAccess")]
    return r.select(F.lit(provider).alias("source"), *[c.alias(n) for n, c in zip(COLUMNS[1:], cols, strict=True)])


def in_chunks(ids: DataFrame, key: str, size: int) -> DataFrame:
    """Keys dealt into request chunks of at most size, by hash; no single task numbers all keys."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(key), F.lit(64))
    rows = ids.select(key).distinct().withColumn("part", part)
    n = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return rows.withColumn("chunk", F.floor(n / size)).groupBy("part", "chunk").agg(F.sort_array(F.collect_list(key)).alias("keys"))
