"""Whole canonical papers: every field of a paper from its source observations, and how rich one observation is.

Scalars are one aggregation over the key with partial sums before the shuffle. Members of lists and maps are first told
apart over (key, field, member), so that repeats of a paper that many sources hold never meet in one row; only the distinct
members of a paper are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import records, text
from corpusmill.operators.identity import BIBLIOGRAPHIC, VENUE
from corpusmill.operators.reconcile import priority

# Sources by priority for a kind of field.
DEFAULT = {"openalex": 100, "crossref": 95, "arxiv": 80, "semantic_scholar": 70}
COMMENT = {"arxiv": 100, "openalex": 80}
ARTIFACTS = {"arxiv": 80, "openalex": 60, "semantic_scholar": 50, "crossref": 40}

# Names that an arXiv id goes by among a record's external ids, in the order they are tried.
ARXIV_NAMES = ["arxiv", "ArXiv", "arxiv_id", "arxiv_base"]

IDS = ["pmid", "pmcid", "semantic_scholar_id", "dblp_id", "mag_id"]
LISTS = ["authors", "categories", "concepts", "keywords", "tags", "code_links", "dataset_links", "model_links"]
REFERENCES = ["referenced_ids", "referenced_dois", "referenced_arxiv_ids"]
MAPS = ["source_ids", "external_ids"]
FLAGS = ["citation_graph_available", "has_code_link", "has_dataset_link", "has_model_link", "is_review", "is_survey", "is_withdrawn"]
PREFERRED = {"comment": (COMMENT, True), "journal_ref": (COMMENT, True), "venue": (VENUE, False), "journal": (VENUE, False), "conference": (VENUE, False), "publisher": (BIBLIOGRAPHIC, False), "language": (DEFAULT, False)}

#: The fields of an observation and their types.
SCHEMA = {
    **dict.fromkeys(["doc_id", "source", "source_id", "source_record_id", "source_record_url", "source_api_url", "raw_source_name", "canonical_url"], "string"),
    **dict.fromkeys(["doi", "arxiv_id", "openalex_id", *IDS, "title", "abstract"], "string"),
    **dict.fromkeys(["published_at", "publication_date", "updated_source_at", "ingested_at"], "timestamp"),
    "year": "int",
    **dict.fromkeys(["landing_page_url", "pdf_url", "repo_url", "license", "primary_category", "publication_type", *PREFERRED], "string"),
    **dict.fromkeys(["open_access", "is_open_access", "is_preprint", *FLAGS], "boolean"),
    **dict.fromkeys(["cited_by_count", "references_count"], "bigint"),
    "metadata_completeness_score": "double",
    **dict.fromkeys([*LISTS, *REFERENCES], "array<string>"),
    **dict.fromkeys(MAPS, "map<string,string>"),
}


def whole(observations: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and all of SCHEMA; what the observations lack is null, other columns go."""
    have = set(observations.columns)
    fields = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in SCHEMA.items() if n not in keep]
    return observations.select(*keep, *fields)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _said(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _first(value: Column, there: Column, seq: str) -> Column:
    """The value of the earliest row where it is there; of rows with one seq the least value."""
    return F.min(F.when(there, F.struct(F.col(seq).alias("s"), value.alias("v"))))["v"]


def _preferred(name: str, ranks: dict[str, int], longer: bool, among: Column | None = None) -> Column:
    """By priority of the source, then length if longer, then the greatest value."""
    v = _stripped(F.col(name))
    there = _said(v) if among is None else _said(v) & among
    return F.max(F.when(there, F.struct(priority(F.col("source"), ranks).alias("p"), (F.length(v) if longer else F.lit(0)).alias("n"), v.alias("v"))))["v"]


def _greatest(name: str, seq: str, there: Column, *order: Column) -> Column:
    """The value that is greatest by the order's columns; then the earliest row."""
    return F.max(F.when(there, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], (-F.col(seq)).alias("s"), F.col(name).alias("v"))))["v"]


def _members(seq: str) -> Column:
    """All members of lists and maps of a row: array of (field, same, rank, seq, pos, text); of rows with one ``same`` the least by rank, seq and pos stays."""

    def member(field: str, same: Column, said: Column, pos: Column, rank: Column | None = None) -> Column:
        return F.struct(F.lit(field).alias("field"), same.alias("same"), (F.lit(0) if rank is None else rank).alias("rank"), F.col(seq).cast("bigint").alias("seq"), pos.cast("int").alias("pos"), said.alias("text"))

    def of_list(field: str, rank: Column | None = None) -> Column:
        return F.transform(F.col(field), lambda v, i: member(field, F.lower(_stripped(v)), _stripped(v), i, rank))

    def of_map(field: str) -> Column:
        return F.transform(F.map_entries(field), lambda e, i: member(field, e["key"], e["value"], i))

    def own(name: Column, value: Column, pos: int) -> Column:
        return member("source_ids", F.when(_said(value), name), value, F.lit(2**30 + pos))

    single = F.array(
        own(F.nullif(F.col("source"), F.lit("")), F.col("source_id"), 0),
        own(F.lit("arxiv"), F.col("arxiv_id"), 1),
        own(F.lit("openalex"), F.col("openalex_id"), 2),
        member("source", F.col("source"), F.col("source"), F.lit(0)),
        member("doc_ids", F.col("doc_id"), F.col("doc_id"), F.lit(0)),
    )
    by_source = -priority(F.col("source"), BIBLIOGRAPHIC)
    every = [of_list(n) for n in LISTS] + [of_list(n, by_source) for n in REFERENCES] + [of_map(n) for n in MAPS]
    none = F.array().cast("array<struct<field:string,same:string,rank:int,seq:bigint,pos:int,text:string>>")
    all_of = F.concat(single, *[F.coalesce(x, none) for x in every])
    return F.filter(all_of, lambda x: _said(x["text"]) & x["same"].isNotNull())


def _gathered(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, members): the distinct members of each paper in order of (field, rank, seq, pos)."""
    each = rows.select(key, F.explode(_members(seq)).alias("m"))
    first = each.groupBy(key, "m.field", "m.same").agg(F.min(F.struct("m.rank", "m.seq", "m.pos", "m.text")).alias("x"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field", "x.rank", "x.seq", "x.pos", "same", "x.text"))).alias("members"))


def canonical_papers(observations: DataFrame, key: str = "key", seq: str = "seq", now: int | None = None) -> DataFrame:
    """One row for each key with all fields of a canonical paper; SCHEMA says what is read, a missing column counts as null.

    seq is the order of arrival; rows with one seq are told apart by their values, so the result doesn't depend on the
    partitioning. Texts are the longest, ids the first, counts and the update the largest, dates and the year (1900 to
    next year) the smallest; venue-like fields follow a priority of sources. Lists hold distinct members in any case with
    their first spelling; references come in the order of the sources' priority. Of a map's keys the first value stays.
    Lists without members are empty, not null. Rows without a key are left out. Source links, one for each observation,
    are source_links(), not a list within the paper.
    """
    rows = whole(observations.where(F.col(key).isNotNull()), key, seq)
    source = F.coalesce("source", F.lit(""))
    other = source != "arxiv"
    external = {n: F.element_at("external_ids", n) for n in ["doi", "openalex", *ARXIV_NAMES]}
    first = lambda n: _first(F.col(n), _said(F.col(n)), seq)
    first_external = lambda n: _first(external[n], _said(external[n]), seq)
    published = _said(F.col("publication_type")) & ~F.coalesce("is_preprint", F.lit(False))
    newest = F.year(F.current_date()) if now is None else F.lit(now)
    openalex = (source == "openalex").cast("int")

    label = records.license_label(F.col("license"))
    scalars = {
        "doi": F.coalesce(first("doi"), first_external("doi")),
        "arxiv_id": F.coalesce(_first(F.col("arxiv_id"), _said(F.col("arxiv_id")) & (source == "arxiv"), seq), first("arxiv_id"), *[first_external(n) for n in ARXIV_NAMES]),
        "openalex_id": F.coalesce(first("openalex_id"), first_external("openalex")),
        **{n: _first(_stripped(F.col(n)), _said(_stripped(F.col(n))), seq) for n in IDS},
        "title": _greatest("title", seq, F.lit(True), F.coalesce(F.length("title"), F.lit(0)), openalex),
        "abstract": _greatest("abstract", seq, _said(F.col("abstract")), F.length("abstract"), openalex),
        "published_at": F.min("published_at"),
        "publication_date": F.min("publication_date"),
        "updated_at": F.max("updated_source_at"),
        "year": F.min(F.when(F.col("year").between(1900, newest + 1), F.col("year"))),
        "landing_page_url": first("landing_page_url"),
        "pdf_url": first("pdf_url"),
        "repo_url": _greatest("repo_url", seq, _said(F.col("repo_url")), priority(F.col("source"), ARTIFACTS), F.length("repo_url")),
        "license": F.max(records.license_rank(label, F.col("source")))["label"],
        "open_access": F.bool_or("open_access"),
        "primary_category": first("primary_category"),
        **{n: _preferred(n, ranks, longer) for n, (ranks, longer) in PREFERRED.items()},
        "publication_type": F.when(F.bool_or(published), _preferred("publication_type", BIBLIOGRAPHIC, False, published)).otherwise(_preferred("publication_type", BIBLIOGRAPHIC, False)),
        "cited_by_count": F.max("cited_by_count"),
        "references_count": F.max("references_count"),
        **{n: F.coalesce(F.bool_or(n), F.lit(False)) for n in FLAGS},
        "is_open_access": F.greatest(F.bool_or(F.when(other, F.col("is_open_access"))), F.bool_or(F.when(other, F.col("open_access")))),
        "_published": F.bool_or(published),
        "_preprint": F.bool_or("is_preprint"),
        "source_count": F.count(F.lit(1)),
    }
    one = rows.groupBy(key).agg(*[c.alias(n) for n, c in scalars.items()])
    both = one.join(_gathered(rows, key, seq).withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")

    of = lambda field: F.filter("members", lambda x: x["field"] == field)
    lists = {n: F.coalesce(F.transform(of(n), lambda x: x["text"]), F.array().cast("array<string>")) for n in [*LISTS, *REFERENCES, "doc_ids"]}
    maps = {n: F.coalesce(F.map_from_entries(F.transform(of(n), lambda x: F.struct(x["same"], x["text"]))), F.create_map().cast("map<string,string>")) for n in MAPS}
    both = both.withColumns({**lists, **maps, "unique_source_count": F.greatest(F.size(of("source")), F.lit(0))})

    any_of = lambda n: F.size(n) > 0
    checks = [_said(F.coalesce(F.col(n), F.lit(""))) for n in ("title", "abstract", "doi", "primary_category", "pdf_url", "venue")]
    checks += [any_of("authors"), any_of("categories"), *[F.col(n).isNotNull() for n in ("publication_date", "cited_by_count", "references_count")], F.col("has_code_link")]
    venue = records.venue_fields(F.col("publication_type"), F.col("venue"), F.col("journal"), F.col("conference"))
    done = both.withColumns(
        {
            "metadata_completeness_score": F.round(sum((c.cast("int") for c in checks), F.lit(0)) / len(checks), 4),
            "is_preprint": records.preprint_flag(F.col("_published"), F.col("_preprint"), F.col("publication_type")),
            "has_code_link": F.col("has_code_link") | any_of("code_links") | F.col("repo_url").isNotNull(),
            "has_dataset_link": F.col("has_dataset_link") | any_of("dataset_links"),
            "has_model_link": F.col("has_model_link") | any_of("model_links"),
            "_venue": venue,
            "canonical_id": text.stable_hash(F.col(key).cast("string")),
            "reconciliation_key": F.col(key).cast("string"),
        }
    )
    done = done.withColumns({n: F.col("_venue")[n] for n in ("venue", "journal", "conference")})
    return done.drop("_venue", "_key", "_published", "_preprint", "members")


def source_links(observations: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row for each observation of a paper: canonical_id, seq, and where the source holds it."""
    rows = whole(observations.where(F.col(key).isNotNull()), key, seq)
    return rows.select(
        text.stable_hash(F.col(key).cast("string")).alias("canonical_id"), seq, "source", "source_id", "source_record_id", "source_record_url", "canonical_url",
        F.col("ingested_at").alias("fetched_at"), F.col("updated_source_at").alias("source_updated_at"), "source_api_url", "raw_source_name",
    )


# Points for what an observation has, and the most points that a map's size gives.
POINTS = {"title": 3, "abstract": 3, "authors": 2, "doi": 2, "arxiv_id": 2, "openalex_id": 2}
SIZES = {"external_ids": 3, "source_ids": 2}
SINGLE_POINTS = [
    "publication_date", "published_at", "updated_source_at",
    "primary_category", "categories", "concepts", "keywords", "tags",
    "pdf_url", "landing_page_url", "repo_url", "code_links", "dataset_links", "model_links", "license", "open_access",
    "venue", "journal", "conference", "publisher", "publication_type", "language", "comment", "journal_ref",
    "cited_by_count", "references_count", "referenced_ids", "referenced_dois", "referenced_arxiv_ids", "citation_graph_available",
    "metadata_completeness_score", "is_open_access", "is_preprint",
]


def richness_score() -> Column:
    """Points of an observation of SCHEMA: present texts, dates and counts (zero is present), lists with members, flags that are true, maps by size."""

    def there(name: str) -> Column:
        kind, c = SCHEMA[name], F.col(name)
        if kind == "boolean":
            return F.coalesce(c, F.lit(False))
        if kind.startswith("array"):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.coalesce(c != "", F.lit(False)) if kind == "string" else c.isNotNull()

    points = {**POINTS, **dict.fromkeys(SINGLE_POINTS, 1)}
    total = sum((there(n).cast("int") * p for n, p in points.items()), F.lit(0))
    return total + sum((F.least(F.greatest(F.coalesce(F.size(n), F.lit(0)), F.lit(0)), F.lit(most)) for n, most in SIZES.items()), F.lit(0))


def richest(observations: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """One observation of SCHEMA for each key: the richest; then the latest update, one without being the earliest; then the first to arrive.

    Rows without a key are left out. One partial aggregation; no sort of a key's rows.
    """
    rows = whole(observations.where(F.col(key).isNotNull()), key, seq)
    rank = F.struct(richness_score().alias("richness"), F.coalesce(F.col("updated_source_at").cast("double"), F.lit(float("-inf"))).alias("updated"), (-F.col(seq)).alias("arrival"))
    return rows.withColumn("_rank", rank).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key], F.col("_rank.richness")), "_rank").alias("x")).select(key, "x.*")
