"""Whole canonical papers and the richness of observations on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import canonical

DAY = lambda d: datetime.datetime(2020, 1, d)
SHAPE = ", ".join(f"{n} {t}" for n, t in {"key": "string", "seq": "bigint", **canonical.SCHEMA}.items())


def rows(spark, *found):
    names = ["key", "seq", *canonical.SCHEMA]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in found], SHAPE)


def paper(spark, *found):
    got = canonical.canonical_papers(rows(spark, *[{"key": "k", "seq": i, **r} for i, r in enumerate(found)]), now=2025).collect()
    assert len(got) == 1
    return got[0]


def test_texts_and_ids(spark):
    r = paper(
        spark,
        {"source": "crossref", "title": "abc", "abstract": "", "arxiv_id": "1v2", "pmid": "  ", "external_ids": {"doi": "10.1/ext", "openalex": "W9", "ArXiv": "x"}},
        {"source": "openalex", "title": "xyz", "abstract": "short", "pmid": " 7 ", "doi": ""},
        {"source": "arxiv", "title": "ab", "abstract": "other", "arxiv_id": "1v1", "pmid": "8"},
    )
    assert (r.title, r.abstract, r.doi, r.arxiv_id, r.openalex_id, r.pmid, r.pmcid) == ("xyz", "short", "10.1/ext", "1v1", "W9", "7", None)
    only = paper(spark, {"external_ids": {"arxiv_base": "b", "arxiv_id": "c"}})
    assert (only.arxiv_id, only.title, only.source_count, only.unique_source_count) == ("c", None, 1, 0)


def test_priorities(spark):
    r = paper(
        spark,
        {"source": "arxiv", "comment": "in", "venue": "arXiv", "publisher": "P", "language": "en", "journal_ref": " ", "repo_url": "https://a/1", "license": "x"},
        {"source": "openalex", "comment": "much longer", "venue": " Venue ", "language": "de", "journal_ref": "J", "repo_url": "https://longer/1", "license": "CC BY 4.0"},
        {"source": "crossref", "venue": "Zzz", "publisher": "Q", "repo_url": "https://z", "license": "cc0", "publication_type": "conference", "is_preprint": True},
        {"source": "arxiv", "comment": "longer", "publication_type": "preprint", "is_preprint": True},
    )
    assert (r.comment, r.venue, r.publisher, r.language, r.journal_ref, r.repo_url, r.license) == ("longer", "Venue", "Q", "de", "J", "https://a/1", "cc-by")
    assert (r.publication_type, r.conference, r.is_preprint, r.has_code_link) == ("conference", "Venue", True, True)
    chapter = paper(spark, {"source": "crossref", "publication_type": "book-chapter", "journal": "Lecture Notes in X"}, {"source": "openalex", "publication_type": "preprint", "is_preprint": True})
    assert (chapter.publication_type, chapter.journal, chapter.is_preprint) == ("book-chapter", None, False)


def test_dates_counts_and_flags(spark):
    r = paper(
        spark,
        {"source": "arxiv", "year": 1899, "published_at": DAY(3), "updated_source_at": DAY(3), "open_access": True, "cited_by_count": 3},
        {"source": "openalex", "year": 2026, "published_at": DAY(2), "updated_source_at": DAY(9), "cited_by_count": 0, "is_survey": True},
        {"source": "x", "year": 2027},
    )
    assert (r.year, r.published_at, r.updated_at, r.cited_by_count, r.references_count, r.open_access, r.is_open_access, r.is_survey, r.is_review) == (2026, DAY(2), DAY(9), 3, None, True, None, True, False)
    closed = paper(spark, {"source": "arxiv", "open_access": True}, {"source": "crossref", "open_access": False}, {"source": None})
    assert (closed.open_access, closed.is_open_access) == (True, False)
    assert paper(spark, {"source": "crossref", "open_access": False, "is_open_access": True}).is_open_access is True


def test_lists_and_maps(spark):
    r = paper(
        spark,
        {"source": "arxiv", "source_id": "s1", "arxiv_id": "a1", "doc_id": "D", "authors": ["B ", None, "a", " "], "referenced_ids": ["w1", "W2"], "source_ids": {"mag": "", "x": "1"}, "code_links": []},
        {"source": "crossref", "source_id": "s2", "doc_id": "d", "authors": ["A", "c", "b"], "referenced_ids": ["W3", "W1"], "source_ids": {"mag": "5", "x": "2"}},
        {"source": "crossref", "source_id": "s3", "openalex_id": "W", "doc_id": "D", "dataset_links": ["u"]},
    )
    assert (r.authors, r.referenced_ids, r.doc_ids, r.categories) == (["B", "a", "c"], ["W3", "W1", "W2"], ["D", "d"], [])
    assert r.source_ids == {"x": "1", "mag": "5", "arxiv": "s1", "crossref": "s2", "openalex": "W"} and r.external_ids == {}
    assert (r.has_dataset_link, r.has_model_link, r.has_code_link, r.unique_source_count, r.source_count) == (True, False, False, 2, 3)


def test_completeness(spark):
    full = {"source": "openalex", "title": "t", "abstract": "a", "authors": ["x"], "doi": "10.1/x", "publication_date": DAY(1), "primary_category": "c", "categories": ["c"], "pdf_url": "u", "venue": "v", "cited_by_count": 0, "references_count": 0}
    assert paper(spark, full).metadata_completeness_score == pytest.approx(0.9167)
    assert paper(spark, {**full, "has_code_link": True}).metadata_completeness_score == 1.0
    assert paper(spark, {"code_links": ["u"]}).metadata_completeness_score == 0.0


def test_same_for_any_partitioning_and_ties(spark):
    found = [{"key": f"k{i % 3}", "seq": i // 6, "source": "arxiv", "title": f"t{i % 4}", "doi": f"10.1/{i}", "authors": [f"A{i % 5}", f"a{i % 7}"]} for i in range(60)]
    got = [sorted(map(str, canonical.canonical_papers(rows(spark, *order).repartition(n), now=2025).collect())) for n, order in ((1, found), (7, found), (3, found[::-1]))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3


def test_empty_null_and_extra(spark):
    assert canonical.canonical_papers(rows(spark)).count() == 0 and canonical.richest(rows(spark)).count() == 0
    odd = spark.createDataFrame([("k", 1, "T", "m"), (None, 2, "U", "m"), ("k", 1, "T", "m")], "key string, seq long, title string, members string")
    got = canonical.canonical_papers(odd).collect()
    assert [(r.key, r.title, r.source_count, r.authors) for r in got] == [("k", "T", 2, [])]
    assert len(got[0].asDict()) == 59  # the key and every field but the source links
    assert canonical.source_links(odd).count() == 2


def test_many_observations_of_one_paper(spark):
    each = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("seq"), F.array(F.concat(F.lit("a"), F.col("id") % 50)).alias("authors"))
    hot = canonical.canonical_papers(each).where("key = 'hot'").first()
    assert (hot.source_count, len(hot.authors), hot.authors[:3]) == (6667, 50, ["a0", "a3", "a6"])


def test_richness(spark):
    score = lambda **r: rows(spark, r).select(canonical.richness_score().alias("x")).first().x
    assert score() == 0 and score(title="", authors=[], open_access=False, source_ids={}) == 0
    assert score(title="t", abstract="a", authors=["x"], doi="d", arxiv_id="a", openalex_id="o") == 14
    assert score(external_ids=dict.fromkeys("abcde", "1"), source_ids=dict.fromkeys("abc", "1")) == 5
    assert score(cited_by_count=0, references_count=1, is_preprint=True, is_open_access=False, citation_graph_available=True, updated_source_at=DAY(1)) == 5
    every = {n: {"string": "x", "timestamp": DAY(1), "int": 1, "boolean": True, "bigint": 1, "double": 0.5, "array<string>": ["x"], "map<string,string>": {"a": "1", "b": "1", "c": "1"}}[t] for n, t in canonical.SCHEMA.items()}
    assert score(**every) == 14 + 5 + len(canonical.SINGLE_POINTS)


def test_richest(spark):
    found = [
        {"key": "", "seq": 1, "doc_id": "a", "title": "t"},
        {"key": "", "seq": 2, "doc_id": "a", "title": "t", "abstract": "x"},
        {"key": "", "seq": 3, "doc_id": "b", "title": "x"},
        {"key": "", "seq": 4, "doc_id": "b", "title": "y"},
        {"key": "", "seq": 5, "doc_id": "c", "doi": "1", "updated_source_at": DAY(1)},
        {"key": "", "seq": 6, "doc_id": "c", "doi": "2", "updated_source_at": DAY(2)},
        {"key": "", "seq": 7, "doc_id": None, "doi": "2"},
    ]
    got = {r.doc_id: (r.seq, r.richness) for r in canonical.richest(rows(spark, *found)).collect()}
    assert got == {"a": (2, 6), "b": (3, 3), "c": (6, 3)}
