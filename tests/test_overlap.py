"""Keys that sources share, and orders of artifacts, on literal cases."""

from pyspark.sql import functions as F

from corpusmill.operators import overlap


def test_four_keys(spark):
    rows = [
        ("openalex", "https://doi.org/10.1/A/", None, "The  Title", 2020),
        ("arxiv", "doi:10.1/a", "2101.1 ", "the title", 2021),
        ("arxiv", " ", "", " ", None),
        ("crossref", "10.1/b", "2101.1", "Other", None),
        ("crossref", "10.1/a", None, None, None),
        (None, "10.1/b", "2101.1", "Other", None),
        ("openalex", "10.1/a", None, "The Title", 2020),
    ]
    df = spark.createDataFrame(rows * 2, "source string, doi string, arxiv string, title string, year int")
    got = {(r.key, r.source_a, r.source_b): (r.shared, r.a_values, r.b_values) for r in overlap.key_overlap(df, "source", overlap.paper_keys(*[F.col(c) for c in ("doi", "arxiv", "title", "year")])).collect()}
    assert got == {("doi", "arxiv", "openalex"): (1, 1, 1), ("doi", "arxiv", "crossref"): (1, 1, 2), ("doi", "crossref", "openalex"): (1, 2, 1), ("arxiv_id", "arxiv", "crossref"): (1, 1, 1), ("title", "arxiv", "openalex"): (1, 1, 1)}
    assert overlap.key_overlap(df.where("false"), "source", {"doi": F.col("doi")}).count() == 0


def test_orders(spark):
    rows = [(1, "b", "u1", 5, '{"github": {"pushed_at": "2024-01-01T00:00:00Z"}}'), (2, "a", "u2", None, '{"github": {"pushed_at": ""}}'), (3, "a", "u1", 5, "x"), (4, None, "u0", 9, '{"github": {"pushed_at": "2024-02-01T00:00:00Z"}}')]
    df = spark.createDataFrame(rows, "id int, provider string, normalized_url string, stars int, metadata string").withColumn("linked_papers_count", F.when(F.col("id") == 3, 1))
    by = lambda name: [r.id for r in df.orderBy(*overlap.artifact_order(name)).collect()]
    assert by("provider_asc") == [3, 2, 1, 4] and by("stars_desc") == [4, 3, 1, 2] and by("pushed_desc") == [4, 1, 3, 2]
    assert by("linked_papers_desc") == by("no such order") == [3, 2, 1, 4]
