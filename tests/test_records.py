"""Fields and identities of records on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import links, records, text
from corpusmill.operators import citations, evaluation, identity, retrieval, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.org/", "https://x.org/"),
        ("https://x.org", "https://x.org"),
        ("HTTPS://X.Org/A/b//", "https://x.org/A/b"),
        ("example.com/a", "https:///example.com/a"),
        ("https://x.org/p?a=b+c&a2=1&a=0", "https://x.org/p?a=0&a=b+c&a2=1"),
        ("https://x.org/p?q=%7Euser%2A&z&&e=", "https://x.org/p?e=&q=~user%2A&z="),
        ("https://x.org/p?q=100%&r=%zz", "https://x.org/p?q=100%25&r=%25zz"),
        (" http://x.org/p;v=1?b=2#part ", "http://x.org/p?b=2"),
        ("//x.org/p/", "https://x.org/p"),
        ("mailto:a@b.c", "mailto:a@b.c"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, text.canonicalize_url(F.lit(url))) == want


def test_url_rules(spark):
    got = lambda url, relation="unknown": one(spark, links.classify_url(F.lit(url), F.lit(relation)))
    assert got("https://github.com/search") is None and got("https://github.com/Topics/x") is None and got("no url") is None
    r = got("https://www.github.com/o/r.git/tree/main")
    assert (r.artifact_type, r.provider, r.normalized_url, r.external_id, r.owner, r.name) == ("github_repository", "github", "https://github.com/o/r", "o/r", "o", "r")
    assert got("https://huggingface.co/papers/x") is None and got("https://x.net/a") is None
    assert got("https://x.net/a/b/", "dataset").name == "b" and got("https://x.net", "demo").artifact_type == "generic_artifact_url"
    assert got("https://x.net/a.pdf", "code") is None and got("https://www.arxiv.org/abs/1", "code") is None
    assert one(spark, links.relation_of_type(F.lit("huggingface_space"), F.lit(None))) == "demo"


def test_observation_identity(spark):
    got = one(spark, records.observation_identity(F.lit("crossref"), {"source_record_id": F.lit(None).cast("string"), "source_id": F.lit("10.1/ABC")}))
    other = one(spark, records.observation_identity(F.lit("openalex"), {"source_record_id": F.lit("10.1/abc")}))
    assert (got.source, got.basis, got.value) == ("crossref", "source_id", "10.1/abc") and got.id != other.id and len(got.id) == 32
    assert one(spark, records.observation_identity(F.lit(" "), {"source_id": F.lit("x")})) is None
    assert one(spark, records.observation_identity(F.lit("x"), {"source_id": F.lit(" ")})) is None


def test_two_sources_of_one_doi(spark):
    rows = [
        (1, "arxiv", "10.1000/x", "Graph Nets", ["A One", "b two"], 2021, True, None, True, "CC BY 4.0"),
        (2, "crossref", "https://doi.org/10.1000/X", "Graph Nets for Molecules", ["B Two", "C Three"], 2022, None, "journal-article", False, "https://www.elsevier.com/tdm/x"),
        (3, "crossref", None, "Other", None, 2020, False, None, None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, source string, doi string, title string, authors array<string>, year int, open_access boolean, publication_type string, is_preprint boolean, license string")
    df = df.withColumn("doi", text.doi_key(F.col("doi"))).withColumn("arxiv", F.lit(None).cast("string"))
    keyed = identity.reconciliation_keys(df, "doi", "arxiv", "title", "year")
    got = {r.key: r for r in identity.canonical_records(keyed).collect()}
    assert set(got) == {"doi::10.1000/x", "title_year::other::2020"}
    r = got["doi::10.1000/x"]
    assert (r.title, r.authors, r.year, r.open_access, r.strict_open_access, r.is_preprint, r.license, r.seq_count) == ("Graph Nets for Molecules", ["A One", "b two", "C Three"], 2021, True, None, False, "cc-by", 2)


def test_doi_of_several_arxiv_papers(spark):
    rows = [("10.1/a", "2101.00001"), ("10.1/a", "2101.00002"), ("10.1/a", None), ("10.1/b", "2101.00003"), (None, "2101.00003"), (None, None)]
    df = spark.createDataFrame(rows, "doi string, arxiv string").withColumns({"title": F.lit("The  T!"), "year": F.lit(None).cast("int")})
    got = sorted(r.key for r in identity.reconciliation_keys(df, "doi", "arxiv", "title", "year").collect())
    assert got == ["arxiv::2101.00001", "arxiv::2101.00002", "arxiv::2101.00003", "doi::10.1/b", "doi_conflict::10.1/a", "title_year::the t::unknown"]


def test_fields(spark):
    assert one(spark, F.array_join(records.strings_in(F.lit('{"k": "a  b", "l": [1, true, ["c", {"m": "d\\"e"}], ""], "n": null}')), "|")) == 'a b|c|d"e'
    assert [one(spark, records.year_of(F.lit(x))) for x in ("2021", "2021-05", " 1999 x", "x", None)] == [2021, 2021, 1999, None, None]
    assert one(spark, records.embedding_text(F.lit("T"), F.lit(" "), {})) == "T"
    assert one(spark, records.preprint_flag(F.lit(False), F.lit(None).cast("boolean"), F.lit("Working Paper"))) is True


def test_references_resolve_where_they_lead_to_one_paper(spark):
    shape = "paper string, title string, doi string, arxiv string, openalex string, dois array<string>, arxiv_ids array<string>, ids array<struct<type:string,id:string>>"
    rows = [
        ("p1", "One", "10.1000/one", None, None, ["https://doi.org/10.1000/TWO", "10.1000/one"], ["arXiv:2101.00001v3"], [(None, "W123456"), ("raw", " note ")]),
        ("p2", "Two", "10.1000/two", "2101.00001", "https://openalex.org/W123456", None, None, None),
        ("p3", "Three", "10.1000/same", None, None, ["10.1000/same"], None, None),
        ("p4", "Four", "10.1000/same", None, None, None, None, [("doi", "10.1000/gone")]),
    ]
    papers = spark.createDataFrame(rows, shape)
    e = citations.edges(papers)
    got = sorted((r.paper, r.kind, r.value, r.target) for r in e.collect())
    assert got == [("p1", "arxiv", "2101.00001", "p2"), ("p1", "doi", "10.1000/two", "p2"), ("p1", "openalex", "W123456", "p2"), ("p1", "raw", "note", None), ("p3", "doi", "10.1000/same", None), ("p4", "doi", "10.1000/gone", None)]
    assert {r.node_id for r in citations.nodes(papers, e).collect()} == {"paper:p1", "paper:p2", "paper:p3", "paper:p4", "external_reference:raw:note", "external_reference:doi:10.1000/same", "external_reference:doi:10.1000/gone"}
    assert [r.papers for r in citations.query(e, top=5).collect()] == [1] and citations.query(e, target="p2").count() == 3
    with pytest.raises(ValueError):
        citations.query(e, paper="p1", top=1)


def test_ranking_effects(spark):
    run = lambda ids: [("q", k, i) for i, k in enumerate(ids, 1)]
    grades = spark.createDataFrame([("q", "a", 1), ("q", "b", 1), ("q", "z", 0)], "query_id string, key string, grade int")
    effect = lambda x, y, g=grades: evaluation.ranking_effects(spark.createDataFrame(run(x), "query_id string, key string, rank int"), spark.createDataFrame(run(y), "query_id string, key string, rank int"), g, 2).first().effect
    assert effect("acb", "cab") == "ranking_hurt_order" and effect("cab", "acb") == "ranking_helped"
    assert effect("acb", "xyz") == "ranking_removed_relevant_from_top_k" and effect("xya", "axy") == "ranking_added_relevant_to_top_k"
    assert effect("xya", "xyb") == "ranking_no_effect" and effect("xyz", "yxz") == "tie_or_boundary_effect"
    assert effect("ab", "ba", grades.where("false")) == "insufficient_labels"


def test_knn_takes_every_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    rows = [(i, [float((i * 7919) % 101), float((i * 104729) % 103)]) for i in range(60)]
    v = spark.createDataFrame(rows, "k long, e array<float>").repartition(3)
    got = {}
    for r in retrieval.exact_knn(v, "k", "e", v.where("k < 40").select(F.col("k").alias("query_id"), F.col("e").alias("query")), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.k, r.score))
    for q in range(40):
        near = sorted(((-(rows[q][1][0] * e[0] + rows[q][1][1] * e[1]), k) for k, e in rows if k != q))[:3]
        assert [(k, -s) for s, k in near] == [(k, s) for _, k, s in sorted(got[q])]
    assert retrieval.exact_knn(v, "k", "e", v.limit(0).select(F.col("k").alias("query_id"), F.col("e").alias("query")), 3).count() == 0


def test_pareto_holds_all_rows_against_all(spark):
    df = spark.createDataFrame([(i, i, -i) for i in range(12_000)] + [(12_000, 20_000, -20_000)], "id long, good long, cost long")
    assert [r.id for r in retrieval.pareto(df, ["good"], ["cost"]).collect()] == [12_000]


def test_page_refuses_what_it_cannot_give(spark):
    assert tables.page(spark.range(500), [F.asc("id")], 300).count() == 300
    with pytest.raises(ValueError):
        tables.page(spark.range(5), [F.asc("id")], 0)


def test_candidate_pool():
    assert [evaluation.candidate_pool(*x) for x in ((10, 0, 10_000), (100, 50, 10_000), (10, 0, 20))] == [50, 500, 20]
