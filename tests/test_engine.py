"""Reconciliation rules, matching, provider records and the engine object."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.catalog import Engine
from corpusmill.operators import matching, reconcile, retrieval
from corpusmill.plans import registry, search_queries  # noqa: F401  registers its queries
from corpusmill.sources import records


def test_reconcile(spark):
    rows = [("k", "arxiv", 0, "Short", None, ["A", "b"], 2020, True), ("k", "openalex", 1, "Longer one", "CC", ["a", "C"], 2019, None), ("k", "x", 2, None, "BY", None, 2021, False), ("j", "x", 3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, source string, seq int, title string, license string, authors array<string>, year int, oa boolean")
    R = reconcile.Rule
    got = {r.key: r for r in reconcile.reconcile(df, "key", [R("title", "longest"), R("license", "preferred", {"openalex": 2, "x": 1}), R("authors", "union"), R("year", "min"), R("oa", "any"), R("source", "distinct")]).collect()}
    assert tuple(got["k"])[1:] == ("Longer one", "CC", ["A", "b", "C"], 2019, True, 3)
    assert tuple(got["j"])[1:] == (None, None, [], None, None, 1)


def test_best_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 5))).round(3) * (rng.random() < 2)
        w[rng.random(w.shape) < 0.4] = 0
        got = matching.best_assignment(w)
        a, b = w.shape
        best = max(((sum(w[i, j] > 0 for i, j in zip(r, c, strict=False)), round(sum(w[i, j] for i, j in zip(r, c, strict=False)), 9)) for r in permutations(range(a)) for c in permutations(range(b))), default=(0, 0))
        assert (len(got), pytest.approx(sum(w[i, j] for i, j in got))) == best


def test_evaluate(spark):
    kind = "doc int, lo long, hi long, kind string"
    gold = spark.createDataFrame([(1, 0, 5, "a"), (1, 10, 20, "a"), (1, 30, 40, "b"), (1, 50, 60, "a"), (2, 0, 3, "a")], kind)
    said = spark.createDataFrame([(1, 0, 5, "a"), (1, 11, 20, "a"), (1, 30, 40, "a"), (1, 58, 70, "a"), (3, 0, 3, "a")], kind)
    got = sorted((r.key, r.outcome) for r in matching.evaluate(gold, said, "doc").collect())
    assert got == [(1, "boundary_mismatch"), (1, "exact"), (1, "relaxed"), (1, "type_mismatch"), (2, "false_negative"), (3, "false_positive")]
    assert matching.optimal_pairs(gold, said, "doc").count() == 3


def test_records(spark):
    raw = [("openalex", {"id": "W1", "doi": "https://doi.org/10.1000/A", "title": "T", "publication_year": 3000, "publication_date": "2020-02-03", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "X"}}], "open_access": {"is_oa": True}}), ("crossref", {"DOI": "10.1000/b", "title": ["U"], "issued": {"date-parts": [[2019, 4]]}, "author": [{"given": "A", "family": "B"}], "abstract": "<p>x</p>"}), ("semantic_scholar", {"paperId": "s", "title": "V", "year": 2018, "externalIds": {"DOI": "10.1000/c"}, "authors": [{"name": "Z"}]})]
    out = {p: records.observations(spark.createDataFrame([(json.dumps(r),)], "value string"), p, 2026).first() for p, r in raw}
    assert (out["openalex"].abstract, out["openalex"].year, out["openalex"].doi) == ("a b", 2020, "10.1000/a")
    assert (str(out["crossref"].published), out["crossref"].authors, out["crossref"].abstract) == ("2019-04-01", ["A B"], "x")
    assert (out["semantic_scholar"].doi, out["semantic_scholar"].year) == ("10.1000/c", 2018)
    assert records.observations(spark.createDataFrame([("{",)], "value string"), "crossref", 2026).first().title is None
    assert max(len(r["keys"]) for r in records.in_chunks(spark.range(500), "id", 3).collect()) == 3


def test_engine(spark):
    docs = spark.createDataFrame([(1, "graph neural networks", 2020, "a"), (2, "graphs of molecules", 2021, "b"), (3, "cooking", None, "a")], "id long, text string, year int, source string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    edges = spark.createDataFrame([("e1", 1, 2), ("e2", 3, 2)], "edge_id string, source long, target long")
    features = spark.createDataFrame([(1, 0.5, True), (2, 0.9, False), (3, 1.0, None)], "id long, impact double, has_code boolean")
    e = Engine(spark, docs, vectors, edges, features)
    assert [r.id for r in e.search("graph networks").collect()] == [1, 2, 3]
    assert [r.id for r in e.search("graph", year_from=2021).collect()] == [2]
    assert e.search("graph", mode="hybrid", vector=[0.0, 1.0]).count() == 3
    assert [r.id for r in e.search("", mode="dense", vector=[0.0, 1.0], limit=2).collect()] == [3, 2]
    assert [r.id for r in e.similar(1).collect()] == [2, 3]
    assert [r.id for r in e.list("year").collect()] == [2, 1, 3]
    assert [r.id for r in e.rank({"weights": {"impact": 1.0}, "limit": 2}).collect()] == [3, 2]
    assert [r.id for r in e.rank({"weights": {"impact": 1.0}, "filters": {"has_code": False}}).collect()] == [3, 2]
    assert (e.references(1).count(), e.citations(2).count()) == (1, 2)
    assert [r.id for r in e.compare([3, 1]).collect()] == [3, 1]
    with pytest.raises(ValueError):
        e.compare([1])
    assert docs.agg(F.count(F.lit(1))).first()[0] == 3


def test_exact_knn_answers_every_query(spark):
    v = spark.range(3).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("e"))
    q = spark.range(1500).select((F.col("id") + 10).alias("query_id"), F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("query"))
    got = retrieval.exact_knn(v, "doc_id", "e", q, 1).collect()
    assert sorted((r.query_id, r.doc_id, r.score) for r in got) == [(i, 2, 2.0) for i in range(10, 1510)]


def test_pareto_compares_with_all_rows(spark):
    rows = spark.range(10_500, numPartitions=1).select("id", F.when(F.col("id") == 10_499, 10**6).otherwise(F.col("id")).alias("q"), F.when(F.col("id") == 10_499, -1).otherwise(F.col("id")).alias("cost"))
    assert [r.id for r in retrieval.pareto(rows, ["q"], ["cost"]).collect()] == [10_499]


def test_fuzzy_join_covers_the_whole_table(spark, tmp_path):
    rows = [(1, "dark green lace", 5), (500, "dark green lacy", 5), (900, "dark green laces", 5), (901, "dark green lace", 6), (902, "x", 5), (903, None, 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["d12_fuzzy_join"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 500), (1, 900), (500, 900)]
