"""Mentions, labels, the catalogue's tables, and the approximate index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.catalog import Engine
from corpusmill.operators import labels, mentions, retrieval


def test_windows_find_what_a_whole_text_has(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice(["Needle ", "hay ", "x"]) for _ in range(rnd.randint(0, 900)))) for i in range(20)] + [(50, None), (51, "")]

    def model(s):
        at, out = s.find("Needle"), []
        while at >= 0:
            out.append((at, at + 6, "needle", at / (len(s) + 1)))
            at = s.find("Needle", at + 1)
        return out

    got = {}
    for r in mentions.extract(spark.createDataFrame(rows, "doc int, t string"), "doc", "t", model, width=100, overlap=20).collect():
        got.setdefault(r.doc, []).append((r.s, r.e))
    for d, t in rows:
        assert sorted(got.get(d, [])) == [(s, e) for s, e, _, _ in model(t or "")]


def test_overlap_panel(spark):
    shape = "doc string, lo int, hi int, kind string, uncertain boolean"
    gold = spark.createDataFrame([("d", 0, 4, "A", False), ("d", 10, 20, "A", False), ("d", 30, 40, "B", False), ("d", 50, 55, "A", True)], shape)
    pred = spark.createDataFrame([("d", 0, 4, "A"), ("d", 10, 18, "A"), ("d", 30, 40, "A"), ("d", 51, 54, "A"), ("d", 60, 61, "A")], "doc string, lo int, hi int, kind string")
    got = {(r.typed, r.relaxed): (r.tp, r.predicted, r.reference) for r in mentions.overlap_panel(gold, pred, "doc").collect()}
    assert got == {(True, True): (2, 4, 3), (True, False): (1, 4, 3), (False, True): (3, 4, 3), (False, False): (2, 4, 3)}


def test_expected_counts(spark):
    with pytest.raises(ValueError):
        mentions.expect(spark.range(3), 2)
    assert mentions.expect(spark.range(3), 3).count() == 3


def test_labels_are_not_nested(spark):
    found = spark.createDataFrame([(1, "graph neural network", 40.0), (1, "neural network", 60.0), (1, "protein folding", 30.0), (1, "deep network", 20.0), (1, "sparse network", 10.0)], "c int, phrase string, score double")
    got = [r.phrase for r in labels.labels(found, "c").orderBy("position").collect()]
    assert got == ["neural network", "deep network", "protein folding"] or got == ["neural network", "protein folding", "deep network"]


def test_catalogue(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    artifacts = spark.createDataFrame([("x", "github"), ("y", "zenodo"), ("z", None)], "artifact_id string, provider string")
    links = spark.createDataFrame([(1, "x", "code", 0.9, "abstract"), (1, "x", "code", 0.7, "comment"), (2, "x", "code", 0.8, "abstract"), (1, "y", "data", 0.6, "abstract")], "paper long, artifact string, relation string, confidence double, field string")
    topics = spark.createDataFrame([(1, 7, 2, "nets"), (2, 7, 1, "nets"), (3, 8, 1, "cells")], "id long, cluster int, rank int, label string")
    edges = spark.createDataFrame([("e1", 1, 2), ("e2", 3, 1)], "edge_id string, source long, target long")
    e = Engine(spark, docs, edges=edges, artifacts=artifacts, links=links, topics=topics)
    assert [r.artifact_id for r in e.artifact_list(has_papers=False).collect()] == ["z"] and [r.artifact_id for r in e.artifact_list(provider="GITHUB").collect()] == ["x"]
    assert (r := e.artifact("x").first()).papers == 2 and r.relations == ["code"]
    assert [r.id for r in e.papers_of("x").collect()] == [1, 2]
    assert [(r.artifact_id, r.evidence, r.fields) for r in e.artifacts_of(1).collect()] == [("x", 2, "abstract,comment"), ("y", 1, "abstract")]
    assert [(r.cluster, r["size"]) for r in e.clusters().collect()] == [(7, 2), (8, 1)] and [r.id for r in e.cluster(7).collect()] == [2, 1]
    r = e.detail(1).first()
    assert (len(r.artifacts), r.cluster_label, r.references, r.citations) == (2, "nets", 1, 1)
    assert e.health()["topics"] == 3 and e.health()["vectors"] is None


def test_approximate_index_recalls(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    index, centres = retrieval.ann_index(v, "vec_id", "embedding", lists=16)
    assert index.count() == v.count()
    asked = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = {(r.query_id, r.key) for r in retrieval.ann_search(index, centres, asked, 10, probes=8).collect()}
    exact = {(r.query_id, r.vec_id) for r in retrieval.exact_knn(v, "vec_id", "embedding", asked, 10).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("include_self", [False, True])
def test_approximate_search_in_blocks(spark, monkeypatch, capsys, kind, include_self):
    """Every pair of a query and a member was a row of a join; blocks give the same rows: ties by key, a key twice, short lists."""
    monkeypatch.setattr(retrieval, "VALUES", 20, raising=False)
    monkeypatch.setattr(retrieval, "PAIRS", 64, raising=False)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (400, 4)) / 8
    keys = [i if i % 50 else 100 for i in range(400)]
    name = (lambda i: i) if kind == "long" else (lambda i: f"v{i}")
    centres = vectors[:6].copy()
    lists = np.argmin(((vectors[:, None] - centres) ** 2).sum(axis=2), axis=1)
    index = spark.createDataFrame([(int(j), name(k), v.tolist()) for j, k, v in zip(lists, keys, vectors, strict=True)], f"list int, key {kind}, vector array<float>")
    asked = [i for i in range(0, 400, 9) if i not in range(0, 400, 50)] + [100]
    queries = spark.createDataFrame([(name(i), vectors[i].tolist()) for i in asked], f"query_id {kind}, query array<float>")
    found = retrieval.ann_search(index, centres, queries, 5, probes=2, include_self=include_self)
    found.explain()
    assert "Join" not in capsys.readouterr().out
    expected = []
    for i in asked:
        near = sorted(range(6), key=lambda j: ((centres[j] @ centres[j] - 2 * centres[j] @ vectors[i]), j))[:2]
        scored = sorted((-round(float(vectors[i] @ v), 6), name(k)) for j, k, v in zip(lists, keys, vectors, strict=True) if j in near and (include_self or k != i))
        expected += [(name(i), k, -s, n) for n, (s, k) in enumerate(scored[:5], 1)]
    assert sorted((r.query_id, r.key, r.score, r["rank"]) for r in found.collect()) == sorted(expected)
    assert retrieval.ann_search(index, centres, queries.limit(0), 5, probes=2).count() == 0
    assert retrieval.ann_search(index.limit(0), centres, queries, 5, probes=2).count() == 0
