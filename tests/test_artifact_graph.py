"""The paper-artifact graph on literal cases; components against a plain program."""

import json
import random

import pytest

from corpusmill.operators import artifact_graph as g
from corpusmill.operators.components import components

SOURCE = "struct<source_family:string,source:string,source_name:string,name:string,family:string,source_id:string>"


def source(**k):
    return tuple(k.get(c) for c in ("source_family", "source", "source_name", "name", "family", "source_id"))


@pytest.fixture(scope="module")
def tables(spark):
    papers = spark.createDataFrame(
        [(1, "paper_1", "First Paper", 2024, [source(source="arxiv"), source(source_family="openalex")]), (2, "paper_2", "Second Paper", 2025, [source(source="semantic_scholar"), source(source_id=" crossref :10.1/x"), source(), source(source_id="bare")]), (3, None, "No id", 2020, []), (4, "", "Empty id", 2020, None)],
        f"position long, canonical_id string, title string, year int, sources array<{SOURCE}>",
    )
    artifacts = spark.createDataFrame(
        [(1, "artifact_1", "github_repository", "github", "https://github.com/example/repo", "example/repo"), (2, "artifact_2", "generic_code_url", "generic", "https://example.org/project", None), (3, "artifact_3", None, "", "https://example.org/other", "")],
        "position long, artifact_id string, artifact_type string, provider string, normalized_url string, name string",
    )
    made = [
        ("obs_1", "artifact_1", "github_repository", "github", "https://github.com/example/repo", "paper_1", "canonical", "arxiv", "1234.5678", "code_links", "code", 0.8),
        ("obs_2", "artifact_1", "github_repository", "github", "https://github.com/example/repo", "paper_1", "canonical", "openalex", "W123", "repo_url", "code", 0.95),
        ("obs_untrusted", "artifact_2", "generic_code_url", "generic", "https://example.org/project", "paper_2", "canonical", "semantic_scholar", "S123", "abstract", "code", 0.99),
        ("obs_low", "artifact_1", "github_repository", "github", None, "paper_2", "canonical", None, None, "code_links", "code", 0.6),
        ("obs_resolver", "artifact_2", "generic_code_url", "generic", "https://www.doi.org/10.1/x", "paper_2", None, None, None, "comment", "code", 0.99),
        ("obs_noise", "artifact_1", "github_repository", "github", "http://www.w3.org/x", "paper_2", None, None, None, "comment", "code", 0.99),
        ("obs_unknown", "artifact_1", "github_repository", "github", "https://github.com/a/b", "paper_2", None, None, None, "comment", "unknown", 0.99),
        ("obs_lost", "artifact_9", "github_repository", "github", "https://github.com/a/b", "paper_2", None, None, None, "comment", "code", 0.99),
        ("obs_orphan", "artifact_1", "github_repository", "github", "https://github.com/a/b", "paper_9", None, None, None, "comment", "code", None),
    ]
    shape = "observation_id string, artifact_id string, artifact_type string, provider string, normalized_url string, canonical_id string, source_layer string, source_name string, source_doc_id string, source_field string, relation_type string, confidence double"
    topics = spark.createDataFrame([(1, "paper_1", 7, 0.9), (2, "paper_2", 8, 0.8), (3, "paper_9", 8, 0.8), (4, "paper_2", None, 0.1)], "position long, canonical_id string, cluster_id int, score double")
    return papers, artifacts, spark.createDataFrame(made, shape), topics


def test_nodes_and_edges(spark, tables):
    nodes, edges = g.build(*tables, topic_build="topic_build_1")
    by = {r.node_id: r for r in nodes.collect()}
    assert len(by) == nodes.count()
    assert sorted(by) == ["artifact:artifact_1", "artifact:artifact_2", "artifact:artifact_3", "paper:paper_1", "paper:paper_2", "provider:generic", "provider:github", "provider:unknown", "source_family:arxiv", "source_family:crossref", "source_family:openalex", "source_family:semantic_scholar", "topic_cluster:7", "topic_cluster:8"]
    assert json.loads(by["paper:paper_1"].properties) == {"canonical_id": "paper_1", "title": "First Paper", "year": 2024}
    assert json.loads(by["topic_cluster:7"].properties) == {"topic_cluster_id": "7", "cluster_build_id": "topic_build_1"}
    assert [by[k].label for k in ("artifact:artifact_1", "artifact:artifact_2", "artifact:artifact_3", "topic_cluster:8")] == ["example/repo", "https://example.org/project", "https://example.org/other", "Topic cluster 8"]
    has = edges.where(f"edge_type = '{g.HAS_ARTIFACT}'").collect()
    assert [(r.source_node_id, r.target_node_id, r.confidence) for r in has] == [("paper:paper_1", "artifact:artifact_1", 0.95)]
    told = json.loads(has[0].properties)
    assert (told["evidence_source"], told["source_doc_id"], told["observations"]) == ("canonical:openalex", "W123", 2)
    assert json.loads(has[0].provenance)["trusted_link_policy_version"] == "artifact_trusted_links_policy_v1"
    import hashlib

    assert has[0].edge_id == "edge:" + hashlib.md5(b"paper_has_artifact\npaper:paper_1\nartifact:artifact_1\ncode").hexdigest()
    assert {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()} == {g.HAS_ARTIFACT: 1, g.FROM_PROVIDER: 3, g.IN_FAMILY: 4, g.IN_TOPIC: 2}


def test_quality_and_evidence(tables):
    counts = {r.name: r.n for r in g.quality(*tables).collect()}
    assert counts["trusted_links_raw_count"] == 2 and counts["trusted_links_used_count"] == 1 and counts["skipped_trusted_links_missing_artifact"] == 1
    assert (counts["canonical_papers_loaded"], counts["canonical_papers_with_ids"]) == (4, 2)
    assert [counts[f"topic_assignments_{c}"] for c in ("loaded", "valid", "missing_paper", "missing_cluster")] == [4, 2, 1, 1]
    rows = g.evidence(tables[2]).select("link_id", "observation_id").collect()
    assert sorted(r.observation_id for r in rows) == ["obs_1", "obs_2", "obs_lost"] and len({r.link_id for r in rows}) == 2


def test_queries_over_a_kept_graph(spark, tables, tmp_path):
    g.write(*g.build(*tables), str(tmp_path / "graph"))
    with pytest.raises(Exception, match="exist"):
        g.write(*g.build(*tables), str(tmp_path / "graph"))
    nodes, edges = g.read(spark, str(tmp_path / "graph"))
    ask = lambda **by: sorted((r.role, r.node_id, r.n, r.total) for r in g.query(nodes, edges, **by).collect())
    assert ask(paper="paper_1") == [("artifact", "artifact:artifact_1", 0, 1), ("source_family", "source_family:arxiv", 0, 2), ("source_family", "source_family:openalex", 0, 2), ("topic_cluster", "topic_cluster:7", 0, 1)]
    assert ask(artifact="artifact:artifact_1") == [("paper", "paper:paper_1", 0, 1), ("provider", "provider:github", 0, 1)]
    assert ask(provider="github") == [("artifact", "artifact:artifact_1", 1, 1)]
    assert ask(topic_cluster="7") == [("paper", "paper:paper_1", 1, 1)] and ask(topic_cluster="8") == [] and ask(paper="nobody") == []
    with pytest.raises(ValueError, match="one selector"):
        g.query(nodes, edges, paper="a", artifact="b")
    assert {r.name: r.n for r in g.summary(nodes, edges).collect()}["isolated_artifacts"] == 2
    plan = edges.where(f"edge_type = '{g.IN_TOPIC}'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(edge_type" in plan


def test_a_hub_artifact(spark):
    """Most links lead to one artifact: counts and ranks stay right, and no row gathers them."""
    n = 6000
    edges = spark.range(n).selectExpr("concat('edge:', id) as edge_id", f"'{g.HAS_ARTIFACT}' as edge_type", "concat('paper:', id) as source_node_id", "if(id % 3 > 0, 'artifact:hub', concat('artifact:', id)) as target_node_id", "'code' as relation", "1.0D as confidence")
    of = spark.range(n).selectExpr("concat('e:', id) as edge_id", f"'{g.FROM_PROVIDER}' as edge_type", "if(id = 1, 'artifact:hub', concat('artifact:', id)) as source_node_id", "'provider:p' as target_node_id", "'p' as relation", "cast(null as double) as confidence")
    nodes = of.selectExpr("source_node_id as node_id", "'artifact' as node_type", "source_node_id as label", "'{}' as properties")
    found = g.provider_artifacts(nodes, edges.unionByName(of), top=2).orderBy("rank").collect()
    assert [(r.node_id, r.linked_papers) for r in found] == [("artifact:hub", 4000), ("artifact:0", 1)]
    assert "collect_list" not in g.provider_artifacts(nodes, edges.unionByName(of), top=2)._jdf.queryExecution().toString()


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
