"""Property graph of papers, artifacts, providers, source families and topics: build, keep, query, count.

Nodes: node_id ("paper:7"), node_type, label, properties (JSON without nulls). Edges: edge_id (md5 of type, ends and
relation), edge_type, source_node_id, target_node_id, relation, confidence, properties, provenance. All of it is joins
and aggregations on keys; what one link rests on stays a table of its own (``evidence``), so neither a hub artifact nor
a link seen a million times becomes one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import links, text

HAS_ARTIFACT, FROM_PROVIDER, IN_FAMILY, IN_TOPIC = "paper_has_artifact", "artifact_from_provider", "paper_observed_in_source_family", "paper_assigned_to_topic_cluster"
_EDGE = ["edge_id", "edge_type", "source_node_id", "target_node_id", "relation", "confidence", "properties", "provenance"]


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def _given(c: Column) -> Column:
    """A key as text; null where it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def _json(**fields: Column) -> Column:
    """Properties as JSON; nulls are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _fold(rows: DataFrame, kind: str, key: Column, label: Column, fields: list[str], order: str) -> DataFrame:
    """One node for each key: the first row's label, of each field the last value that isn't null."""
    rows = rows.withColumn("_key", key).where("_key is not null").withColumn("_label", label)
    one = rows.groupBy("_key").agg(F.min_by("_label", order).alias("_label"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])
    return one.select(node_id(kind, F.col("_key")).alias("node_id"), F.lit(kind).alias("node_type"), F.coalesce(_given(F.col("_label")), F.col("_key")).alias("label"), _json(**{c: F.col(c) for c in fields}).alias("properties"))


def _edge(rows: DataFrame, kind: str, source: Column, target: Column, relation: Column, properties: Column, provenance: dict[str, str], order: str, confidence: Column | None = None) -> DataFrame:
    """One edge for each type, ends and relation: the first row's."""
    told = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in provenance.items()]))
    rows = rows.select(source.alias("source_node_id"), target.alias("target_node_id"), F.coalesce(relation, F.lit("")).alias("relation"), F.struct((F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"), properties.alias("properties")).alias("_x"), F.col(order).alias("_order"))
    one = rows.groupBy("source_node_id", "target_node_id", "relation").agg(F.min_by("_x", "_order").alias("_x"))
    key = F.concat(F.lit("edge:"), text.joined_md5(F.lit(kind), F.col("source_node_id"), F.col("target_node_id"), F.col("relation")))
    return one.select(key.alias("edge_id"), F.lit(kind).alias("edge_type"), "source_node_id", "target_node_id", "relation", "_x.confidence", "_x.properties", told.alias("provenance"))


def source_family(source: Column) -> Column:
    """Of a source struct(source_family, source, source_name, name, family, source_id): the first that is given, else what stands before the colon of its id."""
    first = F.coalesce(*[_given(F.trim(source[c])) for c in ("source_family", "source", "source_name", "name", "family")])
    return F.coalesce(first, F.when(source["source_id"].contains(":"), _given(F.trim(F.substring_index(source["source_id"], ":", 1)))))


def evidence(observations: DataFrame) -> DataFrame:
    """The trusted observations with the link_id each stands for."""
    rows = observations.where(links.trusted_observation())
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("canonical_id", "artifact_id", "relation_type")]
    return rows.withColumn("relation_type", ids[2]).withColumn("link_id", text.joined_md5(F.lit("paper_artifact_link"), *ids))


def trusted_links(observations: DataFrame, order: str = "observation_id") -> DataFrame:
    """One link for each paper, artifact and relation: its strongest observation (the first of equals), and how many there are."""
    rows = evidence(observations).withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
    rows = rows.withColumn("evidence_source", F.concat_ws(":", F.coalesce(_given(F.col("source_layer")), F.lit("unknown")), F.coalesce(_given(F.col("source_name")), F.lit("unknown"))))
    kept = ["evidence_source", F.col("normalized_url").alias("evidence_url"), "source_field", "source_doc_id"]
    ranked = rows.groupBy("link_id", "canonical_id", "artifact_id", "relation_type").agg(
        F.min_by(F.struct("confidence", *kept), F.struct((-F.col("confidence")).alias("c"), F.col(order).alias("o"))).alias("x"), F.count(F.lit(1)).alias("observations"), F.min(order).alias("first_seen")
    )
    return ranked.select("link_id", "canonical_id", "artifact_id", "relation_type", "x.*", "observations", "first_seen")


def build(papers: DataFrame, artifacts: DataFrame, observations: DataFrame, topics: DataFrame | None = None, topic_build: str | None = None, order: str = "position") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges.

    papers: canonical_id, title, sources (array of structs as in source_family), and any of year, doi, arxiv_id,
    primary_category; artifacts: artifact_id, artifact_type, provider, normalized_url, canonical_url, name; observations:
    as in trusted_links; topics: canonical_id, cluster_id, score. ``order`` says which of repeated rows comes first.
    Links and assignments to unknown papers or artifacts are left out (``quality`` counts them).
    """
    fields = [c for c in ("canonical_id", "title", "year", "doi", "arxiv_id", "primary_category", "source_count", "unique_source_count") if c in papers.columns]
    paper_key, artifact_key = _given(F.col("canonical_id")), _given(F.col("artifact_id"))
    nodes = [_fold(papers, "paper", paper_key, F.col("title"), fields, order)]
    seen = papers.where(paper_key.isNotNull()).select(order, paper_key.alias("p"), F.explode("sources").alias("s")).select(order, "p", source_family(F.col("s")).alias("source_family")).where("source_family is not null")
    nodes.append(_fold(seen, "source_family", F.col("source_family"), F.col("source_family"), ["source_family"], order))
    family = F.col("source_family")
    edges = [_edge(seen, IN_FAMILY, node_id("paper", F.col("p")), node_id("source_family", family), family, _json(source_family=family), {"source_layer": "canonical_documents.sources", "source": "canonical_documents"}, order)]
    own = [c for c in ("artifact_id", "artifact_type", "provider", "normalized_url", "canonical_url", "external_id", "name") if c in artifacts.columns]
    nodes.append(_fold(artifacts, "artifact", artifact_key, F.coalesce(_given(F.col("name")), _given(F.col("normalized_url"))), own, order))
    made = artifacts.where(artifact_key.isNotNull()).withColumn("provider", F.coalesce(_given(F.col("provider")), F.lit("unknown"))).withColumn("a", artifact_key)
    nodes.append(_fold(made, "provider", F.col("provider"), F.col("provider"), ["provider"], order))
    told = _json(provider=F.col("provider"), artifact_type=F.coalesce(_given(F.col("artifact_type")), F.lit("artifact")))
    edges.append(_edge(made, FROM_PROVIDER, node_id("artifact", F.col("a")), node_id("provider", F.col("provider")), F.col("provider"), told, {"source_layer": "artifact_entities", "source": "artifact_entities_latest"}, order))
    linked = _with_ends(trusted_links(observations), papers, artifacts)
    told = _json(link_id=F.col("link_id"), relation_type=F.col("relation_type"), confidence=F.col("confidence"), evidence_source=F.col("evidence_source"), evidence_url=F.col("evidence_url"), source_field=F.col("source_field"), source_doc_id=F.col("source_doc_id"), observations=F.col("observations"))
    edges.append(_edge(linked, HAS_ARTIFACT, node_id("paper", F.col("canonical_id")), node_id("artifact", F.col("artifact_id")), F.col("relation_type"), told, {"source_layer": "artifact_observations", "source": "artifact_links_latest", "trusted_link_policy_version": links.TRUST_POLICY}, "first_seen", F.col("confidence")))
    if topics is not None:
        at = topics.where(_given(F.col("cluster_id")).isNotNull()).join(papers.select(paper_key.alias("canonical_id")).distinct(), "canonical_id", "left_semi").withColumn("topic_cluster_id", F.col("cluster_id").cast("string"))
        nodes.append(_fold(at.withColumn("cluster_build_id", F.lit(topic_build)), "topic_cluster", F.col("topic_cluster_id"), F.concat(F.lit("Topic cluster "), F.col("topic_cluster_id")), ["topic_cluster_id", "cluster_build_id"], order))
        told = _json(topic_cluster_id=F.col("topic_cluster_id"), score=F.col("score"))
        edges.append(_edge(at, IN_TOPIC, node_id("paper", F.col("canonical_id")), node_id("topic_cluster", F.col("topic_cluster_id")), F.col("topic_cluster_id"), told, {"source_layer": "topic_clusters", "source": "topic_assignments"}, order))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges).select(*_EDGE)


def _with_ends(found: DataFrame, papers: DataFrame, artifacts: DataFrame) -> DataFrame:
    found = found.withColumn("canonical_id", F.col("canonical_id").cast("string")).withColumn("artifact_id", F.col("artifact_id").cast("string"))
    for c, table in (("canonical_id", papers), ("artifact_id", artifacts)):
        found = found.join(table.select(F.col(c).cast("string").alias(c)).distinct(), c, "left_semi")
    return found


def quality(papers: DataFrame, artifacts: DataFrame, observations: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(name, n): what was loaded, which links and assignments were used, and why others were not."""
    known = lambda df, c, mark: df.where(_given(F.col(c)).isNotNull()).select(F.col(c).cast("string").alias(c), F.lit(True).alias(mark)).distinct()
    found = trusted_links(observations).select(F.col("canonical_id").cast("string").alias("canonical_id"), F.col("artifact_id").cast("string").alias("artifact_id"))
    found = found.join(known(papers, "canonical_id", "_p"), "canonical_id", "left").join(known(artifacts, "artifact_id", "_a"), "artifact_id", "left")
    p, a = F.col("_p").isNotNull(), F.col("_a").isNotNull()
    counts = [found.agg(F.count(F.lit(1)).alias("trusted_links_raw_count"), F.count_if(p & a).alias("trusted_links_used_count"), F.count_if(~p).alias("skipped_trusted_links_missing_paper"), F.count_if(p & ~a).alias("skipped_trusted_links_missing_artifact"))]
    for name, df, c in (("canonical_papers", papers, "canonical_id"), ("artifact_entities", artifacts, "artifact_id")):
        counts.append(df.agg(F.count(F.lit(1)).alias(f"{name}_loaded"), F.countDistinct(_given(F.col(c))).alias(f"{name}_with_ids")))
    counts.append(observations.agg(F.count(F.lit(1)).alias("artifact_observations_loaded")))
    if topics is not None:
        at = topics.withColumn("canonical_id", F.col("canonical_id").cast("string")).join(known(papers, "canonical_id", "_p"), "canonical_id", "left")
        has = _given(F.col("cluster_id")).isNotNull()
        counts.append(at.agg(F.count(F.lit(1)).alias("topic_assignments_loaded"), F.count_if(p & has).alias("topic_assignments_valid"), F.count_if(~p).alias("topic_assignments_missing_paper"), F.count_if(p & ~has).alias("topic_assignments_missing_cluster")))
    return reduce(DataFrame.unionByName, [c.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in c.columns]))) for c in counts])


def write(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Two tables in folders by type, so that a query of one type reads no other."""
    nodes.write.mode(mode).partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("edge_type").parquet(f"{path}/edges")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def degrees(edges: DataFrame, kind: str, end: str) -> DataFrame:
    """(node_id, n): edges of a type by their source or target."""
    return edges.where(F.col("edge_type") == kind).groupBy(F.col(f"{end}_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


def provider_artifacts(nodes: DataFrame, edges: DataFrame, top: int, provider: str | None = None) -> DataFrame:
    """(provider_node_id, node_id, label, linked_papers, rank): of each provider, the artifacts with the most links, ties by id; two hops."""
    at = edges.where(F.col("edge_type") == FROM_PROVIDER).select(F.col("target_node_id").alias("provider_node_id"), F.col("source_node_id").alias("node_id"))
    at = at if provider is None else at.where(F.col("provider_node_id") == provider)
    rows = at.join(degrees(edges, HAS_ARTIFACT, "target"), "node_id", "left").select("provider_node_id", "node_id", F.coalesce("n", F.lit(0)).alias("linked_papers"))
    return _labelled(_top(rows, "provider_node_id", "linked_papers", top), nodes)


def topic_papers(nodes: DataFrame, edges: DataFrame, top: int, topic: str | None = None) -> DataFrame:
    """(topic_node_id, node_id, label, artifacts, rank): of each topic, the papers with the most artifacts, those without left out."""
    at = edges.where(F.col("edge_type") == IN_TOPIC).select(F.col("target_node_id").alias("topic_node_id"), F.col("source_node_id").alias("node_id"))
    at = at if topic is None else at.where(F.col("topic_node_id") == topic)
    rows = at.join(degrees(edges, HAS_ARTIFACT, "source"), "node_id").withColumnRenamed("n", "artifacts")
    return _labelled(_top(rows, "topic_node_id", "artifacts", top), nodes)


def _top(rows: DataFrame, by: str, n: str, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(n), "node_id"))).where(F.col("rank") <= top)


def _labelled(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select("node_id", "label"), "node_id", "left")


def query(nodes: DataFrame, edges: DataFrame, top: int = 10, **by: str) -> DataFrame:
    """Neighbours by one selector (paper, artifact, provider or topic_cluster; the key or the node_id): role, node_id, label, relation, confidence, n, rank, total.

    n: the links of a provider's artifact or of a topic's paper. ``top`` limits each role; total says how many there are.
    """
    if len(by) != 1 or next(iter(by)) not in ("paper", "artifact", "provider", "topic_cluster"):
        raise ValueError("one selector: paper, artifact, provider or topic_cluster")
    (kind, key), = by.items()
    at = key if key.startswith(f"{kind}:") else f"{kind}:{key}"
    if kind in ("provider", "topic_cluster"):
        role = "artifact" if kind == "provider" else "paper"
        near = edges.where((F.col("edge_type") == (FROM_PROVIDER if kind == "provider" else IN_TOPIC)) & (F.col("target_node_id") == at)).select(F.col("source_node_id").alias("node_id"))
        hop = "target" if kind == "provider" else "source"
        links_of = degrees(edges.join(near.withColumnRenamed("node_id", f"{hop}_node_id"), f"{hop}_node_id", "left_semi"), HAS_ARTIFACT, hop)
        rows = near.join(links_of, "node_id", "left" if kind == "provider" else "inner").select(F.lit(role).alias("role"), "node_id", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"))
    else:
        sides = {"paper": [(HAS_ARTIFACT, "source", "target"), (IN_TOPIC, "source", "target"), (IN_FAMILY, "source", "target")], "artifact": [(HAS_ARTIFACT, "target", "source"), (FROM_PROVIDER, "source", "target")]}[kind]
        rows = reduce(DataFrame.unionByName, [edges.where((F.col("edge_type") == t) & (F.col(f"{own}_node_id") == at)).select(F.substring_index(f"{other}_node_id", ":", 1).alias("role"), F.col(f"{other}_node_id").alias("node_id"), F.when(F.lit(t == HAS_ARTIFACT), F.col("relation")).alias("relation"), "confidence", F.lit(0).cast("long").alias("n")) for t, own, other in sides])
    w = Window.partitionBy("role")
    rows = rows.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "node_id", "relation"))).where(F.col("rank") <= top)
    return _labelled(rows, nodes)


def topic_coverage(edges: DataFrame) -> DataFrame:
    """By topic: papers, papers with an artifact, distinct artifacts and links of these, and the share of such papers."""
    at = edges.where(F.col("edge_type") == IN_TOPIC).select(F.col("target_node_id").alias("topic_node_id"), F.col("source_node_id").alias("p")).distinct()
    has = edges.where(F.col("edge_type") == HAS_ARTIFACT).select(F.col("source_node_id").alias("p"), F.col("target_node_id").alias("a")).distinct()
    rows = at.join(has, "p", "left")
    one = rows.groupBy("topic_node_id").agg(F.countDistinct("p").alias("papers"), F.countDistinct(F.when(F.col("a").isNotNull(), F.col("p"))).alias("ready_papers"), F.countDistinct("a").alias("artifacts"), F.count("a").alias("links"))
    return one.withColumn("ready_ratio", F.round(F.col("ready_papers") / F.col("papers"), 6))


def provider_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(provider, artifacts, links), the provider as the artifact says it, in lower case."""
    said = F.coalesce(_given(F.lower(F.trim(F.get_json_object("properties", "$.provider")))), F.lit("unknown"))
    own = nodes.where("node_type = 'artifact'").select("node_id", said.alias("provider"))
    n = own.join(degrees(edges, HAS_ARTIFACT, "target"), "node_id", "left")
    return n.groupBy("provider").agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


def shared_artifacts(edges: DataFrame) -> DataFrame:
    """(node_id, papers): artifacts that more than one paper links to."""
    has = edges.where(F.col("edge_type") == HAS_ARTIFACT).select(F.col("target_node_id").alias("node_id"), "source_node_id").distinct()
    return has.groupBy("node_id").agg(F.count(F.lit(1)).alias("papers")).where("papers > 1")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): nodes and edges by type, papers with artifacts, artifacts with papers, shared and isolated ones."""
    by = lambda df, c, name: df.groupBy(F.concat(F.lit(f"{name}:"), F.col(c)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    has = edges.where(F.col("edge_type") == HAS_ARTIFACT)
    count = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    linked = has.select(F.col("target_node_id").alias("node_id"))
    told = [count(has, "papers_with_artifacts", F.countDistinct("source_node_id")), count(linked, "artifacts_with_papers", F.countDistinct("node_id"))]
    told += [count(shared_artifacts(edges), "shared_artifacts", F.count(F.lit(1))), count(nodes.where("node_type = 'artifact'").join(linked, "node_id", "left_anti"), "isolated_artifacts", F.count(F.lit(1)))]
    return reduce(DataFrame.unionByName, [by(nodes, "node_type", "node"), by(edges, "edge_type", "edge"), *told])
