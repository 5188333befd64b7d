"""Queries of the paper-artifact graph: nodes, edges, what was left out, two-hop look-ups, coverage and components.

Orders stand for papers, parts for artifacts, line items for observations of links. The columns are shaped by the same
expressions on both sides; graphs, ranks and counts are each side's own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import artifact_graph as g
from corpusmill.operators.components import components
from corpusmill.plans.registry import Tables, query

_TYPE = "case {k} % 4 when 0 then 'github_repository' when 1 then 'huggingface_model' else 'generic_code_url' end"
_HOST = "case when {k} % 10 = 6 then 'https://dl.acm.org/x' else 'https://code.net/r' end || {k}"
_PAPER = {"position": "o_orderkey", "canonical_id": "o_orderkey", "title": "'Order ' || o_custkey", "year": "year(o_orderdate)"}
_ARTIFACT = {
    "position": "p_partkey",
    "artifact_id": "'a' || p_partkey",
    "artifact_type": _TYPE.format(k="p_partkey"),
    "provider": "case p_partkey % 4 when 0 then 'github' when 1 then 'huggingface' when 2 then p_brand else '' end",
    "normalized_url": _HOST.format(k="p_partkey"),
    "name": "case when p_partkey % 5 > 0 then p_name end",
}
_OBSERVATION = {
    "observation_id": "l_orderkey * 10 + l_linenumber",
    "canonical_id": "cast(l_orderkey as string)",
    "artifact_id": "case when l_suppkey % 20 = 0 then 'x' else 'a' end || l_partkey",
    "artifact_type": _TYPE.format(k="l_partkey"),
    "provider": "case l_partkey % 4 when 0 then 'github' when 1 then 'huggingface' else 'generic' end",
    "normalized_url": _HOST.format(k="l_partkey"),
    "source_layer": "case when l_linenumber > 2 then 'canonical' end",
    "source_name": "l_linestatus",
    "source_doc_id": "l_suppkey",
    "source_field": "case when l_linenumber % 2 = 1 then 'code_links' else 'abstract' end",
    "relation_type": "case l_returnflag when 'N' then 'code' when 'R' then 'dataset' else 'unknown' end",
    "confidence": "cast(l_quantity as double) / 50",
}
_TOPIC = {"position": "o_orderkey", "canonical_id": "case when o_custkey % 50 = 0 then 'none' || o_orderkey else cast(o_orderkey as string) end", "cluster_id": "case when o_orderkey % 7 > 0 then o_orderkey % 25 end", "score": "o_totalprice"}


def _sql(shape: dict[str, str], table: str) -> str:
    return f"select {', '.join(f'{v} as {k}' for k, v in shape.items())} from {table}"


_GRAPH = f"""with papers as (select cast(canonical_id as string) as canonical_id, title from ({_sql(_PAPER, "orders")})), artifacts as ({_sql(_ARTIFACT, "part")}), observations as ({_sql(_OBSERVATION, "lineitem")}), topics as ({_sql(_TOPIC, "orders")}),
families as (select o_orderkey as p, o_orderpriority as f from orders union select o_orderkey, 'cross' from orders where o_orderkey % 3 = 0),
trusted as (select * from observations where relation_type <> 'unknown' and case when artifact_type <> 'generic_code_url' then confidence >= 0.65 else confidence >= 0.9 and source_field = 'code_links' and normalized_url not like '%dl.acm.org%' end),
raw_links as (select canonical_id, artifact_id, relation_type, max(confidence) as confidence, count(*) as observations, arg_min(coalesce(source_layer, 'unknown') || ':' || source_name, struct_pack(c := -confidence, o := observation_id)) as evidence_source from trusted group by 1, 2, 3),
links as (select * from raw_links where canonical_id in (select canonical_id from papers) and artifact_id in (select artifact_id from artifacts)),
assigned as (select * from topics where cluster_id is not null and canonical_id in (select canonical_id from papers)),
ends as (select 'paper_has_artifact' as edge_type, 'paper:' || canonical_id as source_node_id, 'artifact:' || artifact_id as target_node_id, relation_type as relation, confidence from links
union all select 'artifact_from_provider', 'artifact:' || artifact_id, 'provider:' || coalesce(nullif(provider, ''), 'unknown'), coalesce(nullif(provider, ''), 'unknown'), null from artifacts
union all select 'paper_observed_in_source_family', 'paper:' || p, 'source_family:' || f, f, null from families
union all select 'paper_assigned_to_topic_cluster', 'paper:' || canonical_id, 'topic_cluster:' || cluster_id, cast(cluster_id as string), null from assigned),
nodes as (select 'paper:' || canonical_id as node_id, 'paper' as node_type, title as label from papers
union all select 'artifact:' || artifact_id, 'artifact', coalesce(name, normalized_url) from artifacts
union select 'provider:' || coalesce(nullif(provider, ''), 'unknown'), 'provider', coalesce(nullif(provider, ''), 'unknown') from artifacts
union select 'source_family:' || f, 'source_family', f from families union select 'topic_cluster:' || cluster_id, 'topic_cluster', 'Topic cluster ' || cluster_id from assigned)"""


def _shaped(df, shape: dict[str, str]):
    return df.select(*[F.expr(v).alias(k) for k, v in shape.items()])


def _tables(t: Tables):
    family = lambda kind, c: F.struct(*[(c if n == kind else F.lit(None)).cast("string").alias(n) for n in ("source_family", "source", "source_name", "name", "family", "source_id")])
    cross = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("cross:"), F.col("o_orderkey").cast("string")))
    papers = t.orders.select(*[F.expr(v).alias(k) for k, v in _PAPER.items()], F.array(family("source", F.col("o_orderpriority")), family("source_id", cross)).alias("sources"))
    return papers, _shaped(t.part, _ARTIFACT), _shaped(t.lineitem, _OBSERVATION), _shaped(t.orders, _TOPIC)


def _graph(t: Tables):
    return g.build(*_tables(t))


@query(f"{_GRAPH} select * from nodes")
def l3_graph_nodes(t: Tables):
    return _graph(t)[0].select("node_id", "node_type", "label")


@query(f"{_GRAPH} select 'edge:' || md5(concat_ws(chr(10), edge_type, source_node_id, target_node_id, relation)) as edge_id, * from ends")
def l3_graph_edges(t: Tables):
    return _graph(t)[1].select("edge_id", "edge_type", "source_node_id", "target_node_id", "relation", "confidence")


@query(f"{_GRAPH} select md5(concat_ws(chr(10), 'paper_artifact_link', canonical_id, artifact_id, relation_type)) as link_id, canonical_id, artifact_id, relation_type, confidence, evidence_source, observations from raw_links")
def e13_l3_trusted_link_rows(t: Tables):
    return g.trusted_links(_tables(t)[2]).select("link_id", "canonical_id", "artifact_id", "relation_type", "confidence", "evidence_source", "observations")


@query(f"""{_GRAPH} select 'trusted_links_raw_count' as name, count(*) as n from raw_links union all select 'trusted_links_used_count', count(*) from links
union all select 'skipped_trusted_links_missing_paper', count(*) from raw_links where canonical_id not in (select canonical_id from papers)
union all select 'skipped_trusted_links_missing_artifact', count(*) from raw_links where canonical_id in (select canonical_id from papers) and artifact_id not in (select artifact_id from artifacts)
union all select 'canonical_papers_loaded', count(*) from papers union all select 'canonical_papers_with_ids', count(*) from papers union all select 'artifact_entities_loaded', count(*) from artifacts union all select 'artifact_entities_with_ids', count(*) from artifacts
union all select 'artifact_observations_loaded', count(*) from observations union all select 'topic_assignments_loaded', count(*) from topics union all select 'topic_assignments_valid', count(*) from assigned
union all select 'topic_assignments_missing_paper', count(*) from topics where canonical_id not in (select canonical_id from papers) union all select 'topic_assignments_missing_cluster', count(*) from topics where canonical_id in (select canonical_id from papers) and cluster_id is null""")
def l3_graph_quality(t: Tables):
    return g.quality(*_tables(t))


@query(f"""{_GRAPH}, n as (select target_node_id as node_id, count(*) as n from ends where edge_type = 'paper_has_artifact' group by 1), r as (select target_node_id as provider_node_id, source_node_id as node_id, coalesce(n, 0) as linked_papers, row_number() over (partition by target_node_id order by coalesce(n, 0) desc, source_node_id) as rank from ends left join n on source_node_id = node_id where edge_type = 'artifact_from_provider')
select r.*, label from r join nodes using (node_id) where rank <= 10""")
def l12_provider_artifacts(t: Tables):
    return g.provider_artifacts(*_graph(t), top=10)


@query(f"""{_GRAPH}, n as (select source_node_id as node_id, count(*) as n from ends where edge_type = 'paper_has_artifact' group by 1), r as (select target_node_id as topic_node_id, source_node_id as node_id, n as artifacts, row_number() over (partition by target_node_id order by n desc, source_node_id) as rank from ends join n on source_node_id = node_id where edge_type = 'paper_assigned_to_topic_cluster')
select r.*, label from r join nodes using (node_id) where rank <= 10""")
def l12_topic_papers(t: Tables):
    return g.topic_papers(*_graph(t), top=10)


@query(f"""{_GRAPH}, a as (select source_node_id as p, target_node_id as topic_node_id from ends where edge_type = 'paper_assigned_to_topic_cluster'), h as (select distinct source_node_id as p, target_node_id as x from ends where edge_type = 'paper_has_artifact')
select topic_node_id, count(distinct p) as papers, count(distinct p) filter (where x is not null) as ready_papers, count(distinct x) as artifacts, count(x) as links, round(count(distinct p) filter (where x is not null) / cast(count(distinct p) as double), 6) as ready_ratio from a left join h using (p) group by 1""")
def l14_topic_coverage(t: Tables):
    return g.topic_coverage(_graph(t)[1])


@query(f"""{_GRAPH}, n as (select target_node_id as node_id, count(*) as n from ends where edge_type = 'paper_has_artifact' group by 1) select coalesce(nullif(lower(trim(provider)), ''), 'unknown') as provider, count(*) as artifacts, coalesce(sum(n), 0)::bigint as links from artifacts left join n on node_id = 'artifact:' || artifact_id group by 1""")
def l14_provider_distribution(t: Tables):
    return g.provider_distribution(*_graph(t))


@query(f"""{_GRAPH} select target_node_id as node_id, count(distinct source_node_id) as papers from ends where edge_type = 'paper_has_artifact' group by 1 having count(distinct source_node_id) > 1""")
def l14_shared_artifacts(t: Tables):
    return g.shared_artifacts(_graph(t)[1])


@query(f"""{_GRAPH}, h as (select * from ends where edge_type = 'paper_has_artifact') select 'node:' || node_type as name, count(*) as n from nodes group by 1 union all select 'edge:' || edge_type, count(*) from ends group by 1
union all select 'papers_with_artifacts', count(distinct source_node_id) from h union all select 'artifacts_with_papers', count(distinct target_node_id) from h union all select 'shared_artifacts', count(*) from (select target_node_id from h group by 1 having count(distinct source_node_id) > 1)
union all select 'isolated_artifacts', count(*) from nodes where node_type = 'artifact' and node_id not in (select target_node_id from h)""")
def l14_graph_summary(t: Tables):
    return g.summary(*_graph(t))


@query(f"""{_GRAPH.replace("with papers", "with recursive papers", 1)}, e as (select source_node_id as a, target_node_id as b from ends where edge_type = 'paper_has_artifact' and confidence >= 0.99), b as (select a, b from e union select b, a from e),
reach as (select a as node, a as root from b union select b.b, reach.root from reach join b on b.a = reach.node) select node, min(root) as component from reach group by 1""")
def l3_graph_components(t: Tables):
    """Papers and artifacts that links of the highest confidence hold together."""
    sure = _graph(t)[1].where((F.col("edge_type") == g.HAS_ARTIFACT) & (F.col("confidence") >= 0.99))
    return components(sure, "source_node_id", "target_node_id")
