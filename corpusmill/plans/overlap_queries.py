"""Queries over the keys that sources share, references that lead to one paper, and orders of artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import overlap
from corpusmill.operators import tables as ops
from corpusmill.plans.registry import Tables, query


@query("""with r as (select ['arxiv', 'crossref', 'openalex', 'semantic_scholar'][o_orderkey % 4 + 1] as source, case when o_orderkey % 3 > 0 then '10.1/x' || (o_orderkey % 90) end as doi, case when o_orderkey % 5 = 0 then 'a' || (o_orderkey % 35) end as arxiv_id, 'on ' || lower(o_orderpriority) || ' ' || (o_custkey % 20) as title, year(o_orderdate) as y from orders),
k as (select source, 'doi' as key, doi as v from r union select source, 'arxiv_id', arxiv_id from r union select source, 'title', title from r union select source, 'title_year', title || '::' || y from r), d as (select distinct * from k where v is not null), t as (select key, source, count(*) as n from d group by 1, 2),
s as (select a.key, a.source as source_a, b.source as source_b, count(*) as shared from d a join d b on a.key = b.key and a.v = b.v and a.source < b.source group by 1, 2, 3)
select s.key, source_a, source_b, shared, ta.n as a_values, tb.n as b_values from s join t ta on ta.key = s.key and ta.source = source_a join t tb on tb.key = s.key and tb.source = source_b""")
def d11_source_overlap(t: Tables):
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*[F.lit(s) for s in ("arxiv", "crossref", "openalex", "semantic_scholar")]), (k % 4 + 1).cast("int"))
    doi = F.when(k % 3 > 0, F.concat(F.when(k % 2 > 0, "https://doi.org/10.1/X").otherwise(" doi:10.1/x"), (k % 90).cast("string"), F.when(k % 7 > 0, "/").otherwise("")))
    arxiv = F.when(k % 5 == 0, F.concat(F.lit(" A"), (k % 35).cast("string")))
    rows = t.orders.select(source.alias("source"), doi.alias("doi"), arxiv.alias("arxiv"), F.concat_ws("  ", F.lit("On"), "o_orderpriority", (F.col("o_custkey") % 20).cast("string")).alias("title"), F.year("o_orderdate").alias("year"))
    return overlap.key_overlap(rows, "source", overlap.paper_keys(F.col("doi"), F.col("arxiv"), F.col("title"), F.col("year")))


@query("""with v as (select c_custkey, case when c_custkey % 3 = 0 then c_custkey else c_custkey % 50 end as value from customer), u as (select value, min(c_custkey) as target from v group by 1 having count(distinct c_custkey) = 1) select o_orderkey, target from orders left join u on o_custkey = value""")
def d10_unique_references(t: Tables):
    """References that lead to one paper resolve; those that several papers hold, and unknown ones, do not."""
    k = F.col("c_custkey")
    unique = ops.unique_key(t.customer.select(F.when(k % 3 == 0, k).otherwise(k % 50).alias("value"), k.alias("target")), ["value"], "target")
    return t.orders.join(unique, F.col("o_custkey") == F.col("value"), "left").select("o_orderkey", "target")


_ARTIFACTS = {
    "id": "event_id",
    "provider": "case when user_id % 4 > 0 then concat('p', cast(user_id % 4 as string)) end",
    "artifact_type": "event_type",
    "owner": "case when event_id % 5 > 0 then concat('o', cast(user_id as string)) end",
    "normalized_url": "concat('https://x.org/', cast(event_id as string))",
    "last_seen_at": "case when event_id % 3 > 0 then ts end",
    "updated_at": "ts",
    "stars": "case when event_id % 7 > 0 then cast(floor(value * 10) as int) end",
    "forks": "case when event_id % 6 > 0 then event_id % 100 end",
    "metadata": """case when event_id % 4 > 0 then concat('{"github": {"pushed_at": "2024-01-', cast(10 + event_id % 20 as string), 'T00:00:00"}}') when event_id % 8 = 0 then '{"github": {"pushed_at": ""}}' end""",
    "linked_papers_count": "case when event_id % 9 > 0 then user_id % 30 end",
}
_ROWS = "select " + ", ".join(f"{e} as {n}" for n, e in _ARTIFACTS.items()).replace("as string)", "as varchar)") + " from events"
_BY = {
    "provider_asc": "", "type_asc": "artifact_type asc nulls last,", "owner_asc": "owner asc nulls last,", "last_seen_desc": "last_seen_at desc nulls last,", "stars_desc": "stars desc nulls last,", "forks_desc": "forks desc nulls last,",
    "pushed_desc": "cast(nullif(metadata -> 'github' ->> 'pushed_at', '') as timestamp) desc nulls last,", "updated_desc": "updated_at desc nulls last,", "linked_papers_desc": "coalesce(linked_papers_count, 0) desc,",
}


@query(f"with a as ({_ROWS}) " + " union all ".join(f"select '{n}' as sort, p as position, id from (select id, row_number() over (order by {by} provider asc nulls last, normalized_url asc) as p from a) where p <= 50" for n, by in _BY.items()))
def g2_artifact_orders(t: Tables):
    """The first page of fifty by each of the nine orders."""
    a = t.events.selectExpr(*[f"{e} as {n}" for n, e in _ARTIFACTS.items()])

    def first(name: str) -> DataFrame:
        order = overlap.artifact_order(name)
        return a.orderBy(*order).limit(50).select(F.lit(name).alias("sort"), F.row_number().over(Window.orderBy(*order)).alias("position"), "id")  # fifty rows

    return reduce(DataFrame.unionByName, map(first, overlap.ORDERS))
