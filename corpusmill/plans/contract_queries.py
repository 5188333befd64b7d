"""Queries that hold canonical papers as JSON lines against their contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import contract
from corpusmill.plans.registry import Tables, query

# A line for each order, with faults of every kind by its key; both engines read it.
_LINE = """case when o_orderkey % 11 = 0 then '{broken' when o_orderkey % 11 = 1 then '["x"]' when o_orderkey % 11 = 2 then ' ' else
concat('{"canonical_id": ', case when o_orderkey % 13 = 0 then 'null' else concat('"c', cast(o_orderkey - o_orderkey % 2 as string), '"') end,
', "doc_ids": ', case when o_orderkey % 7 = 0 then '"d"' when o_orderkey % 7 = 1 then concat('["d', cast(o_orderkey as string), '", "d', cast(o_orderkey as string), '", "d', cast(o_orderkey as string), '"]') else concat('["d', cast(o_orderkey as string), '", "e', cast(o_orderkey % 50 as string), '"]') end,
case when o_orderkey % 5 = 0 then ', "color": 1' else '' end,
case when o_orderkey % 19 = 0 then ', "year": "soon"' when o_orderkey % 19 = 1 then ', "year": "2020"' else ', "year": 2021' end,
', "is_survey": ', case when o_orderkey % 23 = 0 then '"no"' else 'true' end, ', "authors": ', case when o_orderkey % 29 = 0 then 'null' else '["a"]' end,
', "reconciliation_key": "k"', case when o_orderkey % 31 > 0 then ', "title": "t"' else '' end, '}') end"""

_IDS = "case when o_orderkey % 7 = 0 then [] when o_orderkey % 7 = 1 then ['d' || o_orderkey] else ['d' || o_orderkey, 'e' || (o_orderkey % 50)] end"


@query(f"""with r as (select o_orderkey, o_orderkey % 11 > 2 as ok from orders), w as (select o_orderkey, case when o_orderkey % 13 > 0 then 'c' || (o_orderkey - o_orderkey % 2) end as paper, {_IDS} as ids from r where ok), f as (
select 'unreadable' as rule, null as detail, o_orderkey from r where o_orderkey % 11 = 0 union all select 'not_an_object', null, o_orderkey from r where o_orderkey % 11 = 1
union all select 'missing_id', null, o_orderkey from w where paper is null union all select 'extra_field', 'color', o_orderkey from w where o_orderkey % 5 = 0
union all select 'ids_not_a_list', null, o_orderkey from w where o_orderkey % 7 = 0 union all select 'repeated_doc_id', null, o_orderkey from w where o_orderkey % 7 = 1
union all select 'wrong_type', 'year', o_orderkey from w where o_orderkey % 19 = 0 union all select 'wrong_type', 'is_survey', o_orderkey from w where o_orderkey % 23 = 0 union all select 'missing_field', 'title', o_orderkey from w where o_orderkey % 31 = 0
union all select 'repeated_id', null, null from (select paper from w where paper is not null group by 1 having count(*) > 1)
union all select 'doc_id_of_several', null, null from (select id from (select paper, unnest(ids) as id from w where paper is not null) group by 1 having count(distinct paper) > 1))
select rule, detail, count(*) as faults, count(distinct o_orderkey) as lines from f group by 1, 2""")
def q1_canonical_contract(t: Tables):
    return contract.counts(contract.faults(t.orders.select("o_orderkey", F.expr(_LINE).alias("value")), "o_orderkey"), "o_orderkey")
