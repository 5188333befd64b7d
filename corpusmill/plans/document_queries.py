"""Queries over nested JSON documents as VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import documents as d
from corpusmill.plans.registry import Tables, query

_TEXT = """'{"id": ' || event_id || ', "tags": ["' || event_type || '", "x", null], "props": ' || props || ', "deep": [{"u": "' || user_id || '", "n": ' || user_id || '}, ["' || event_type || '", ["a.b"]]]}'"""


def _documents(t: Tables):
    return t.events.select("event_id", d.parsed(F.expr(_TEXT)).alias("v"))


@query("""select event_id, event_type = 'click' as has_tag, event_type = 'click' and user_id % 10 = 7 and user_id < 10 as has_tag_and_user, cast(json_extract(props, '$.k') as int) = 5 as has_prop, true as has_nested, false as has_flat, event_type in ('click', 'x') as has_null_and_tag from events""")
def c3_nested_containment(t: Tables):
    v = F.col("v")
    needles = {"has_tag": {"tags": ["click"]}, "has_tag_and_user": {"tags": ["click"], "deep": [{"u": "7", "n": 7}]}, "has_prop": {"props": {"k": 5}}, "has_nested": {"deep": [[["a.b"]]]}, "has_flat": {"deep": ["a.b"]}, "has_null_and_tag": {"tags": [None, "click"]}}
    return _documents(t).select("event_id", *[d.contains(v, n).alias(name) for name, n in needles.items()])


@query(f"""select event_id, fullkey as path, atom ->> '$' as value from (select event_id, {_TEXT} as j from events) e, json_tree(e.j) where type = 'VARCHAR'""")
def b15_document_strings(t: Tables):
    return d.strings(_documents(t), "event_id", "v", depth=6)


@query("""select event_id, cast(json_extract(props, '$.k') as int) as k, event_type as tag, cast(user_id as varchar) as u, cast(null as varchar) as none from events""")
def c5_document_paths(t: Tables):
    v = F.col("v")
    return _documents(t).select("event_id", d.value_at(v, "props.k", "int").alias("k"), d.value_at(v, "tags[0]").alias("tag"), d.value_at(v, "deep[0].u").alias("u"), d.value_at(v, "deep[7].u").alias("none"))
