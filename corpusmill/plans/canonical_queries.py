"""Queries over whole canonical papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import canonical
from corpusmill.plans.registry import Tables, query

# Observations as SQL that both engines read: orders stand for observations, customers for papers.
_FIELDS = {
    "key": "o_custkey",
    "seq": "o_orderkey",
    "source": "case o_orderkey % 5 when 0 then 'arxiv' when 1 then 'openalex' when 2 then 'crossref' when 3 then 'semantic_scholar' else 'other' end",
    "source_id": "concat('s', cast(o_orderkey % 9 as string))",
    "doc_id": "case when o_orderkey % 6 > 0 then concat('d', cast(o_orderkey % 10 as string)) end",
    "title": "concat('On ', o_orderpriority)",
    "abstract": "case when o_orderkey % 3 = 0 then concat('About ', o_orderstatus, ' ', o_orderpriority) when o_orderkey % 3 = 1 then '' end",
    "doi": "case when o_orderkey % 11 = 0 then concat('10.1/', cast(o_orderkey as string)) end",
    "arxiv_id": "case when o_orderkey % 7 = 0 then concat('a', cast(o_orderkey as string)) end",
    "pmid": "case when o_orderkey % 4 = 0 then concat(' p', cast(o_orderkey % 100 as string), ' ') end",
    "published_at": "o_orderdate",
    "updated_source_at": "case when o_orderkey % 3 > 0 then o_orderdate end",
    "year": "case when o_orderkey % 13 = 0 then 1800 else cast(year(o_orderdate) as int) end",
    "repo_url": "case when o_orderkey % 6 = 0 then concat('https://g.org/', cast(o_orderkey as string)) end",
    "venue": "case when o_orderkey % 3 = 0 then ' ' when o_orderkey % 3 = 1 then concat('V', o_orderstatus) end",
    "comment": "case when o_orderkey % 4 = 1 then concat('J', o_orderpriority) end",
    "publication_type": "case when o_orderkey % 6 = 0 then 'article' when o_orderkey % 6 = 1 then 'preprint' when o_orderkey % 6 = 2 then 'conference' end",
    "is_preprint": "case when o_orderkey % 8 > 0 then o_orderkey % 6 > 1 end",
    "open_access": "case when o_orderkey % 5 < 3 then o_totalprice > 150000 end",
    "is_open_access": "case when o_orderkey % 7 = 1 then o_totalprice > 250000 end",
    "cited_by_count": "case when o_orderkey % 5 = 2 then o_orderkey % 100 end",
    "has_code_link": "o_orderkey % 17 = 0",
    "is_survey": "o_totalprice > 400000",
    "authors": "array('A ', concat('n', cast(o_orderkey % 4 as string)), concat('N', cast(o_orderkey % 6 as string)), ' ')",
    "referenced_ids": "case when o_orderkey % 2 = 0 then array(concat('W', cast(o_orderkey % 7 as string)), 'w1') end",
}


_ROWS = ("select " + ", ".join(f"{e} as {n}" for n, e in _FIELDS.items()) + " from orders").replace("as string)", "as varchar)").replace("array(", "list_value(")


def _told(field: str, rank: str = "0") -> str:
    """SQL for (key, the distinct members of a list field in order)."""
    return f"""(select key, string_agg(v, '|' order by p, seq, i) as {field} from (select key, trim(v) as v, p, seq, i, row_number() over (partition by key, lower(trim(v)) order by p, seq, i) as n
from (select key, seq, {rank} as p, unnest({field}) as v, generate_subscripts({field}, 1) as i from r) where trim(v) <> '') where n = 1 group by key)"""


_BIBLIOGRAPHIC = "case source when 'crossref' then 100 when 'openalex' then 95 when 'semantic_scholar' then 80 when 'arxiv' then 60 else 0 end"
_VENUE = "case source when 'openalex' then 100 when 'crossref' then 95 when 'semantic_scholar' then 80 when 'arxiv' then 60 else 0 end"
_COMMENT = "case source when 'arxiv' then 100 when 'openalex' then 80 else 0 end"
_ARTIFACTS = "case source when 'arxiv' then 80 when 'openalex' then 60 when 'semantic_scholar' then 50 when 'crossref' then 40 else 0 end"

_E3 = f"""with r as ({_ROWS}), a as (select key,
arg_max(title, struct_pack(n := length(title), t := source = 'openalex', s := -seq)) as title,
arg_max(abstract, struct_pack(n := length(abstract), t := source = 'openalex', s := -seq)) filter (where abstract <> '') as abstract,
arg_min(doi, seq) filter (where doi is not null) as doi,
coalesce(arg_min(arxiv_id, seq) filter (where arxiv_id is not null and source = 'arxiv'), arg_min(arxiv_id, seq) filter (where arxiv_id is not null)) as arxiv_id,
arg_min(trim(pmid), seq) filter (where pmid is not null) as pmid,
min(published_at) as published_at, max(updated_source_at) as updated_at, min(year) filter (where year >= 1900) as year,
arg_max(repo_url, struct_pack(p := {_ARTIFACTS}, n := length(repo_url), s := -seq)) filter (where repo_url is not null) as repo_url,
arg_max(trim(venue), struct_pack(p := {_VENUE}, v := trim(venue))) filter (where trim(venue) <> '') as venue,
arg_max(comment, struct_pack(p := {_COMMENT}, n := length(comment), v := comment)) filter (where comment is not null) as comment,
coalesce(arg_max(publication_type, struct_pack(p := {_BIBLIOGRAPHIC}, v := publication_type)) filter (where publication_type is not null and not coalesce(is_preprint, false)), arg_max(publication_type, struct_pack(p := {_BIBLIOGRAPHIC}, v := publication_type)) filter (where publication_type is not null)) as publication_type,
bool_or(publication_type is not null and not coalesce(is_preprint, false)) as published, bool_or(is_preprint) as pre,
bool_or(open_access) as open_access, greatest(bool_or(is_open_access) filter (where source <> 'arxiv'), bool_or(open_access) filter (where source <> 'arxiv')) as is_open_access,
max(cited_by_count) as cited_by_count, bool_or(has_code_link) as code, bool_or(is_survey) as is_survey, count(*) as source_count, count(distinct source) as unique_source_count from r group by key),
ids as (select key, string_agg(doc_id, '|' order by s) as doc_ids from (select key, doc_id, min(seq) as s from r where doc_id is not null group by 1, 2) group by key),
maps as (select key, string_agg(name || '=' || v, '|' order by name) as source_ids from (select key, name, arg_min(v, struct_pack(s := seq, p := p)) as v from (select key, seq, source as name, source_id as v, 0 as p from r union all select key, seq, 'arxiv', arxiv_id, 1 from r where arxiv_id is not null) group by 1, 2) group by key)
select a.key, title, abstract, doi, arxiv_id, pmid, published_at, updated_at, year, repo_url, venue, case when publication_type = 'conference' then venue end as conference, comment, publication_type, case when published then false when pre is not null then pre when publication_type is not null then publication_type = 'preprint' end as is_preprint, open_access, is_open_access, cited_by_count, code or repo_url is not null as has_code_link, is_survey, source_count, unique_source_count,
round((1 + (abstract is not null)::int + (authors is not null)::int + (doi is not null)::int + (venue is not null)::int + (cited_by_count is not null)::int + code::int) / 12.0, 4)::double as metadata_completeness_score,
authors, coalesce(referenced_ids, '') as referenced_ids, coalesce(doc_ids, '') as doc_ids, source_ids, substr(sha256(a.key::varchar), 1, 32) as canonical_id
from a left join {_told('authors')} u on a.key = u.key left join {_told('referenced_ids', '-' + _BIBLIOGRAPHIC)} f on a.key = f.key left join ids on a.key = ids.key left join maps on a.key = maps.key"""

_SHOWN = "key title abstract doi arxiv_id pmid published_at updated_at year repo_url venue conference comment publication_type is_preprint open_access is_open_access cited_by_count has_code_link is_survey source_count unique_source_count metadata_completeness_score".split()


def _observations(t: Tables):
    return t.orders.selectExpr(*[f"{e} as {n}" for n, e in _FIELDS.items()])


@query(_E3)
def e3_canonical_papers(t: Tables):
    p = canonical.canonical_papers(_observations(t))
    said = [F.array_join(n, "|").alias(n) for n in ("authors", "referenced_ids", "doc_ids")]
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("source_ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return p.select(*_SHOWN, *said, pairs.alias("source_ids"), "canonical_id")


_POINTS = """3 + 3 * (coalesce(abstract, '') <> '')::int + 2 + 2 * (doi is not null)::int + 2 * (arxiv_id is not null)::int + 1 + (updated_source_at is not null)::int + (repo_url is not null)::int + coalesce(open_access, false)::int + (venue is not null)::int + (comment is not null)::int + (publication_type is not null)::int + (cited_by_count is not null)::int + (referenced_ids is not null)::int + coalesce(is_open_access, false)::int + coalesce(is_preprint, false)::int"""


@query(f"""with r as ({_ROWS}), p as (select *, {_POINTS} as richness from r where doc_id is not null)
select doc_id, seq, richness, updated_source_at from (select *, row_number() over (partition by doc_id order by richness desc, coalesce(updated_source_at, timestamp '0001-01-01') desc, seq) as n from p) where n = 1""")
def b27_richest(t: Tables):
    return canonical.richest(_observations(t)).select("doc_id", "seq", "richness", "updated_source_at")
