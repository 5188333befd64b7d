"""Queries for record fields, identity, canonical records and the citation graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import records, text
from corpusmill.operators import citations, identity
from corpusmill.operators.reconcile import Rule
from corpusmill.plans.registry import Tables, query


def _case(key: str, values: list) -> str:
    """SQL for the value that a key's remainder picks."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'") for i, v in enumerate(values)) + " end"


def _pick(key: str, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


# Spellings of licences and what they mean.
_LICENSES = [
    ("CC_BY 4.0", "cc-by"),
    ("http://creativecommons.org/licenses/by-nc-sa/3.0/", "cc-by-nc-sa"),
    ("https://www.elsevier.com/tdm/userlicense/1.0/", "publisher-tdm-policy"),
    ("https://ieeexplore.ieee.org/Xplorehelp/license.html", "publisher-license-page"),
    ("MIT License", "mit-license"),
    ("  ", None),
    (None, None),
    ("https://www.acm.org/publications/policies/copyright_policy#x", "https://www.acm.org/publications/policies/copyright-policy#x"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
]


@query(f"select p_partkey, {_case('p_partkey', [b for _, b in _LICENSES])} as license from part")
def b9_license(t: Tables):
    return t.part.select("p_partkey", records.license_label(_pick("p_partkey", [a for a, _ in _LICENSES])).alias("license"))


@query("""with r as (select c_custkey, case c_custkey % 3 when 0 then 'book-chapter' when 1 then 'Conference ' else 'article' end as kind, case when c_custkey % 5 > 0 then c_name end as venue, case when c_custkey % 4 = 0 then 'Lecture Notes in ' || c_mktsegment else 'J ' || c_mktsegment end as journal, case when c_custkey % 7 = 0 then '' when c_custkey % 7 = 1 then 'Springer Series X' end as conference from customer)
select c_custkey, venue, case when kind = 'book-chapter' and starts_with(journal, 'Lecture') then null else journal end as journal, case when kind = 'book-chapter' and starts_with(coalesce(conference, ''), 'Springer') then null when kind = 'Conference ' and coalesce(conference, '') = '' and venue is not null then venue else conference end as conference from r""")
def b10_venue(t: Tables):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "book-chapter").when(k % 3 == 1, "Conference ").otherwise("article")
    journal = F.when(k % 4 == 0, F.concat(F.lit("Lecture Notes in "), "c_mktsegment")).otherwise(F.concat(F.lit("J "), "c_mktsegment"))
    fields = records.venue_fields(kind, F.when(k % 5 > 0, F.col("c_name")), journal, F.when(k % 7 == 0, "").when(k % 7 == 1, "Springer Series X"))
    return t.customer.select("c_custkey", fields.alias("x")).select("c_custkey", "x.*")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then '10.1000/a' || o_custkey when 1 then '10.2000/b' || o_custkey when 2 then '10.3000/c' || o_custkey end as doi, case when o_orderkey % 3 = 0 then '2101.' || lpad(cast(o_custkey % 10000 as varchar), 5, '0') when o_orderkey % 3 = 1 then '1905.00001' end as arxiv from orders""")
def b7_field_coalesce(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    none = F.create_map(F.lit("x"), F.lit("y"))
    external = F.when(k % 4 == 1, F.create_map(F.lit("DOI"), F.concat(F.lit("doi:10.2000/B"), c))).otherwise(none)
    ids = F.when(k % 4 == 2, F.create_map(F.lit("Doi"), F.concat(F.lit("10.3000/c"), c))).otherwise(none)
    doi = records.doi_of(F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/a"), c)).otherwise("none"), external, ids)
    arxiv = records.arxiv_of(F.when(k % 3 == 0, F.concat(F.lit("arXiv:2101."), F.lpad((F.col("o_custkey") % 10000).cast("string"), 5, "0"), F.lit("v2"))), none, none, F.when(k % 3 == 1, "arXiv"), F.lit("http://arxiv.org/abs/1905.00001v3"))
    return t.orders.select("o_orderkey", doi.alias("doi"), arxiv.alias("arxiv"))


@query("""with r as (select s_suppkey, case s_suppkey % 5 when 0 then ['crossref', 'source_record_id', '10.1/x' || s_suppkey] when 1 then ['openalex', 'source_id', 'https://openalex.org/W' || s_suppkey] when 2 then ['arxiv', 'source_record_id', '2101.00001v2'] when 3 then ['my_feed', 'canonical_url', 'https://x.org/a?k=1&z=' || s_suppkey] else ['semantic_scholar', 'legacy_doc_id', 'ab' || s_suppkey] end as x from supplier)
select s_suppkey, x[1] as source, x[2] as basis, x[3] as value, substr(sha256('["source_observation_v1","' || x[1] || '","' || x[2] || '","' || x[3] || '"]'), 1, 32) as id from r""")
def b11_observation_identity(t: Tables):
    k, s = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    source = _pick("s_suppkey", ["crossref-alignment", "OpenAlex", "arxiv", "My  feed", "semantic scholar"])
    fields = {
        "source_record_id": F.when(k == 0, F.concat(F.lit("https://doi.org/10.1/X"), s)).when(k == 2, "http://arxiv.org/pdf/2101.00001v2.pdf#page=2"),
        "source_id": F.when(k == 1, F.concat(F.lit("w"), s)).when(k == 3, "  "),
        "legacy_doc_id": F.when(k == 4, F.concat(F.lit(" AB"), s)),
        "canonical_url": F.when(k == 3, F.concat(F.lit("HTTPS://X.org/a/?z="), s, F.lit("&k=1#top"))).otherwise("https://unused.org"),
    }
    return t.supplier.select("s_suppkey", records.observation_identity(source, fields).alias("x")).select("s_suppkey", "x.*")


@query("""select event_id, event_type || '|deep ' || user_id || '|q"uote' as strings from events""")
def b15_strings_in(t: Tables):
    json = F.concat(F.lit('{"a": "  '), "event_type", F.lit(' ", "n": 3, "b": [true, {"key": "deep   '), F.col("user_id").cast("string"), F.lit('", "e": ""}], "c": "q\\"uote"}'))
    return t.events.select("event_id", F.array_join(records.strings_in(json), "|").alias("strings"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'https://github.com/o/r' || p_partkey || ',https://gitlab.com/x' when 1 then 'https://example.org/Project-' || p_partkey else 'https://huggingface.co/m' end as links, case p_partkey % 4 when 0 then 'NeurIPS' when 1 then 'ICML' when 2 then 'TheWebConf' end as conference from part""")
def b20_code_links(t: Tables):
    p = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Code: https://github.com/o/r"), p, F.lit(", see https://gitlab.com/x and https://github.com/o/r"), p, F.lit("."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://example.org/paper https://example.org/Project-"), p, F.lit("}”"))).otherwise("www.example.org https://huggingface.co/m!")
    return t.part.select("p_partkey", F.array_join(records.code_links(said, F.lit(None).cast("string")), ",").alias("links"), records.conference_hint(_pick("p_partkey", ["Accepted at NIPS 2016", "to appear: icml'20", "TheWebConf 2021, WWW", "12 pages"])).alias("conference"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then year(o_orderdate) when 1 then year(o_orderdate) end as year from orders""")
def b31_year(t: Tables):
    y = F.year("o_orderdate").cast("string")
    return t.orders.select("o_orderkey", records.year_of(F.when(F.col("o_orderkey") % 3 == 0, y).when(F.col("o_orderkey") % 3 == 1, F.concat(y, F.lit("-05-01"))).otherwise("soon 1999")).alias("year"))


@query("""select doc_id, md5(case when doc_id % 4 = 0 then 'T ' || doc_id else 'T ' || doc_id || chr(10) || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || chr(10) || 'Categories: ' || lang || ', ' || source || chr(10) || 'Concepts: ' || array_to_string(list_transform(range(1, 16), lambda i: 'c' || i), ', ') end) as text_md5 from documents where length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 0""")
def b36_embedding_text(t: Tables):
    concepts = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("c"), i.cast("string")))
    said = records.embedding_text(F.concat(F.lit(" T  "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 4 != 0, F.col("text")), {"Categories": F.array("lang", "source"), "Tags": F.array().cast("array<string>"), "Concepts": concepts})
    return t.documents.where(text.normalize_text(F.col("text")) != "").select("doc_id", F.md5(said).alias("text_md5"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'arxiv,my source' when 1 then 'acl_anthology,openalex' when 2 then 'semantic_scholar' else '' end as families from customer""")
def b42_source_families(t: Tables):
    k = F.col("c_custkey") % 4
    none = F.array().cast("array<string>")
    names = F.when(k == 0, F.array(F.lit("arXiv_kaggle_snapshot"), F.lit("my source"), F.lit(""))).when(k == 1, F.array(F.lit("ACL"))).when(k == 2, F.array(F.lit("S2"), F.lit("semantic_scholar"))).otherwise(none)
    return t.customer.select("c_custkey", F.array_join(records.source_families(names, F.when(k == 0, F.array(F.lit("arxiv_id"))).when(k == 1, F.array(F.lit("openalex_id"))).otherwise(none), F.when(k == 1, F.array(F.lit("acl"), F.lit("nlp"))).otherwise(none)), ",").alias("families"))


def _observations(t: Tables):
    """Orders as observations of papers."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("seq"), "o_custkey",
        F.when(k % 4 != 0, F.concat(F.lit("10.1000/d"), (F.col("o_custkey") % 300).cast("string"))).alias("doi"),
        F.when(k % 7 < 2, F.concat(F.lit("2101.0000"), (k % 7).cast("string"))).alias("arxiv"),
        F.concat(F.lit("Title, No. "), (k % 50).cast("string")).alias("title"), F.year("o_orderdate").alias("year"),
    )


@query("""with r as (select o_orderkey as seq, case when o_orderkey % 4 <> 0 then '10.1000/d' || (o_custkey % 300) end as doi, case when o_orderkey % 7 < 2 then '2101.0000' || (o_orderkey % 7) end as arxiv, o_orderkey % 50 as n, year(o_orderdate) as y from orders), b as (select doi from r where doi is not null group by 1 having count(distinct arxiv) > 1)
select seq, case when doi in (select doi from b) and arxiv is not null then 'arxiv::' || arxiv when doi in (select doi from b) then 'doi_conflict::' || doi when doi is not null then 'doi::' || doi when arxiv is not null then 'arxiv::' || arxiv else 'title_year::title no ' || n || '::' || y end as key from r""")
def e2_reconciliation_groups(t: Tables):
    return identity.reconciliation_keys(_observations(t), "doi", "arxiv", "title", "year").select("seq", "key")


_SOURCES = ["arxiv", "openalex", "crossref", "semantic_scholar"]
_LABELS = ["cc-by-4.0", "https://www.elsevier.com/tdm/x", "CC0", None, "odd"]


@query(f"""with r as (select o_custkey, o_orderkey as seq, {_case('o_orderkey', _SOURCES)} as source, case o_orderkey % 4 when 0 then 60 when 1 then 95 when 2 then 100 else 80 end as p, case o_orderkey % 4 when 0 then 60 when 1 then 100 when 2 then 90 else 70 end as lp, o_orderpriority as title, o_orderdate, case when o_orderkey % 5 < 2 then o_totalprice > 200000 end as oa,
case o_orderkey % 5 when 0 then 'cc-by' when 1 then 'publisher-tdm-policy' when 2 then 'cc0' when 4 then 'odd' end as label, case o_orderkey % 5 when 0 then 100 when 1 then 30 when 2 then 100 else 0 end as q, case when o_orderkey % 6 = 0 then 'article' when o_orderkey % 6 = 1 then 'preprint' end as kind, o_orderkey % 6 > 0 as pre from orders)
select o_custkey as key, arg_max(title, struct_pack(l := length(title), p := p, s := -seq)) as title, min(year(o_orderdate)) as year, bool_or(oa) as open_access, count(distinct source) as source_distinct, count(*) as seq_count, arg_max(label, struct_pack(q := q, lp := lp, l := label)) filter (where label is not null) as license, case when bool_or(kind is not null and not pre) then false else bool_or(pre) end as is_preprint, bool_or(oa) filter (where source <> 'arxiv') as strict_open_access, substr(sha256(o_custkey::varchar), 1, 32) as canonical_id from r group by o_custkey""")
def e3_canonical_records(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("key"), k.alias("seq"), _pick("o_orderkey", _SOURCES).alias("source"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.when(k % 5 < 2, F.col("o_totalprice") > 200000).alias("open_access"), _pick("o_orderkey", _LABELS).alias("license"), F.when(k % 6 == 0, "article").when(k % 6 == 1, "preprint").alias("publication_type"), (k % 6 > 0).alias("is_preprint"))
    return identity.canonical_records(rows)


@query("""select o_custkey as key, max(o_totalprice) as value, array_to_string(list(o_orderkey order by o_orderkey) filter (where o_totalprice = m), ',') as seqs from (select *, max(o_totalprice) over (partition by o_custkey) as m from orders) group by 1""")
def q6_winners(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    w = identity.winners(rows, "key", "price", Rule("price", "max"))
    return w.select("key", "value", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ",").alias("seqs"))


@query("""select event_type, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by event_id) as n from events) where n = 1""")
def e15_observation_dedup(t: Tables):
    return identity.first_of(t.events.select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id")


@query("""select l_orderkey as paper, l_partkey as artifact, l_returnflag as relation, max(l_discount) as confidence, count(*) as evidence, string_agg(distinct l_linestatus, ',' order by l_linestatus) as fields from lineitem group by 1, 2, 3""")
def e29_artifact_details(t: Tables):
    return identity.artifact_details(t.lineitem.select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("artifact"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("field")))


@query("""with a as (select c_custkey, ['s' || (c_custkey % 3), 'n' || c_nationkey] as v from customer where c_custkey % 5 <> 0), b as (select c_custkey, ['s' || (c_custkey % 2), 'n' || c_nationkey] as v from customer where c_custkey % 4 <> 0)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when b.c_custkey is null then 'removed' when a.c_custkey is null then 'added' else 'retained' end as status, array_to_string(list_sort(list_filter(coalesce(a.v, []), lambda x: not list_contains(coalesce(b.v, []), x))), ',') as lost, array_to_string(list_sort(list_filter(coalesce(b.v, []), lambda x: not list_contains(coalesce(a.v, []), x))), ',') as gained from a full join b on a.c_custkey = b.c_custkey""")
def h6_source_coverage(t: Tables):
    v = lambda m: F.array(F.concat(F.lit("s"), (F.col("c_custkey") % m).cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return identity.lost_rows(t.customer.where("c_custkey % 5 <> 0").select("c_custkey", v(3).alias("v")), t.customer.where("c_custkey % 4 <> 0").select("c_custkey", v(2).alias("v")), "c_custkey", "v")


@query("""with s as (select distinct o_custkey from orders where o_orderkey % 20 = 0) select c_custkey as id, case when c_custkey % 4 = 0 then 'no_keys' when c_custkey in (select o_custkey from s) then 'present' else 'missing_from_snapshot' end as reason from customer where c_custkey % 2 = 0""")
def h7_alignment_losses(t: Tables):
    key = lambda c: F.concat(F.lit("doi::"), F.col(c).cast("string")).alias("key")
    return identity.alignment_losses(t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), key("c_custkey")), t.orders.where("o_orderkey % 20 = 0").select(key("o_custkey")))


def _papers(t: Tables):
    """Parts as papers that cite each other; two papers in four share a DOI."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    return t.part.select(
        k.alias("paper"), F.col("p_name").alias("title"), F.concat(F.lit("10.1000/p"), s(k - F.when(k % 4 == 1, 1).otherwise(0))).alias("doi"), F.lit(None).cast("string").alias("arxiv"), F.concat(F.lit("https://openalex.org/W"), s(k + 100000)).alias("openalex"),
        F.array(F.concat(F.lit("https://doi.org/10.1000/P"), s(k * 7 % 3000)), F.concat(F.lit("10.9999/out"), s(k % 3))).alias("dois"), F.array(F.lit("arXiv:1905.00001v2")).alias("arxiv_ids"),
        F.array(F.struct(F.lit(None).cast("string").alias("type"), F.concat(F.lit("W"), s(k * 3 % 2500 + 100000)).alias("id")), F.struct(F.lit("s2").alias("type"), F.lit("short").alias("id"))).alias("ids"),
    )


_EDGES = """refs as (select p_partkey as paper, 'doi' as kind, '10.1000/p' || (p_partkey * 7 % 3000) as value, 'dois' as fields from part union all select p_partkey, 'doi', '10.9999/out' || (p_partkey % 3), 'dois' from part union all select p_partkey, 'arxiv', '1905.00001', 'arxiv_ids' from part union all select p_partkey, 'openalex', 'W' || (p_partkey * 3 % 2500 + 100000), 'ids' from part),
own as (select 'doi' as kind, '10.1000/p' || (p_partkey - case when p_partkey % 4 = 1 then 1 else 0 end) as value, p_partkey as paper from part union all select 'openalex', 'W' || (p_partkey + 100000), p_partkey from part), uniq as (select kind, value, min(paper) as target from own group by 1, 2 having count(distinct paper) = 1),
e as (select r.paper, r.kind, r.value, u.target, r.fields, 1 as evidence, substr(sha1(concat_ws('|', case when u.target is null then 'cites_external' else 'cites_paper' end, r.paper, coalesce(u.target::varchar, r.kind || ':' || r.value))), 1, 20) as edge_id from refs r left join uniq u on u.kind = r.kind and u.value = r.value where u.target is null or u.target <> r.paper)"""


@query(f"with {_EDGES} select * from e")
def l1_reference_edges(t: Tables):
    return citations.edges(_papers(t))


@query(f"with {_EDGES} select 'paper:' || p as node_id, 'paper' as node_type, null as status from (select paper as p from e union select target from e where target is not null) union all select distinct 'external_reference:' || kind || ':' || value, 'external_reference', 'unresolved_external' from e where target is null")
def l2_reference_nodes(t: Tables):
    return citations.nodes(_papers(t), citations.edges(_papers(t)))


@query(f"with {_EDGES} select edge_id, e.paper, a.p_name as source_title, b.p_name as target_title from e join part a on a.p_partkey = e.paper left join part b on b.p_partkey = e.target")
def d17_hydrated_edges(t: Tables):
    papers = _papers(t)
    return citations.hydrated(citations.edges(papers), papers, "title").select("edge_id", "paper", "source_title", "target_title")


@query(f"with {_EDGES} select edge_id, paper, value from e where kind || ':' || value = 'doi:10.9999/out1'")
def l11_graph_query(t: Tables):
    return citations.query(citations.edges(_papers(t)), reference="doi:10.9999/out1").select("edge_id", "paper", "value")


@query("""with t as (select *, case when p_size is null then 1 else 0 end as no_size from part) select 'duplicate_ids' as rule, (select count(*) - count(distinct p_partkey) from t) as violations union all select 'unit_score', (select count(*) from t where not (p_size / 50.0 between 0 and 1)) union all select 'known_brand', (select count(*) from t where not coalesce(p_brand in ('Brand#1', 'Brand#2'), false)) union all select 'same_rows', (select abs(count(*) - (select count(*) from part)) from t)""")
def q4_feature_checks(t: Tables):
    from corpusmill.operators import tables as ops

    rows = t.part
    row_rules = ops.checks(rows, {"unit_score": (F.col("p_size") / 50.0).between(0, 1), "known_brand": F.col("p_brand").isin("Brand#1", "Brand#2")})
    return row_rules.unionByName(ops.duplicates(rows, "p_partkey")).unionByName(ops.row_parity(rows, t.part))
