"""Queries for sources, scalar functions, filters and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators import tables as ops
from corpusmill.plans.registry import Tables, query


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as norm_md5 from documents")
def b1_normalize_text(t: Tables):
    return t.documents.select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("norm_md5"))


@query("""with u as (select page_id, regexp_replace(trim(url), '#.*$', '') as u from pages), p as (select page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) as host, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) as path, regexp_extract(u, '\\?(.*)$', 1) as q from u),
k as (select page_id, string_agg(k || '=' || v, '&' order by k, v) as q from (select page_id, split_part(x, '=', 1) as k, case when contains(x, '=') then substr(x, strpos(x, '=') + 1) else '' end as v from (select page_id, unnest(string_split(q, '&')) as x from p) where x <> '') group by 1)
select page_id, scheme || '://' || host || case when path = '/' then path else regexp_replace(path, '/+$', '') end || case when k.q <> '' then '?' || k.q else '' end as canonical from p left join k using (page_id)""")
def b2_canonical_url(t: Tables):
    return t.pages.select("page_id", text.canonicalize_url(F.col("url")).alias("canonical"))


@query("""select doc_id, substr(sha256(source || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 32) as content_hash, substr(sha256(source), 1, 32) as source_id from documents""")
def b3_content_hash(t: Tables):
    return t.documents.select("doc_id", text.content_hash(F.col("source"), F.col("text")).alias("content_hash"), text.stable_hash(F.col("source")).alias("source_id"))


@query("""select doc_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g') as title_key from documents""")
def b4_title_key(t: Tables):
    return t.documents.select("doc_id", text.title_key(F.col("text")).alias("title_key"))


@query("""with r as (select o_orderkey, case o_orderkey % 5 when 0 then 'https://doi.org/10.1000/ab.' || o_custkey || '.' when 1 then 'doi:10.1000/X' || o_custkey when 2 then '10.1000/a; 10.1000/b' when 3 then null else 'none' end as raw from orders),
f as (select o_orderkey, list_distinct(list_transform(regexp_extract_all(lower(raw), '10\\.[0-9]{4,9}/[^\\s"<>]+'), lambda x: regexp_replace(x, '[.,;:)\\]]+$', ''))) as d from r)
select o_orderkey, case when len(d) = 1 then d[1] end as doi from f""")
def b5_doi_key(t: Tables):
    k = F.col("o_orderkey") % 5
    cust = F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("https://doi.org/10.1000/ab."), cust, F.lit("."))).when(k == 1, F.concat(F.lit("doi:10.1000/X"), cust)).when(k == 2, "10.1000/a; 10.1000/b").when(k == 4, "none")
    return t.orders.select("o_orderkey", text.doi_key(raw).alias("doi"))


@query("""with r as (select o_orderkey, case o_orderkey % 4 when 0 then 'https://arxiv.org/abs/2101.' || lpad(cast(o_custkey % 10000 as varchar), 5, '0') || 'v' || (1 + o_orderkey % 3) when 1 then 'arXiv:cs.LG/' || lpad(cast(o_custkey as varchar), 7, '0') when 2 then 'hep-th/9901001v2' else 'x' end as raw from orders),
e as (select o_orderkey, regexp_extract(lower(trim(raw)), '([0-9]{4}\\.[0-9]{4,5}|[a-z-]+(?:\\.[a-z]{2})?/[0-9]{7})(v[0-9]+)?$', 1) as a from r) select o_orderkey, nullif(a, '') as arxiv from e""")
def b6_arxiv_key(t: Tables):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("https://arxiv.org/abs/2101."), F.lpad((F.col("o_custkey") % 10000).cast("string"), 5, "0"), F.lit("v"), (1 + F.col("o_orderkey") % 3).cast("string")))
    raw = raw.when(k == 1, F.concat(F.lit("arXiv:cs.LG/"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))).when(k == 2, "hep-th/9901001v2").otherwise("x")
    return t.orders.select("o_orderkey", text.arxiv_key(raw).alias("arxiv"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where try_cast(json_extract_string(props, '$.k') as bigint) >= 50""")
def c5_json_path(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t.events.where(k >= 50).select("event_id", k.alias("k"))


@query("""select regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') as host, count(*) as n,
bool_or(regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '(^|\\.)example\\.(com|org)$')) as trusted from pages group by 1""")
def b13_host_domain(t: Tables):
    host = text.url_host(F.col("url"))
    return t.pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(text.in_domain(host, ["example.com", "example.org"])).alias("trusted"))


@query("""with u as (select page_id, unnest(regexp_extract_all(url || ' see www.site' || page_id || '.org/a, and https://code.example.com/r' || (page_id % 7) || '.', '(?:https?://|www\\.)[^\\s<>"'')\\]]+')) as u from pages),
c as (select page_id, regexp_replace(u, '[.,;:!?]+$', '') as u from u) select page_id, case when starts_with(u, 'www.') then 'https://' || u else u end as url from c""")
def b14_extract_urls(t: Tables):
    said = F.concat(F.col("url"), F.lit(" see www.site"), F.col("page_id").cast("string"), F.lit(".org/a, and https://code.example.com/r"), (F.col("page_id") % 7).cast("string"), F.lit("."))
    return t.pages.select("page_id", F.explode(text.extract_urls(said)).alias("url"))


@query("""with w as (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from documents) select term, count(*) as n from w group by term order by n desc, term limit 200""")
def b33_tokens(t: Tables):
    return ops.top_counts(t.documents.select(F.explode(text.tokens(F.col("text"))).alias("term")), "term", 200)


@query("""with w as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}'), lambda x: x not in ('the','and','for','with','that','this','from','are','was','its','our','can','has','have','into','using','based','via','between','of','in','on','to','is','by','as','an','or','we'))) as term from documents) select term, count(*) as n, count(distinct doc_id) as docs from w group by term having count(*) >= 20""")
def b34_topic_tokens(t: Tables):
    words = t.documents.select("doc_id", F.explode(text.topic_tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 20")


@query("""with w as (select len(regexp_extract_all(text, '\\S+')) as n from documents) select case when n = 0 then 'empty' when n < 50 then 'very_short' when n < 150 then 'short' when n < 300 then 'medium' else 'long' end as length_class, count(*) as docs from w group by 1""")
def b38_length_class(t: Tables):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))
    return t.documents.groupBy(text.length_class(n).alias("length_class")).agg(F.count(F.lit(1)).alias("docs"))


@query("""with c as (select p_partkey, count(l_orderkey) as n from part left join lineitem on p_partkey = l_partkey group by 1) select case when n = 0 then '0' when n <= 5 then '1-5' when n <= 20 then '6-20' when n <= 100 then '21-100' else '100+' end as bucket, count(*) as parts from c group by 1""")
def b39_count_bucket(t: Tables):
    n = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_partkey").agg(F.count("l_orderkey").alias("n"))
    return n.groupBy(text.count_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("parts"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 4) as norm from embeddings""")
def b40_l2_norm(t: Tables):
    unit = scores.l2_normalize(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.sqrt(scores.dot(unit, unit)), 4).alias("norm"))


@query("""select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as lo, max(value) as hi from events group by 1""")
def b44_m19_latency_summary(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""with s as (select o_orderkey, least(greatest((year(o_orderdate) - (1998 - 5)) / 5.0, 0), 1) as rec, least(ln(1 + o_totalprice) / ln(1 + 500000), 1) as price, case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end as urgent from orders) select o_orderkey, round((0.5 * rec + 0.3 * price + 0.2 * urgent) / 1.0, 6) as score from s""")
def b28_b30_weighted_score(t: Tables):
    signals = {"recency": scores.recency(F.year("o_orderdate"), 1998, 5), "price": scores.log_score(F.col("o_totalprice"), 500000), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double")}
    return t.orders.select("o_orderkey", scores.weighted(signals, {"recency": 0.5, "price": 0.3, "urgent": 0.2}).alias("score"))


@query("""select doc_id, round((case when text <> '' then 1 else 0 end + case when lang is not null then 1 else 0 end + case when source <> '' then 1 else 0 end + case when n_chars > 1000 then 1 else 0 end) / 4.0, 4) as completeness from documents""")
def b26_completeness(t: Tables):
    return t.documents.select("doc_id", scores.completeness(F.col("text") != "", F.col("lang").isNotNull(), F.col("source") != "", F.col("n_chars") > 1000).alias("completeness"))


@query("""select l_orderkey, l_linenumber, round(least(greatest(0.65, case when l_returnflag = 'R' then 0.9 else l_discount * 10 end), 1), 4) as confidence from lineitem""")
def b18_confidence(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", scores.confidence(F.lit(0.65), F.when(F.col("l_returnflag") == "R", 0.9).otherwise(F.col("l_discount") * 10)).alias("confidence"))


@query("""select doc_id, contains(lower(text), 'the on') as withdrawn, contains(lower(text), ' and ') or contains(lower(text), ' und ') as review from documents""")
def b19_detectors(t: Tables):
    return t.documents.select("doc_id", text.detects(F.col("text"), "the on").alias("withdrawn"), text.detects(F.col("text"), " and ", " und ").alias("review"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then cast(o_orderdate as date) when 1 then cast(date_trunc('month', o_orderdate) as date) end as d from orders""")
def b21_b22_dates(t: Tables):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM")).otherwise("soon")
    return t.orders.select("o_orderkey", text.parse_datetime(raw, "yyyy-MM-dd", "yyyy/MM").cast("date").alias("d"))


@query("""select o_custkey, max(o_orderkey % 7) as best_version, arg_max(o_orderkey, struct_pack(a := o_orderkey % 7, b := o_orderkey)) as chosen, min(o_orderdate) as first_seen from orders group by 1""")
def b25_version_pick(t: Tables):
    v = F.col("o_orderkey") % 7
    return t.orders.groupBy("o_custkey").agg(F.max(v).alias("best_version"), F.max_by("o_orderkey", F.struct(v, "o_orderkey")).alias("chosen"), F.min("o_orderdate").alias("first_seen"))


@query("""select doc_id, md5(text) as text_md5 from documents""")
def b24_abstract_from_index(t: Tables):
    words = F.split("text", " ")
    placed = t.documents.select("doc_id", F.posexplode(words).alias("at", "word")).groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("at")).alias("at"))
    index = placed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", F.md5(text.abstract_of(F.col("index"))).alias("text_md5"))


@query("""select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as turns from (select conv_id, role, min(turn) as turn from conversations group by 1, 2) group by 1""")
def b41_e11_merge_unique(t: Tables):
    rows = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    merged = text.merge_unique(F.transform("x", lambda r: F.when(r["turn"] % 2 == 0, F.upper(r["role"])).otherwise(r["role"])))
    return rows.select("conv_id", F.lower(F.array_join(merged, ",")).alias("roles"), F.size(merged).cast("bigint").alias("turns"))


@query("""select doc_id, source, n_chars from documents where lower(lang) = lower('EN') and n_chars between 500 and 2000 and text ilike '%the a%'""")
def c1_c4_document_where(t: Tables):
    return ops.optional(t.documents, F.lower("lang") == "en", F.col("n_chars").between(500, 2000), F.col("text").ilike("%the a%"), None).select("doc_id", "source", "n_chars")


@query("""select p_partkey, p_brand from part p where p_size between 10 and 30 and exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)""")
def c2_d4_d5_artifact_where(t: Tables):
    parts = ops.optional(t.part, F.col("p_size").between(10, 30))
    hit = lambda cond: t.lineitem.where(cond).select(F.col("l_partkey").alias("p_partkey"))
    return parts.join(hit("l_returnflag = 'R'"), "p_partkey", "left_semi").join(hit("l_quantity > 49"), "p_partkey", "left_anti").select("p_partkey", "p_brand")


@query("""select count(*) filter (where coalesce(o_orderstatus = 'F', false)) as one_sided_true, count(*) as one_sided_false, count(*) filter (where not coalesce(o_orderstatus = 'F', false)) as tri_false from orders""")
def c7_c8_flag_filters(t: Tables):
    rows = t.orders.withColumn("has_f", F.col("o_orderstatus") == "F")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(ops.optional(rows, ops.one_sided("has_f", True)), "one_sided_true").join(n(ops.optional(rows, ops.one_sided("has_f", False)), "one_sided_false")).join(n(ops.optional(rows, ops.tri_state("has_f", False)), "tri_false"))


@query("""select event_id, event_type, value from events where value >= case event_type when 'purchase' then 20 when 'click' then 10 else 50 end""")
def c13_threshold_policy(t: Tables):
    rule = F.create_map(F.lit("purchase"), F.lit(20.0), F.lit("click"), F.lit(10.0))
    return t.events.where(F.col("value") >= F.coalesce(F.element_at(rule, F.col("event_type")), F.lit(50.0))).select("event_id", "event_type", "value")
