"""Further queries: links, policies, folds, sampling, comparisons, audits and the stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import links, scores, text
from corpusmill.operators import evaluation
from corpusmill.operators import retrieval as r
from corpusmill.operators import tables as ops
from corpusmill.plans.registry import Tables, query
from corpusmill.streaming import changes

_URLS = """u as (select p_partkey, case p_partkey % 6 when 0 then 'https://github.com/o' || (p_partkey % 50) || '/r' || p_partkey when 1 then 'https://www.huggingface.co/datasets/d' || p_partkey when 2 then 'https://huggingface.co/m/x' when 3 then 'https://zenodo.org/record/' || p_partkey when 4 then 'https://github.com/a/b.pdf' else 'https://other.net/x' end as url, p_retailprice / 2000 as confidence, case when p_size > 25 then 'code_url' else 'abstract' end as field from part)"""


def _urls(t: Tables):
    k, p = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://github.com/o"), (F.col("p_partkey") % 50).cast("string"), F.lit("/r"), p)).when(k == 1, F.concat(F.lit("https://www.huggingface.co/datasets/d"), p)).when(k == 2, "https://huggingface.co/m/x")
    url = url.when(k == 3, F.concat(F.lit("https://zenodo.org/record/"), p)).when(k == 4, "https://github.com/a/b.pdf").otherwise("https://other.net/x")
    return t.part.select("p_partkey", url.alias("url"), (F.col("p_retailprice") / 2000).alias("confidence"), F.when(F.col("p_size") > 25, "code_url").otherwise("abstract").alias("field"))


# URLs, and what the rules make of them.
_CASES = [
    ("https://github.com/owner/repo.git?tab=x", "github_repository", "https://github.com/owner/repo", "owner"),
    ("https://github.com/search/x", None, None, None),
    ("https://github.com/topics/x", None, None, None),
    ("https://www.huggingface.co/datasets/ns/data", "huggingface_dataset", "https://huggingface.co/datasets/ns/data", "ns"),
    ("https://huggingface.co/spaces/ns/demo/tree", "huggingface_space", "https://huggingface.co/spaces/ns/demo", "ns"),
    ("https://huggingface.co/ns/model", "huggingface_model", "https://huggingface.co/ns/model", "ns"),
    ("https://www.youtube.com/watch?v=abc&t=3", "youtube_video", "https://www.youtube.com/watch?v=abc", None),
    ("https://youtu.be/abc", "youtube_video", "https://www.youtube.com/watch?v=abc", None),
    ("https://www.kaggle.com/datasets/me/set", "kaggle_dataset", "https://kaggle.com/datasets/me/set", "me"),
    ("https://zenodo.org/record/77/files", "zenodo_artifact", "https://zenodo.org/records/77", None),
    ("https://x.figshare.com/articles/1/", "figshare_artifact", "https://x.figshare.com/articles/1", None),
    ("https://codeberg.org/a/b", "codeberg_repository", "https://codeberg.org/a/b", "a"),
    ("https://other.net/code/", "generic_code_url", "https://other.net/code", None),
    ("https://other.net/paper.PDF", None, None, None),
    ("https://dl.acm.org/doi/1", None, None, None),
]


def _sql_case(column: int) -> str:
    return f"case p_partkey % {len(_CASES)} " + " ".join(f"when {i} then " + ("null" if c[column] is None else f"'{c[column]}'") for i, c in enumerate(_CASES)) + " end"


@query(f"select p_partkey, {_sql_case(1)} as artifact_type, {_sql_case(2)} as normalized_url, {_sql_case(3)} as owner from part")
def b16_classify_url(t: Tables):
    url = F.element_at(F.array(*[F.lit(c[0]) for c in _CASES]), (F.col("p_partkey") % len(_CASES) + 1).cast("int"))
    c = t.part.withColumn("c", links.classify_url(url, F.when(url.contains("other.net") | url.contains("acm.org"), "code")))
    return c.select("p_partkey", "c.artifact_type", "c.normalized_url", "c.owner")


@query(f"""with {_URLS} select p_partkey, case field when 'code_url' then 'code' end as relation, (p_partkey % 6 in (0, 3) and confidence >= 0.65) or (p_partkey % 6 = 5 and confidence >= 0.9 and field = 'code_url' and p_partkey % 4 <> 0) as trusted from u""")
def b17_c9_trust(t: Tables):
    k = F.col("p_partkey") % 6
    kind = F.when(k.isin(0, 3), "repository").when(k == 5, "generic").otherwise("page")
    host = F.when(F.col("p_partkey") % 4 == 0, "doi.org").otherwise(text.url_host(F.col("url")))
    return _urls(t).select("p_partkey", text.relation_of(F.col("field")).alias("relation"), links.trusted(kind, F.col("confidence"), F.col("field"), host, ["repository"], ["code_url"], ["doi.org"]).alias("trusted"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'openalex' when 1 then 'arxiv' when 2 then 'doi' when 3 then 'raw' else 's2' end as reference_type from orders""")
def b12_reference_type(t: Tables):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "https://openalex.org/W12345678").when(k == 1, "2101.00001").when(k == 2, "https://doi.org/10.1000/x").when(k == 3, "Smith 1999").otherwise("7")
    return t.orders.select("o_orderkey", links.reference_type(raw, F.when(k == 4, "CorpusId")).alias("reference_type"))


@query("""select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_name end as c_name, c_mktsegment from customer""")
def c11_policy_projection(t: Tables):
    policy = {"c_name": F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_name"))}
    return t.customer.select(*[policy.get(c, F.col(c)).alias(c) for c in ("c_custkey", "c_name", "c_mktsegment")])


@query("""select doc_id from documents where list_has_any(string_split(source || ',' || lang, ','), ['src3', 'de'])""")
def c12_category_slice(t: Tables):
    return t.documents.where(F.arrays_overlap(F.split(F.concat_ws(",", "source", "lang"), ","), F.array(F.lit("src3"), F.lit("de")))).select("doc_id")


@query("""select event_id, case when event_type = 'view' and value - 10 >= 5 then 'click' else event_type end as final_type, event_type = 'view' and value - 10 >= 5 as changed from events""")
def c14_selective_override(t: Tables):
    changed = (F.col("event_type") == "view") & (F.col("value") - 10 >= 5)
    return t.events.select("event_id", F.when(changed, "click").otherwise(F.col("event_type")).alias("final_type"), changed.alias("changed"))


@query("""with m as (select s_suppkey, s_name, s_nationkey from supplier where s_suppkey % 3 = 0), n as (select lower(s_name) as k, min(s_suppkey) as by_name from supplier where s_suppkey % 2 = 0 group by 1) select s.s_suppkey, coalesce(m.s_nationkey, n.by_name, -1) as meta from supplier s left join m on m.s_suppkey = s.s_suppkey left join n on n.k = lower(s.s_name)""")
def d8_metadata_fallback(t: Tables):
    by_id = t.supplier.where("s_suppkey % 3 = 0").select("s_suppkey", F.col("s_nationkey").alias("m"))
    by_name = t.supplier.where("s_suppkey % 2 = 0").groupBy(F.lower("s_name").alias("k")).agg(F.min("s_suppkey").alias("by_name"))
    return t.supplier.join(by_id, "s_suppkey", "left").join(by_name, F.lower("s_name") == F.col("k"), "left").select("s_suppkey", F.coalesce("m", "by_name", F.lit(-1)).alias("meta"))


@query("""with k as (select distinct 'a::' || o_custkey as key from orders where o_orderkey % 3 = 0 union select distinct 'b::' || o_orderpriority from orders where o_orderkey % 3 = 0) select o_orderkey from orders where o_orderkey % 3 = 1 and 'a::' || o_custkey in (select key from k)""")
def d20_key_coverage(t: Tables):
    keys = F.array(F.concat(F.lit("a::"), F.col("o_custkey").cast("string")), F.concat(F.lit("b::"), F.col("o_orderpriority")))
    snapshot = t.orders.where("o_orderkey % 3 = 0").select(F.explode(keys).alias("key")).distinct()
    rows = t.orders.where("o_orderkey % 3 = 1").select("o_orderkey", F.explode(keys).alias("key")).where("key like 'a::%'")
    return rows.join(snapshot, "key", "left_semi").select("o_orderkey").distinct()


@query("""select user_id, event_type, arg_min(value, event_id) as first_value from events group by 1, 2""")
def e12_map_first_wins(t: Tables):
    first = t.events.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("v"))
    merged = first.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return merged.select("user_id", F.explode("m").alias("event_type", "first_value"))


@query("""select p_name, min(p_partkey) as artifact_id, arg_min(p_brand, p_partkey) filter (where p_size > 20) as brand from part group by 1""")
def e14_entity_fill(t: Tables):
    return t.part.groupBy("p_name").agg(F.min("p_partkey").alias("artifact_id"), F.min_by(F.when(F.col("p_size") > 20, F.col("p_brand")), F.when(F.col("p_size") > 20, F.col("p_partkey"))).alias("brand"))


@query("""select l_orderkey, count(distinct l_partkey) as artifacts, count(distinct case when l_returnflag = 'A' then l_partkey end) as a, count(distinct case when l_returnflag = 'N' then l_partkey end) as n, mode_flag from lineitem join (select l_orderkey as k, l_returnflag as mode_flag from (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by count(*) desc, l_returnflag) as r from lineitem group by 1, 2) where r = 1) on k = l_orderkey group by l_orderkey, mode_flag""")
def e18_e19_artifact_aggregate(t: Tables):
    counts = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    mode = counts.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(-F.col("c"), "l_returnflag")).alias("mode_flag"))
    flag = lambda f: F.countDistinct(F.when(F.col("l_returnflag") == f, F.col("l_partkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("artifacts"), flag("A").alias("a"), flag("N").alias("n")).join(mode, "l_orderkey")


@query("""with s as (select md5(text) as k, count(distinct source) as n from documents group by 1) select n as sources, count(*) as papers from s group by 1""")
def e23_source_distribution(t: Tables):
    return t.documents.groupBy(F.md5("text")).agg(F.countDistinct("source").alias("sources")).groupBy("sources").agg(F.count(F.lit(1)).alias("papers"))


@query("""select p_size, count(*) as n, min(p_retailprice) as lo, round(avg(p_retailprice), 4) as mean, max(p_retailprice) as hi from part group by 1""")
def e25_numeric_distribution(t: Tables):
    return t.part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.max("p_retailprice").alias("hi"))


@query("""select c_custkey, round(0.6::double * (case when c_name is not null then 0.5 else 0 end + case when c_acctbal > 0 then 0.3 else 0 end + case when c_mktsegment = 'BUILDING' then 0.2 else 0 end), 6) as metadata from customer""")
def f4_metadata_quality(t: Tables):
    have = {"c_name": (F.col("c_name").isNotNull(), 0.5), "bal": (F.col("c_acctbal") > 0, 0.3), "seg": (F.col("c_mktsegment") == "BUILDING", 0.2)}
    total = sum((F.when(c, w).otherwise(0.0) for c, w in have.values()), F.lit(0.0))
    return t.customer.select("c_custkey", F.round(0.6 * total, 6).alias("metadata"))


@query("""select event_id, round(0.75 * value + 0.1 * least((user_id % 6) / 4.0, 1) + 0.1 * case when event_type = 'view' then 1 else 0 end, 6) as score from events order by score desc, event_id limit 40""")
def f6_db_rerank(t: Tables):
    score = F.round(0.75 * F.col("value") + 0.1 * F.least(F.col("user_id") % 6 / 4.0, F.lit(1.0)) + 0.1 * F.when(F.col("event_type") == "view", 1).otherwise(0), 6)
    return ops.page(t.events.select("event_id", score.alias("score")), [F.desc("score"), F.asc("event_id")], 40)


@query("""select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by vec_id % 17, vec_id) as rank from embeddings) where rank <= 3""")
def f8_representatives(t: Tables):
    return ops.argmax_n(t.embeddings.select("label", "vec_id"), ["label"], [F.asc(F.col("vec_id") % 17), F.asc("vec_id")], 3)


@query("""select o_orderkey from orders order by year(o_orderdate) desc nulls last, o_totalprice desc, o_orderkey desc limit 25""")
def g5_g7_ranking_sort(t: Tables):
    return ops.page(t.orders.withColumn("y", F.year("o_orderdate")), [F.desc_nulls_last("y"), F.desc("o_totalprice"), F.desc("o_orderkey")], 25).select("o_orderkey")


@query("""with k as (select p_brand, list_distinct(list(lower(p_type))) as t from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3') group by 1) select unnest(list_sort(list_intersect(list_intersect((select t from k where p_brand = 'Brand#1'), (select t from k where p_brand = 'Brand#2')), (select t from k where p_brand = 'Brand#3')))) as shared""")
def h9_shared_by_all(t: Tables):
    rows = t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("p_brand", F.lower("p_type").alias("shared")).distinct()
    return rows.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("shared")


@query("""with a as (select lang as f, avg(n_chars) as x from documents where doc_id % 2 = 0 group by 1), b as (select lang as f, avg(n_chars) as x from documents where doc_id % 2 = 1 group by 1) select coalesce(a.f, b.f) as field, round(b.x - a.x, 4) as delta, case when b.x > a.x then 'improved' when b.x < a.x then 'regressed' else 'unchanged' end as verdict from a full join b on a.f = b.f""")
def h10_audit_comparison(t: Tables):
    half = lambda i, name: t.documents.where(F.col("doc_id") % 2 == i).groupBy(F.col("lang").alias("field")).agg(F.avg("n_chars").alias(name))
    j = half(0, "a").join(half(1, "b"), "field", "full_outer")
    return j.select("field", F.round(F.col("b") - F.col("a"), 4).alias("delta"), F.when(F.col("b") > F.col("a"), "improved").when(F.col("b") < F.col("a"), "regressed").otherwise("unchanged").alias("verdict"))


@query("""with s as (select source, count(*) as n, avg(case when n_chars > 800 then 1.0 else 0 end) as cov from documents group by 1), w as (select sum(n * cov) / sum(n) as weighted from s), c as (select avg(case when n_chars > 800 then 1.0 else 0 end) as canonical from (select max(n_chars) as n_chars from documents group by md5(text))) select round(weighted, 6) as weighted, round(canonical, 6) as canonical, round(canonical / weighted, 6) as retention from w, c""")
def h11_source_vs_canonical(t: Tables):
    long = F.avg(F.when(F.col("n_chars") > 800, 1.0).otherwise(0.0))
    s = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), long.alias("cov")).agg((F.sum(F.col("n") * F.col("cov")) / F.sum("n")).alias("w"))
    c = t.documents.groupBy(F.md5("text")).agg(F.max("n_chars").alias("n_chars")).agg(long.alias("c"))
    return s.join(c).select(F.round("w", 6).alias("weighted"), F.round("c", 6).alias("canonical"), F.when(F.col("w") > 0, F.round(F.col("c") / F.col("w"), 6)).alias("retention"))


@query("""with c as (select o_orderkey, o_custkey, o_custkey % 4 = 0 as exact, o_custkey % 3 = 0 as soft, o_custkey % 5 = 0 as acl from orders) select o_orderkey, case when exact and acl then 'merge' when exact or soft then 'exclude_soft' when acl then 'add' else 'exclude' end as disposition from c""")
def h12_filtered_candidate(t: Tables):
    hit = lambda n: F.col("o_custkey") % n == 0
    return t.orders.select("o_orderkey", F.when(hit(4) & hit(5), "merge").when(hit(4) | hit(3), "exclude_soft").when(hit(5), "add").otherwise("exclude").alias("disposition"))


@query("""select o_custkey, o_orderkey, bucket from (select *, row_number() over (partition by o_custkey order by case bucket when 'updated' then 0 else 1 end, o_orderkey) as n from (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then 'updated' else 'new' end as bucket from orders)) where n = 1""")
def h13_candidate_dedup(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "updated").otherwise("new").alias("bucket"))
    return ops.argmax(rows, ["o_custkey"], [F.asc((F.col("bucket") != "updated").cast("int")), F.asc("o_orderkey")])


@query("""select user_id % 20 as key, count(*) as n, 1 as fresh from events group by 1""")
def j2_j5_change_stream(t: Tables):
    """The events' digests as a stream, taken batch by batch: how often each key came, and how often as new."""
    base = t._spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t._spark.sparkContext.master.startswith("local") or "cluster" in t._spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    at = f"{base}/stream-{uuid.uuid4().hex}"
    t.events.select((F.col("user_id") % 20).alias("key"), F.md5(F.col("event_type")).alias("digest")).write.parquet(f"{at}/in")
    changes.run_once(changes.changes(changes.read_files(t._spark, f"{at}/in", "key long, digest string", 100)), f"{at}/out", f"{at}/checkpoint")
    return t._spark.read.schema("key long, digest string, change string").parquet(f"{at}/out").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") == "new").cast("int").alias("fresh"))


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2""")
def j_windowed_counts(t: Tables):
    """Tumbling windows, an extension: the same plan as the stream's."""
    return changes.windowed_counts(t.events, "ts", "1 hour", "1 day", "event_type")


@query("""with e as (select distinct l_orderkey, l_partkey from lineitem), p as (select 'paper' as node_type, 'paper:' || l_orderkey as node_id from e union select 'artifact', 'artifact:' || l_partkey from e union select 'provider', 'provider:' || p_brand from e join part on p_partkey = l_partkey) select node_type, count(*) as nodes from p group by 1""")
def l3_artifact_graph_nodes(t: Tables):
    e = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    node = lambda kind, df, c: df.select(F.lit(kind).alias("node_type"), F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("node_id"))
    providers = e.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return node("paper", e, "l_orderkey").unionByName(node("artifact", e, "l_partkey")).unionByName(node("provider", providers, "p_brand")).distinct().groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"))


@query("""select p_partkey, count(distinct l_orderkey) as papers from part join lineitem on l_partkey = p_partkey where p_name = 'small ring' or p_partkey = 7 group by 1""")
def l6_citing_external(t: Tables):
    ref = t.part.where((F.col("p_name") == "small ring") | (F.col("p_partkey") == 7)).select("p_partkey")
    return t.lineitem.join(ops.small(ref), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.countDistinct("l_orderkey").alias("papers"))


@query("""with s as (select l_orderkey, l_partkey from lineitem where l_orderkey in (1, 2, 3, 4)) select a.l_orderkey as a, b.l_orderkey as b, count(*) as shared from s a join s b on a.l_partkey = b.l_partkey and a.l_orderkey < b.l_orderkey group by 1, 2 union all select l_orderkey, l_orderkey, count(*) from s group by 1""")
def l10_selected_evidence(t: Tables):
    s = t.lineitem.where("l_orderkey in (1, 2, 3, 4)").select("l_orderkey", "l_partkey")
    pair = s.alias("x").join(s.alias("y"), (F.col("x.l_partkey") == F.col("y.l_partkey")) & (F.col("x.l_orderkey") < F.col("y.l_orderkey"))).groupBy(F.col("x.l_orderkey").alias("a"), F.col("y.l_orderkey").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return pair.unionByName(s.groupBy(F.col("l_orderkey").alias("a")).agg(F.count(F.lit(1)).alias("shared")).select("a", F.col("a").alias("b"), "shared"))


@query("""with q as (select user_id as query_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank, case event_type when 'purchase' then 2 when 'click' then 1 else 0 end as grade from events), k as (select * from q where rank <= 10), t as (select query_id, count(*) filter (where grade > 0) as relevant from q group by 1)
select k.query_id, round(count(*) filter (where grade > 0) / cast(count(*) as double), 6) as precision, round(least(count(*) filter (where grade > 0) / cast(greatest(relevant, 1) as double), 1), 6) as recall, bool_or(grade > 0) as hit from k join t using (query_id) group by k.query_id, relevant""")
def m6_golden_metrics(t: Tables):
    grade = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    q = t.events.select(F.col("user_id").alias("query_id"), "event_id", "value", grade.alias("grade"))
    k = ops.argmax_n(q, ["query_id"], [F.desc("value"), F.asc("event_id")], 10)
    total = q.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    got = k.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("hits"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("grade") > 0).alias("hit")).join(total, "query_id")
    return got.select("query_id", F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(F.least(F.col("hits") / F.greatest("relevant", F.lit(1)), F.lit(1.0)), 6).alias("recall"), "hit")


@query("""with r as (select 1 as run, user_id, event_id, value as score, value as o, event_id as tie from events union all select 2, user_id, event_id, value, value, -event_id from events union all select 3, user_id, event_id, value, value + (event_id % 2) / 1000.0, event_id from events),
k as (select *, row_number() over (partition by run, user_id order by o desc, tie) as rank from r), l as (select run, user_id, string_agg(event_id::varchar, ',' order by rank) as ids from k where rank <= 10 group by 1, 2), s as (select user_id, max(d) as d from (select user_id, event_id, max(o) - min(o) as d from k where rank <= 10 group by 1, 2) group by 1)
select user_id as query_id, count(*) as runs, count(distinct ids) = 1 as deterministic, round(max(d), 6) as spread from l join s using (user_id) group by 1""")
def m17_determinism(t: Tables):
    """Three independent runs: one breaks ties otherwise, one scores otherwise."""
    def run(name: int, score, tie):
        rows = t.events.select(F.lit(name).alias("run"), F.col("user_id").alias("query_id"), F.col("event_id").alias("key"), score.alias("score"))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie)))

    runs = [run(1, F.col("value"), F.asc("key")), run(2, F.col("value"), F.desc("key")), run(3, F.col("value") + F.col("event_id") % 2 / 1000.0, F.asc("key"))]
    return evaluation.determinism(runs[0].unionByName(runs[1]).unionByName(runs[2]), 10)


@query("""select reason, count(*) as n from (select unnest(list_filter([case when s_acctbal < 0 then 'negative' end, case when s_nationkey % 5 = 0 then 'nation' end], lambda x: x is not null)) as reason from supplier) group by 1""")
def m18_mapping_audit(t: Tables):
    reasons = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, "negative"), F.when(F.col("s_nationkey") % 5 == 0, "nation")))
    return t.supplier.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select user_id, event_type, round(max(value), 6) as score, row_number() over (partition by user_id order by max(value) desc, event_type) as n from events group by 1, 2) select a.user_id, a.event_type as best, a.score, round(a.score - coalesce(b.score, 0), 6) as margin from s a left join s b on b.user_id = a.user_id and b.n = 2 where a.n = 1""")
def n9_semantic_typing(t: Tables):
    best = t.events.groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    rows = best.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("n = 1")
    return rows.select("user_id", F.col("event_type").alias("best"), "score", F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 6).alias("margin"))


@query("""select event_type, count(*) as n, round(quantile_cont(value, 0.25), 6) as p25, round(median(value), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75 from events group by 1""")
def n13_confidence_summary(t: Tables):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select("event_type", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p25", "p50", "p75"))])


@query("""with p as (select l.quality as ref, case when n_chars > 800 then 1 else 0 end as pred from labels l join documents using (doc_id)) select ref, pred, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share, round(count(*) / cast(sum(count(*)) over (partition by ref) as double), 6) as of_ref from p group by 1, 2""")
def n14_n15_confusions(t: Tables):
    p = t.labels.join(t.documents, "doc_id").groupBy(F.col("quality").alias("ref"), (F.col("n_chars") > 800).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda w: F.round(F.col("n") / F.sum("n").over(w), 6)
    return p.withColumn("share", share(Window.partitionBy())).withColumn("of_ref", share(Window.partitionBy("ref")))


@query("""with o as (select avg(value) as mean, max(value) as top, count(*) as n from events) select 'mean' as name, mean >= 5 as passed from o union all select 'top', top <= 1000 from o union all select 'rows', n > 100 from o""")
def n17_q11_acceptance(t: Tables):
    o = t.events.agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    gates = {"mean": F.col("mean") >= 5, "top": F.col("top") <= 1000, "rows": F.col("n") > 100}
    return o.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("passed")) for k, v in gates.items()])).alias("x")).select("x.*")


@query("""with d as (select o_custkey, count(*) as n, count(distinct o_orderpriority) as p from orders group by 1) select case when n <> p then 'warning' else 'ok' end as tier, count(*) as rows from d group by 1""")
def q2_provenance_tiers(t: Tables):
    d = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("p"))
    return d.groupBy(F.when(F.col("n") != F.col("p"), "warning").otherwise("ok").alias("tier")).agg(F.count(F.lit(1)).alias("rows"))


@query("""with a as (select l_returnflag as k, count(distinct l_orderkey) as n, count(*) as p from lineitem group by 1), b as (select l_returnflag as k, count(distinct l_orderkey) as n, count(*) as p from lineitem where l_linenumber < 7 group by 1) select coalesce(a.k, b.k) as k, a.n = b.n as same_ids, a.p = b.p as same_pairs, coalesce(a.p, 0) - coalesce(b.p, 0) as missing from a full join b on a.k = b.k""")
def q8_materialization_parity(t: Tables):
    """A table against what a store has of it, by source: distinct ids, pairs, and how many pairs are missing."""
    return ops.parity(t.lineitem, t.lineitem.where("l_linenumber < 7"), "l_returnflag", "l_orderkey")


@query("""select c_custkey, coalesce(n, 0) as items from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey where c_nationkey = 3""")
def r11_collection_counts(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.where("c_nationkey = 3").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("items"))


@query("""with s as (select q.vec_id as query_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(v.embedding[i] as double) * cast(q.embedding[i] as double))), 6) as score from embeddings v, embeddings q where q.vec_id % 100 = 0) select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def k11_similar_by_text(t: Tables):
    """Including the query itself."""
    v = t.embeddings.select("vec_id", "embedding")
    return r.exact_knn(v, "vec_id", "embedding", v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, include_self=True).drop("final")


@query("""select source, doc_id, h as selection_hash, n as rank from (select source, doc_id, sha256('map|' || doc_id) as h, row_number() over (partition by source order by sha256('map|' || doc_id)) as n from documents) where n <= 2""")
def k20_stratified_sample(t: Tables):
    return ops.hash_sample(t.documents.select("source", "doc_id"), "source", "doc_id", "map", 2)


@query("""select doc_id, round(case when quality is null then 0 else 0.85 * (quality + 1) / 2.0 + 0.10 * least(n_chars / 10000.0, 1) end, 6) as adjusted from documents left join labels using (doc_id)""")
def b32_adjusted(t: Tables):
    s = F.when(F.col("quality").isNull(), 0.0).otherwise(0.85 * (F.col("quality") + 1) / 2.0 + 0.10 * scores.clamp01(F.col("n_chars") / 10000.0))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.round(s, 6).alias("adjusted"))
