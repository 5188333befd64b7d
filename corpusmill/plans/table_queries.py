"""Queries for joins, folds, deduplication, change detection, ranking, sorting and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators import tables as ops
from corpusmill.plans.registry import Tables, query


@query("""with s as (select l_orderkey, count(distinct l_partkey) as artifacts, count(distinct case when l_returnflag = 'R' then l_partkey end) as code, sum(l_quantity) as qty from lineitem group by 1),
f as (select o_orderkey, coalesce(artifacts, 0) as artifacts, coalesce(code, 0) as code, coalesce(qty, 0) as qty, year(o_orderdate) as y from orders left join s on l_orderkey = o_orderkey),
w as (select *, round((0.5 * least(ln(1 + artifacts) / ln(11), 1) + 0.3 * least(ln(1 + code) / ln(6), 1) + 0.2 * least(ln(1 + qty) / ln(301), 1)) / 1.0, 6) as score from f)
select o_orderkey, artifacts, code, score, round((score - min(score) over ()) / (max(score) over () - min(score) over ()), 6) as relevance from w order by score desc, o_orderkey desc limit 100""")
def feature_ranking(t: Tables):
    """Per-order artifact counts, weighted score and top 100 with min-max relevance: the flagship."""
    pairs = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("code"), F.sum("l_quantity").alias("qty"))
    agg = pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("code").alias("code"), F.sum("qty").alias("qty"))
    rows = t.orders.join(agg, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("artifacts", "code", "qty")])
    signals = {"a": scores.log_score(F.col("artifacts"), 10), "c": scores.log_score(F.col("code"), 5), "q": scores.log_score(F.col("qty"), 300)}
    rows = rows.withColumn("score", scores.weighted(signals, {"a": 0.5, "c": 0.3, "q": 0.2})).select("o_orderkey", "artifacts", "code", "score")
    best = F.struct((-F.col("score")).alias("s"), (-F.col("o_orderkey")).alias("k"), "o_orderkey", "artifacts", "code", "score")
    bucket = F.pmod(F.xxhash64("o_orderkey"), F.lit(64))  # the best of each of some parts, with the part's span: one pass gives both
    part = rows.withColumn("n", F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc("score"), F.desc("o_orderkey")))).withColumn("b", bucket).groupBy("b").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.collect_list(F.when(F.col("n") <= 100, best)).alias("x"))
    one = part.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, 100).alias("x"))  # 64 * 100 rows
    return one.select("lo", "hi", F.inline("x")).select("o_orderkey", "artifacts", "code", "score", F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("relevance"))


@query("""select o_orderkey, o_totalprice, p_name from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where p_brand = 'Brand#2' and l_discount >= 0.05 order by o_totalprice desc, o_orderkey, p_name limit 50 offset 10""")
def d1_d2_link_joins(t: Tables):
    part = ops.small(t.part.where("p_brand = 'Brand#2'").select("p_partkey", "p_name"))
    rows = t.lineitem.where("l_discount >= 0.05").join(part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return ops.page(rows.select("o_orderkey", "o_totalprice", "p_name"), [F.desc("o_totalprice"), F.asc("o_orderkey"), F.asc("p_name")], 50, 10)


@query("""select p_partkey, coalesce(papers, 0) as papers, coalesce(flags, '') as flags, best from part left join (select l_partkey, count(distinct l_orderkey) as papers, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags, max(l_quantity) as best from lineitem group by 1) on l_partkey = p_partkey""")
def d3_e17_grouped_stats(t: Tables):
    stats = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("papers"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.max("l_quantity").alias("best"))
    return t.part.join(stats, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("flags", F.lit("")).alias("flags"), "best")


@query("""select doc_id from documents where source in (select source from documents group by 1 having count(*) > 49 and min(doc_id) < 10)""")
def d6_in_subquery(t: Tables):
    wanted = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 49 and first < 10")
    return t.documents.join(wanted, "source", "left_semi").select("doc_id")


@query("""with u as (select c_nationkey, c_mktsegment, min(c_custkey) as target from customer group by 1, 2 having count(distinct c_custkey) = 1) select c.c_custkey, u.target from customer c join u using (c_nationkey, c_mktsegment)""")
def d10_unique_key(t: Tables):
    unique = ops.unique_key(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey").withColumnRenamed("c_custkey", "target")
    return t.customer.join(ops.small(unique), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "target")


@query("""select count(*) as shared from (select distinct c_nationkey from customer intersect select distinct s_nationkey from supplier)""")
def d11_key_overlap(t: Tables):
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")).agg(F.count(F.lit(1)).alias("shared"))


@query("""with a as (select conv_id as g, turn * 7 as lo, turn * 7 + 10 as hi from conversations where role = 'user'), b as (select conv_id as g, turn * 5 as lo, turn * 5 + 8 as hi from conversations where role = 'assistant')
select a.g, a.lo as a_lo, a.hi as a_hi, b.lo as b_lo, b.hi as b_hi, least(a.hi, b.hi) - greatest(a.lo, b.lo) as intersection, round((least(a.hi, b.hi) - greatest(a.lo, b.lo)) / cast(greatest(a.hi, b.hi) - least(a.lo, b.lo) as double), 6) as iou from a join b on a.g = b.g and a.lo < b.hi and b.lo < a.hi""")
def d13_span_overlap(t: Tables):
    return _spans(t)


def _spans(t: Tables):
    span = lambda role, k, n: t.conversations.where(F.col("role") == role).select(F.col("conv_id").alias("g"), (F.col("turn") * k).alias("lo"), (F.col("turn") * k + n).alias("hi"))
    return ops.overlapping(span("user", 7, 10), span("assistant", 5, 8), ["g"])


@query(None)
def d14_greedy_pairs(t: Tables):
    rows = _spans(t).withColumn("rank_key", -F.col("iou"))
    return ops.greedy_pairs(rows, ["g"], "a_lo", "b_lo", ["rank_key", "a_lo", "b_lo"]).drop("rank_key")


@query("""select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey""")
def d16_pairs(t: Tables):
    a = t.nation.select(F.col("n_nationkey").alias("a"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("""select s_nationkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as papers from supplier join lineitem on l_suppkey = s_suppkey group by 1""")
def d18_two_hop(t: Tables):
    return t.lineitem.join(ops.small(t.supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("papers"))


@query("""select 'order' as side, count(*) as missing from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'part', count(*) from lineitem where l_partkey not in (select p_partkey from part)""")
def d19_q3_referential(t: Tables):
    gone = lambda side, other, a, b: t.lineitem.join(other, F.col(a) == F.col(b), "left_anti").agg(F.count(F.lit(1)).alias("missing")).select(F.lit(side).alias("side"), "missing")
    return gone("order", t.orders, "l_orderkey", "o_orderkey").unionByName(gone("part", t.part, "l_partkey", "p_partkey"))


@query("""select doc_id, source, n_chars from (select *, row_number() over (partition by md5(text) order by n_chars desc, doc_id) as n from documents) where n = 1""")
def e1_dedup_argmax(t: Tables):
    return ops.argmax(t.documents.withColumn("k", F.md5("text")), ["k"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", "n_chars")


@query("""select o_custkey, (arg_max(o_orderpriority, struct_pack(p := case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end, l := length(o_orderpriority), v := o_orderpriority))) as preferred, arg_min(o_orderstatus, o_orderkey) as first_status, min(o_orderdate) as published, max(o_orderdate) as updated, max(o_totalprice) as top,
case when bool_or(o_totalprice > 400000) then true when count(*) > 0 then false end as any_large, count(*) as sources, count(distinct o_orderstatus) as unique_sources from orders group by 1""")
def e3_e9_canonical_merge(t: Tables):
    priority = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return t.orders.groupBy("o_custkey").agg(
        F.max(F.struct(priority.alias("p"), F.length("o_orderpriority").alias("l"), F.col("o_orderpriority").alias("v")))["v"].alias("preferred"),
        F.min_by("o_orderstatus", "o_orderkey").alias("first_status"),
        F.min("o_orderdate").alias("published"),
        F.max("o_orderdate").alias("updated"),
        F.max("o_totalprice").alias("top"),
        F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"),
        F.count(F.lit(1)).alias("sources"),
        F.countDistinct("o_orderstatus").alias("unique_sources"),
    )


@query("""select source, arg_max(doc_id, struct_pack(n := n_chars, d := -doc_id)) as longest, max(n_chars) as n from documents group by 1""")
def e5_longest_text(t: Tables):
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"), F.max("n_chars").alias("n"))


@query("""select l_orderkey, l_returnflag, count(*) as evidence, arg_max(l_linenumber, struct_pack(q := l_quantity, n := -l_linenumber)) as representative, max(l_quantity) as confidence, md5(concat_ws(chr(10), l_orderkey, l_returnflag)) as link_id from lineitem where l_quantity >= 10 group by 1, 2""")
def e13_trusted_links(t: Tables):
    rows = t.lineitem.where("l_quantity >= 10").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("evidence"), F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("representative"), F.max("l_quantity").alias("confidence"))
    return rows.withColumn("link_id", text.joined_md5(F.col("l_orderkey"), F.col("l_returnflag")))


@query("""with b as (select *, first_value(p_partkey) over (partition by p_name order by p_retailprice desc, p_partkey) as keep from part) select l_orderkey, l_linenumber, keep from lineitem join b on l_partkey = p_partkey where keep <> p_partkey and l_quantity = 50""")
def e16_collision_remap(t: Tables):
    keep = F.first("p_partkey").over(Window.partitionBy("p_name").orderBy(F.desc("p_retailprice"), "p_partkey"))
    moved = t.part.select("p_partkey", keep.alias("keep")).where("keep <> p_partkey")
    return t.lineitem.where("l_quantity = 50").join(moved, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "keep")


@query("""select count(*) as n, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean, count(*) filter (where value > 0) as nonzero from events""")
def e20_score_summary(t: Tables):
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 0).alias("nonzero"))


@query("""select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 3""")
def e21_top_counts(t: Tables):
    return ops.top_counts(t.events, "event_type", 3)


@query("""select * from (select 'lang' as field, count(*) filter (where lang <> '') as present, round(count(*) filter (where lang <> '') / cast(count(*) as double), 6) as coverage from documents union all select 'source', count(*) filter (where source <> ''), round(count(*) filter (where source <> '') / cast(count(*) as double), 6) from documents union all select 'n_chars', count(n_chars), round(count(n_chars) / cast(count(*) as double), 6) from documents)""")
def e22_q9_coverage(t: Tables):
    return ops.coverage(t.documents, ["lang", "source", "n_chars"])


@query("""select * from (select 'positive_length' as rule, count(*) filter (where not coalesce(n_chars > 100, false)) as violations from documents union all select 'known_lang', count(*) filter (where not coalesce(lang in ('en', 'de'), false)) from documents)""")
def e24_q1_checks(t: Tables):
    return ops.checks(t.documents, {"positive_length": F.col("n_chars") > 100, "known_lang": F.col("lang").isin("en", "de")})


@query("""with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}'), lambda x: x not in ('the','and','for','with','that','this','from','are','was','its','our','can','has','have','into','using','based','via','between','of','in','on','to','is','by','as','an','or','we')) as w from documents),
g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w) select gram, count(*) as n from g group by 1 order by n desc, gram limit 100""")
def e26_bigrams(t: Tables):
    grams = t.documents.select(F.explode(text.ngrams(text.topic_tokens(F.col("text")), 2)).alias("gram"))
    return ops.top_counts(grams, "gram", 100)


@query("""select count(*) as keys from (select user_id from events group by 1 having count(distinct event_type) > 4)""")
def e30_having_distinct(t: Tables):
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n > 4").agg(F.count(F.lit(1)).alias("keys"))


@query("""with m as (select *, min(value) over w as lo, max(value) over w as hi from events window w as (partition by event_type)) select event_id, round(case when hi - lo < 1e-12 then 1.0 else (value - lo) / (hi - lo) end, 6) as score from m""")
def f1_minmax(t: Tables):
    return t.events.select("event_id", F.round(scores.minmax(F.col("value"), scores.by_set("event_type")), 6).alias("score"))


@query("""with c as (select c_custkey, c_nationkey, c_acctbal, c_custkey % 9 as n, 1990 + c_custkey % 12 as y from customer), w as (select *, min(c_acctbal) over p as lo, max(c_acctbal) over p as hi, min(y) over p as y0, max(y) over p as y1, max(n) over p as m from c window p as (partition by c_nationkey)),
s as (select c_custkey, c_nationkey, round(0.6 * (c_acctbal - lo) / (hi - lo) + 0.2 * (y - y0) / (y1 - y0) + 0.1 * case when n <= 0 then 0.0 else (n - 1) / cast(m - 1 as double) end + 0.1, 6) as score from w) select *, row_number() over (partition by c_nationkey order by score desc, c_custkey) as rank from s""")
def f2_f5_rerank(t: Tables):
    w = scores.by_set("c_nationkey")
    n, year = F.col("c_custkey") % 9, 1990 + F.col("c_custkey") % 12
    score = F.round(0.6 * scores.minmax(F.col("c_acctbal"), w) + 0.2 * scores.result_recency(year, w) + 0.1 * scores.source_support(n, w) + 0.1, 6)
    return t.customer.select("c_custkey", "c_nationkey", score.alias("score")).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "c_custkey")))


@query("""with a as (select user_id, row_number() over (order by sum(value) desc, user_id) as r from events where event_type = 'purchase' group by 1), b as (select user_id, row_number() over (order by count(*) desc, user_id) as r from events group by 1) select a.user_id, a.r as rank_a, b.r as rank_b, a.r - b.r as delta from a join b using (user_id) where a.r <= 50 and b.r <= 50""")
def f9_rank_delta(t: Tables):
    def top(df, order):
        return df.orderBy(*order).limit(50).withColumn("r", F.row_number().over(Window.orderBy(*order)))

    a = top(t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum("value").alias("v")), [F.desc("v"), F.asc("user_id")])
    b = top(t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("v")), [F.desc("v"), F.asc("user_id")])
    return a.select("user_id", F.col("r").alias("rank_a")).join(b.select("user_id", F.col("r").alias("rank_b")), "user_id").withColumn("delta", F.col("rank_a") - F.col("rank_b"))


@query("""select source, doc_id, h as selection_hash, n as rank from (select source, doc_id, sha256('seed|' || doc_id) as h, row_number() over (partition by source order by sha256('seed|' || doc_id)) as n from documents) where n <= 5""")
def f10_n12_hash_sample(t: Tables):
    return ops.hash_sample(t.documents.select("source", "doc_id"), "source", "doc_id", "seed", 5)


@query("""with y as (select year(o_orderdate) as y, o_orderkey from orders), q as (select y, row_number() over (order by y) as i, count(*) over () as all_years from (select distinct y from y)), r as (select y, o_orderkey, row_number() over (partition by y order by o_orderkey desc) as n from y)
select y, o_orderkey from r join q using (y) where n <= 100 // all_years + case when i <= 100 % all_years then 1 else 0 end""")
def f11_year_quota(t: Tables):
    return ops.year_quota(t.orders.select(F.year("o_orderdate").alias("y"), "o_orderkey"), "y", [F.desc("o_orderkey")], 100)


@query("""with w as (select doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from documents), s as (select doc_id, w, unnest(range(0, len(w), 96)) as pos from w) select doc_id, pos as "at", least(128, len(w) - pos) as n, md5(array_to_string(w[pos + 1 : pos + 128], ' ')) as window_md5 from s""")
def f12_token_windows(t: Tables):
    w = F.split(text.normalize_text(F.col("text")), " ")
    rows = t.documents.select("doc_id", w.alias("w")).select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.size("w").cast("bigint") - 1, F.lit(96).cast("bigint"))).alias("at"))
    return rows.select("doc_id", "at", F.least(F.lit(128), F.size("w") - F.col("at")).cast("bigint").alias("n"), F.md5(F.array_join(F.slice("w", F.col("at").cast("int") + 1, 128), " ")).alias("window_md5"))


@query("""select p_partkey, p_brand, p_size from part order by p_size desc nulls last, p_brand, p_partkey limit 20 offset 40""")
def g1_g3_order_page(t: Tables):
    return ops.page(t.part.select("p_partkey", "p_brand", "p_size"), [F.desc_nulls_last("p_size"), F.asc("p_brand"), F.asc("p_partkey")], 20, 40)


@query("""select doc_id from documents order by sha256('s' || doc_id) limit 25""")
def g10_top_by_hash(t: Tables):
    return t.documents.select("doc_id").orderBy(F.sha2(F.concat(F.lit("s"), F.col("doc_id").cast("string")), 256)).limit(25)


@query("""with old as (select event_id, case when event_id % 10 = 0 then 'x' else md5(event_type || value) end as h from events where event_id % 7 <> 0) select e.event_id, case when old.h is null then 'new' when old.h <> md5(event_type || value) then 'updated' else 'unchanged' end as change from events e left join old using (event_id)""")
def h1_change_split(t: Tables):
    rows = t.events.select("event_id", F.md5(F.concat(F.col("event_type"), F.col("value").cast("string"))).alias("h"))
    known = rows.where("event_id % 7 <> 0").withColumn("h", F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("h")))
    return ops.change_kind(rows, known, "event_id", "h").select("event_id", "change")


@query("""with b as (select c_custkey, c_mktsegment, c_acctbal from customer where c_custkey % 3 <> 0), f as (select c_custkey, 'NEW' as c_mktsegment, c_acctbal + 1 as c_acctbal from customer where c_custkey % 2 = 0) select coalesce(f.c_custkey, b.c_custkey) as c_custkey, case when f.c_custkey is not null then f.c_mktsegment else b.c_mktsegment end as c_mktsegment, coalesce(b.c_acctbal, f.c_acctbal) as c_acctbal from b full join f on b.c_custkey = f.c_custkey""")
def h2_a14_upsert(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return ops.upsert(rows.where("c_custkey % 3 <> 0"), rows.where("c_custkey % 2 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal")), "c_custkey", ["c_mktsegment"])


@query("""with a as (select p_partkey, p_size as d from part where p_partkey % 5 <> 0), b as (select p_partkey, case when p_partkey % 11 = 0 then -1 else p_size end as d from part where p_partkey % 4 <> 0) select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when b.p_partkey is null then 'removed' when a.p_partkey is null then 'added' when a.d <> b.d then 'changed' else 'same' end as status from a full join b on a.p_partkey = b.p_partkey""")
def h3_snapshot_delta(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").alias("d"))
    return ops.snapshot_delta(rows.where("p_partkey % 5 <> 0"), rows.where("p_partkey % 4 <> 0").withColumn("d", F.when(F.col("p_partkey") % 11 == 0, -1).otherwise(F.col("d"))), "p_partkey", "d")


@query("""select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, ts desc, event_id) as n from (select * from events where event_id % 2 = 0 union all select * from events where event_id % 3 = 0)) where n = 1""")
def h4_h5_merge(t: Tables):
    both = t.events.where("event_id % 2 = 0").unionByName(t.events.where("event_id % 3 = 0"))
    return ops.argmax(both, ["user_id"], [F.desc("value"), F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "value")


@query("""with a as (select lower(p_type) as k from part where p_brand = 'Brand#1' group by 1), b as (select lower(p_type) as k from part where p_brand = 'Brand#2' group by 1) select coalesce(a.k, b.k) as k, case when a.k is null then 'right' when b.k is null then 'left' else 'shared' end as side from a full join b on a.k = b.k""")
def h8_dimension_diff(t: Tables):
    a, b = (t.part.where(F.col("p_brand") == x).select(F.lower("p_type").alias(c)).distinct() for x, c in (("Brand#1", "l"), ("Brand#2", "r")))
    j = a.join(b, F.col("l") == F.col("r"), "full_outer")
    return j.select(F.coalesce("l", "r").alias("k"), F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("shared").alias("side"))
