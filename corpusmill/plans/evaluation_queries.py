"""Queries for the comparison of retrieval runs. The events stand in for runs: a user asks, the events are what is found."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import evaluation
from corpusmill.plans.registry import Tables, query

_RUNS = """r as (select 'a' as run, user_id as query_id, event_id as key, value as score from events union all select 'b', user_id, event_id, round(value + (event_id % 7), 6) from events union all select 'c', user_id, event_id, round(value * (1 + event_id % 3), 6) from events where event_id % 4 <> 0),
runs as (select *, row_number() over (partition by run, query_id order by score desc, key) as rank from r), grades as (select user_id as query_id, event_id as key, case event_type when 'purchase' then 2 when 'click' then 1 else 0 end as grade from events where user_id % 3 <> 0)"""


def _runs(t: Tables):
    e = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("key"), F.col("value").alias("score"))
    k = F.col("key")
    rows = e.withColumn("run", F.lit("a")).unionByName(e.withColumn("score", F.round(F.col("score") + k % 7, 6)).withColumn("run", F.lit("b"))).unionByName(e.where(k % 4 != 0).withColumn("score", F.round(F.col("score") * (1 + k % 3), 6)).withColumn("run", F.lit("c")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run", "query_id").orderBy(F.desc("score"), "key")))


def _grades(t: Tables):
    grade = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return t.events.where("user_id % 3 <> 0").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("key"), grade.alias("grade"))


def _of(t: Tables, run: str):
    return _runs(t).where(F.col("run") == run).drop("run")


_METRICS = """m as (select event_type as mode, user_id % 4 as grp, (event_id % 11) / 10.0 as recall, (event_id % 13) / 12.0 as ndcg, (event_id % 5) / 4.0 as mrr, value as latency, event_id % 6 as results, case when event_id % 17 = 0 then 'timeout' end as error from events)"""
_SUMMARY = """select {by}, count(*) as queries, count(*) filter (where error is not null) as errors, round(avg(recall) filter (where error is null), 6) as recall, round(avg(ndcg) filter (where error is null), 6) as ndcg, round(avg(mrr) filter (where error is null), 6) as mrr, round(round(quantile_cont(latency, 0.5) filter (where error is null), 6), 3) as p50, round(round(quantile_cont(latency, 0.95) filter (where error is null), 6), 3) as p95, round(avg(case when results = 0 then 1.0 else 0.0 end) filter (where error is null), 6) as empty from m group by {by}"""


def _metrics(t: Tables):
    k = F.col("event_id")
    return t.events.select(F.col("event_type").alias("mode"), (F.col("user_id") % 4).alias("grp"), (k % 11 / 10.0).alias("recall"), (k % 13 / 12.0).alias("ndcg"), (k % 5 / 4.0).alias("mrr"), F.col("value").alias("latency"), (k % 6).alias("results"), F.when(k % 17 == 0, "timeout").alias("error"))


@query(f"with {_METRICS}, s as ({_SUMMARY.format(by='mode, grp')}) select *, round(0.4 * recall + 0.4 * ndcg + 0.2 * mrr, 6) as composite from s")
def m7_mode_summary(t: Tables):
    return evaluation.summary(_metrics(t), ["mode", "grp"])


@query(f"""with {_METRICS}, s as ({_SUMMARY.format(by='mode')}), l as (select mode, 'recall' as metric, recall as v from s union all select mode, 'ndcg', ndcg from s)
select a.mode as a, b.mode as b, a.metric, round(a.v - b.v, 6) as delta, case when round(a.v - b.v, 6) > 0 then a.mode when round(a.v - b.v, 6) < 0 then b.mode else 'tie' end as winner from l a join l b on a.metric = b.metric and a.mode < b.mode""")
def m8_pairwise_modes(t: Tables):
    return evaluation.pairwise(evaluation.summary(_metrics(t), ["mode"]), "mode", ["recall", "ndcg"])


_VARIANTS = """v as (select p_brand as weight, p_size % 3 as candidate_k, p_partkey % 2 = 0 as rank, round(avg(p_retailprice / 2000), 6) as recall, round(avg(p_size / 50.0), 6) as ndcg, round(avg(p_partkey % 10 / 9.0), 6) as mrr from part group by 1, 2, 3)"""


def _variants(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("weight"), (F.col("p_size") % 3).alias("candidate_k"), (F.col("p_partkey") % 2 == 0).alias("rank")).agg(F.round(F.avg(F.col("p_retailprice") / 2000), 6).alias("recall"), F.round(F.avg(F.col("p_size") / 50.0), 6).alias("ndcg"), F.round(F.avg(F.col("p_partkey") % 10 / 9.0), 6).alias("mrr"))


@query(f"with {_VARIANTS} select *, round(0.4 * recall + 0.4 * ndcg + 0.2 * mrr, 6) as composite from v")
def m9_m10_variant_grid(t: Tables):
    return _variants(t).withColumn("composite", evaluation.composite(F.col("recall"), F.col("ndcg"), F.col("mrr")))


@query(f"with {_VARIANTS} select a.weight, a.candidate_k, round(a.recall - b.recall, 6) as recall, round(a.ndcg - b.ndcg, 6) as ndcg from v a join v b on a.weight = b.weight and a.candidate_k = b.candidate_k and a.rank and not b.rank")
def m12_rank_effects(t: Tables):
    return evaluation.flag_effects(_variants(t), ["weight", "candidate_k"], "rank", ["recall", "ndcg"])


@query(f"""with {_RUNS}, s as (select run, query_id, round(sum(score), 6) as score from runs where rank <= 5 group by 1, 2), n as (select *, row_number() over (partition by query_id order by score desc, run) as n, lead(score) over (partition by query_id order by score desc, run) as nx from s) select query_id, run as winner, score, round(score - coalesce(nx, score), 6) as margin from n where n = 1""")
def m12_query_winners(t: Tables):
    s = _runs(t).where("rank <= 5").groupBy("run", "query_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return evaluation.query_winners(s, "run", "score")


@query(f"""with {_RUNS}, top as (select run, query_id, key, rank from runs where rank <= 10 and run in ('a', 'b')), good as (select query_id, key, grade from grades where grade > 0),
q as (select distinct query_id from top), rel as (select query_id, count(*) filter (where x.b and not x.a) as added, count(*) filter (where x.a and not x.b) as removed from (select g.query_id, g.key, bool_or(run = 'a') as a, bool_or(run = 'b') as b from good g join top using (query_id, key) group by 1, 2) x group by 1),
gain as (select query_id, sum(case when run = 'b' then grade / log2(rank + 1) else 0 end) - sum(case when run = 'a' then grade / log2(rank + 1) else 0 end) as d from top join good using (query_id, key) group by 1), l as (select query_id, string_agg(key::varchar, ',' order by rank) filter (where run = 'a') = string_agg(key::varchar, ',' order by rank) filter (where run = 'b') as same from top group by 1)
select q.query_id, coalesce(added, 0) as added, coalesce(removed, 0) as removed, case when q.query_id not in (select query_id from grades) then 'insufficient_labels' when removed > 0 then 'ranking_removed_relevant_from_top_k' when added > 0 then 'ranking_added_relevant_to_top_k' when d < -1e-9 then 'ranking_hurt_order' when d > 1e-9 then 'ranking_helped' when same then 'ranking_no_effect' else 'tie_or_boundary_effect' end as effect from q join l using (query_id) left join rel using (query_id) left join gain using (query_id)""")
def m13_ranking_effects(t: Tables):
    return evaluation.ranking_effects(_of(t, "a"), _of(t, "b"), _grades(t), 10)


@query(f"""with {_RUNS}, j as (select a.query_id, a.rank as ra, b.rank as rb, abs(b.score - a.score) as gap from runs a join runs b on a.run = 'a' and b.run = 'c' and a.query_id = b.query_id and a.key = b.key)
select query_id, count(*) as shared, round(avg(gap), 6) as mean_change, round(max(gap), 6) as max_change, count(*) filter (where gap > 1e-12) as changed, count(*) filter (where ra <= 10 and rb <= 10) as overlap, round(count(*) filter (where ra <= 10 and rb <= 10) / 10.0, 6) as overlap_ratio, count(*) filter (where ra <= 10 and rb <= 10 and ra = rb) = 10 as same_order from j group by 1""")
def m14_pool_sensitivity(t: Tables):
    return evaluation.pool_sensitivity(_of(t, "a"), _of(t, "c"), 10)


@query(f"""with {_RUNS}, a as (select * from runs where run = 'a'), b as (select * from runs where run = 'b' and rank <= 3), m as (select * from a where rank <= 3 and not exists (select 1 from b where b.query_id = a.query_id and b.key = a.key)), n as (select b.query_id, b.key from b where not exists (select 1 from a where a.rank <= 3 and a.query_id = b.query_id and a.key = b.key))
select m.query_id, m.key as missed, n.key as replacement, m.rank as missed_rank, r.rank as replacement_rank, round(m.score - r.score, 6) as gap from m join n using (query_id) left join a r on r.query_id = n.query_id and r.key = n.key""")
def m16_mismatches(t: Tables):
    return evaluation.mismatches(_of(t, "a"), _of(t, "b"), 3)


@query(f"""with {_RUNS}, p as (select query_id, key, min(rank) as best_rank, count(distinct run) as modes from runs where rank <= 20 group by 1, 2), o as (select p.*, row_number() over (partition by query_id order by best_rank, modes desc, event_type nulls first, key) as position from p left join events on event_id = key) select * from o where position <= 15""")
def m20_candidate_pool(t: Tables):
    titles = t.events.select(F.col("event_id").alias("key"), F.col("event_type").alias("title"))
    return evaluation.pooled(_runs(t).where("rank <= 20"), titles, 15)


@query(f"""with {_RUNS} select r.query_id, r.key, coalesce(g.grade, case when r.query_id % 2 = 0 then 0 else cast(r.query_id = 5 and contains(event_type, 'view') as int) end) as grade from runs r left join (select * from grades where key % 2 = 0) g on g.query_id = r.query_id and g.key = r.key join events on event_id = r.key where run = 'a' and rank <= 10""")
def c15_relevance_grade(t: Tables):
    results = _of(t, "a").where("rank <= 10").join(t.events.select(F.col("event_id").alias("key"), "event_type"), "key")
    strict = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("query_id"))
    return evaluation.relevance_grade(results, _grades(t).where("key % 2 = 0"), strict, {5: ["VIEW"]}, {}, "event_type").select("query_id", "key", "grade")
