"""Queries for retrieval, topics, graphs, evaluation and span metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill import storage
from corpusmill.functions import scores, text
from corpusmill.operators import kmeans, lexical_index, names
from corpusmill.operators import retrieval as r
from corpusmill.operators import tables as ops
from corpusmill.plans.registry import Tables, query

_BM25 = """with q as (select item_id as query_id, text as query from benchmark where item_id % 100 = 0),
qt as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')) as term from q) group by 1, 2),
dt as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from documents), p as (select doc_id, term, count(*) as tf from dt where term in (select term from qt) group by 1, 2),
l as (select doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as len from documents), c as (select count(*) as n, avg(len) as avg from l), df as (select term, count(*) as df from p group by 1),
s as (select query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))) as score from p join df using (term) join qt using (term) join l using (doc_id), c group by 1, 2),
a as (select q.query_id, d.doc_id, round(coalesce(score, 0), 6) as score from q cross join documents d left join s on s.query_id = q.query_id and s.doc_id = d.doc_id),
lex as (select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from a) where rank <= 20)"""
_KNN = """v as (select vec_id, embedding as e from embeddings), kq as (select vec_id as query_id, e as query from v where vec_id % 100 = 0),
ks as (select query_id, vec_id as doc_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(e[i] as double) * cast(query[i] as double))), 6) as score from v, kq where vec_id <> query_id),
den as (select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ks) where rank <= 20)"""
_HYBRID = """ln as (select query_id, doc_id, case when max(score) over w - min(score) over w < 1e-12 then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from lex window w as (partition by query_id)),
dn as (select query_id, doc_id, case when max(score) over w - min(score) over w < 1e-12 then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from den window w as (partition by query_id)),
h as (select coalesce(ln.query_id, dn.query_id) as query_id, coalesce(ln.doc_id, dn.doc_id) as doc_id, coalesce(ln.s, 0) as lexical, coalesce(dn.s, 0) as dense from ln full join dn on ln.query_id = dn.query_id and ln.doc_id = dn.doc_id)"""
_QRELS = """qrels as (select q.query_id, l.doc_id, quality + case when l.doc_id % 5 = q.query_id then 1 else 0 end as grade from labels l, (select item_id as query_id from benchmark where item_id % 100 = 0) q where l.doc_id % 7 = q.query_id % 7)"""


def _lexical(t: Tables):
    queries = t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return r.bm25(t.documents, "doc_id", "text", queries, 20)


def _dense(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return r.exact_knn(v, "doc_id", "embedding", v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query")), 20)


def _qrels(t: Tables):
    q = ops.small(t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id")))
    return t.labels.join(q, F.col("doc_id") % 7 == F.col("query_id") % 7).select("query_id", "doc_id", (F.col("quality") + (F.col("doc_id") % 5 == F.col("query_id")).cast("int")).alias("grade"))


@query(f"{_BM25} select * from lex")
def k1_k2_bm25(t: Tables):
    return _lexical(t).select("query_id", "doc_id", "score", "rank")


@query(f"{_BM25} select * from lex")
def k1_k2_index_search(t: Tables):
    """The same ranks from a kept index of two segments, the second appended."""
    path, docs = storage.new_path(t.documents.sparkSession, "lexical"), t.documents
    middle = docs.agg(F.expr("percentile_approx(doc_id, 0.5)").alias("m")).first().m
    lexical_index.append(docs.where(F.col("doc_id") <= middle), path, "doc_id", "text", 0)
    lexical_index.append(docs.where(F.col("doc_id") > middle), path, "doc_id", "text", 1)
    queries = t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical_index.search(docs.sparkSession, path, queries, 20, key="doc_id").select("query_id", "doc_id", "score", "rank")


@query(f"with {_KNN} select * from den")
def k4_g6_exact_knn(t: Tables):
    return _dense(t).select("query_id", "doc_id", "score", "rank")


@query(f"{_BM25}, {_KNN}, {_HYBRID} select query_id, doc_id, round(lexical, 6) as lexical, round(dense, 6) as dense, round(0.55 * lexical + 0.45 * dense, 6) as score from h")
def k7_d9_hybrid(t: Tables):
    return r.hybrid(_lexical(t), _dense(t), "doc_id").select("query_id", "doc_id", F.round("lexical", 6).alias("lexical"), F.round("dense", 6).alias("dense"), "score")


@query("""select doc_id, case when starts_with(lower(text), 'the') then 100 when contains(lower(substr(text, 1, 80)), 'the') then 30 else 0 end + case when contains(lower(text), 'the') then 10 else 0 end + case when contains(lower(source), 'src1') then 5 else 0 end as score from documents where text ilike '%the%' and lang = 'en' order by score desc, doc_id limit 50""")
def k9_db_lexical(t: Tables):
    low = F.lower("text")
    score = F.when(low.startswith("the"), 100).when(F.lower(F.substring("text", 1, 80)).contains("the"), 30).otherwise(0) + F.when(low.contains("the"), 10).otherwise(0) + F.when(F.lower("source").contains("src1"), 5).otherwise(0)
    return ops.page(ops.optional(t.documents, F.col("text").ilike("%the%"), F.col("lang") == "en").select("doc_id", score.alias("score")), [F.desc("score"), F.asc("doc_id")], 50)


@query(f"with {_KNN}, f as (select query_id, doc_id, score, round(0.85 * score + 0.10 * (doc_id % 10) / 10 + 0.05 * (doc_id % 3) / 3, 6) as adjusted from ks where score >= 0.1) select query_id, doc_id, score, adjusted, rank from (select *, row_number() over (partition by query_id order by adjusted desc, doc_id) as rank from f) where rank <= 10")
def k10_b32_similar(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    bonus = 0.10 * (F.col("doc_id") % 10) / 10 + 0.05 * (F.col("doc_id") % 3) / 3
    asked = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    return r.exact_knn(v, "doc_id", "embedding", asked, 10, weight=0.85, bonus=bonus, least=0.1).withColumnRenamed("final", "adjusted")


_CENTROID = """c as (select label, i, avg(cast(embedding[i] as double)) as x from embeddings, (select unnest(range(1, 65)) as i) group by 1, 2)"""


def _centroids(t: Tables):
    one = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("center"))


@query(f"with {_CENTROID}, d as (select vec_id, e.label, sqrt(sum((cast(embedding[i] as double) - x) * (cast(embedding[i] as double) - x))) as distance from embeddings e join c on c.label = e.label group by 1, 2) select vec_id, label, round(distance, 6) as distance, row_number() over (partition by label order by round(distance, 6), vec_id) as rank from d")
def k14_k15_f7_assignment(t: Tables):
    gap = lambda v, c: F.transform(F.arrays_zip(v.alias("a"), c.alias("b")), lambda p: p["a"].cast("double") - p["b"])
    rows = t.embeddings.join(ops.small(_centroids(t)), "label").withColumn("g", gap(F.col("embedding"), F.col("center")))
    rows = rows.select("vec_id", "label", F.round(F.sqrt(scores.dot(F.col("g"), F.col("g"))), 6).alias("distance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("distance", "vec_id")))


@query("select label, count(*) as size, round(avg(vec_id % 10), 6) as mean_score, count(*) filter (where vec_id % 3 = 0) as with_code from embeddings group by 1 order by size desc, label")
def e27_g8_cluster_summary(t: Tables):
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(F.col("vec_id") % 10), 6).alias("mean_score"), F.count_if(F.col("vec_id") % 3 == 0).alias("with_code")).orderBy(F.desc("size"), "label")


@query(None)
def k6_ann(t: Tables):
    """Lists around k-means centres, the nearest probed; a test measures recall against the exact search."""
    v = t.embeddings.select("vec_id", "embedding")
    index, centres = r.ann_index(v, "vec_id", "embedding", lists=16)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return r.ann_search(index, centres, asked, 10, probes=8).withColumnRenamed("key", "vec_id")


@query(None)
def k12_kmeans(t: Tables):
    """Mini-batch k-means; other engines draw other starts, so rows only."""
    centres = kmeans.fit(t.embeddings, "vec_id", "embedding", 10)
    return kmeans.assign(t.embeddings, "vec_id", "embedding", centres).select("vec_id", F.col("centre").alias("cluster"))


@query(None)
def k16_projection(t: Tables):
    """First two principal components; their signs are free, so rows only."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    xy = vector_to_array(F.col("xy"))
    return PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(rows).select("vec_id", xy[0].alias("x"), xy[1].alias("y"))


_EDGES = """e as (select substr(sha1(concat_ws('|', 'cites', o.o_custkey, l.l_partkey)), 1, 20) as edge_id, o.o_custkey as source, l.l_partkey as target, l.l_partkey in (select p_partkey from part where p_size > 10) as resolved, count(*) as evidence from orders o join lineitem l on l_orderkey = o_orderkey where o_custkey <> l_partkey group by all)"""


def _edges(t: Tables):
    known = t.part.where("p_size > 10").select(F.col("p_partkey").alias("k")).distinct()
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where("o_custkey <> l_partkey").groupBy(F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count(F.lit(1)).alias("evidence"))
    e = e.join(ops.small(known), F.col("target") == F.col("k"), "left")
    return e.select(text.edge_id(F.lit("cites"), F.col("source"), F.col("target")).alias("edge_id"), "source", "target", F.col("k").isNotNull().alias("resolved"), "evidence")


@query(f"with {_EDGES} select * from e")
def l1_l2_citation_graph(t: Tables):
    return _edges(t)


@query(f"with {_EDGES} select 'out' as direction, edge_id, target as node from e where source = 11 union all select 'in', edge_id, source from e where target = 11")
def l4_l5_neighbours(t: Tables):
    e = _edges(t)
    side = lambda mine, other, name: e.where(F.col(mine) == 11).select(F.lit(name).alias("direction"), "edge_id", F.col(other).alias("node"))
    return side("source", "target", "out").unionByName(side("target", "source", "in"))


@query(f"with {_EDGES} select target, count(*) as papers, resolved from e group by target, resolved order by papers desc, target limit 30")
def l8_top_referenced(t: Tables):
    return ops.page(_edges(t).groupBy("target", "resolved").agg(F.count(F.lit(1)).alias("papers")), [F.desc("papers"), F.asc("target")], 30)


@query(f"with {_EDGES} select count(*) as edges, count(distinct source) as papers, count(distinct target) as targets, count(*) filter (where resolved) as resolved, round(count(*) filter (where resolved) / cast(count(*) as double), 6) as ratio from e")
def l9_l13_graph_analytics(t: Tables):
    return _edges(t).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("papers"), F.countDistinct("target").alias("targets"), F.count_if("resolved").alias("resolved"), F.round(F.count_if("resolved") / F.count(F.lit(1)), 6).alias("ratio"))


@query(f"with {_EDGES}, f as (select c_nationkey as family, source, resolved from e join customer on c_custkey = source) select family, count(distinct source) as papers, count(*) filter (where resolved) as internal, count(*) filter (where not resolved) as external from f group by 1")
def l7_family_diagnostics(t: Tables):
    f = _edges(t).join(ops.small(t.customer.select("c_custkey", F.col("c_nationkey").alias("family"))), F.col("source") == F.col("c_custkey"))
    return f.groupBy("family").agg(F.countDistinct("source").alias("papers"), F.count_if("resolved").alias("internal"), F.count_if(~F.col("resolved")).alias("external"))


@query(
    f"""{_BM25}, {_QRELS}, j as (select lex.query_id, rank, coalesce(grade, 0) as grade from lex left join qrels on qrels.query_id = lex.query_id and qrels.doc_id = lex.doc_id),
g as (select query_id, sum(case when rank <= 10 and grade > 0 then 1 else 0 end) as hits, min(case when grade > 0 then rank end) as first, sum(case when rank <= 10 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as dcg from j group by 1),
b as (select query_id, count(*) as relevant, sum(case when n <= 10 then (pow(2, grade) - 1) / log2(n + 1) else 0 end) as idcg from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as n from qrels where grade > 0) group by 1)
select g.query_id, round(hits / 10.0, 6) as precision, round(coalesce(hits / cast(relevant as double), 0), 6) as recall, round(coalesce(1.0 / first, 0), 6) as reciprocal_rank, round(dcg, 6) as dcg, round(coalesce(idcg, 0), 6) as idcg, round(coalesce(dcg / idcg, 0), 6) as ndcg from g left join b using (query_id)"""
)
def m1_m5_ir_metrics(t: Tables):
    return r.metrics_at_k(_lexical(t), _qrels(t), "doc_id", 10)


@query("""with v as (select p_brand as variant, round(avg(p_size), 4) as quality, round(avg(p_retailprice), 4) as latency from part group by 1) select * from v a where not exists (select 1 from v b where b.quality >= a.quality and b.latency <= a.latency and (b.quality > a.quality or b.latency < a.latency))""")
def m11_pareto(t: Tables):
    v = t.part.groupBy(F.col("p_brand").alias("variant")).agg(F.round(F.avg("p_size"), 4).alias("quality"), F.round(F.avg("p_retailprice"), 4).alias("latency"))
    return r.pareto(v, ["quality"], ["latency"])


@query("""with a as (select user_id, list(event_id order by value desc, event_id)[1:10] as x from events group by 1), b as (select user_id, list(event_id order by ts desc, event_id)[1:10] as y from events group by 1) select user_id, len(list_intersect(x, y)) / 10.0 as overlap, x = y as same_order from a join b using (user_id)""")
def m15_overlap(t: Tables):
    def first(order, name: str):
        near = ops.argmax_n(t.events, ["user_id"], [order, F.asc("event_id")], 10)
        return near.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda s: s["event_id"]).alias(name))

    rows = first(F.desc("value"), "x").join(first(F.desc("ts"), "y"), "user_id")
    return rows.select("user_id", (F.size(F.array_intersect("x", "y")) / 10.0).alias("overlap"), (F.col("x") == F.col("y")).alias("same_order"))


@query("""with p as (select quality = 1 as truth, n_chars > 800 as said from labels join documents using (doc_id)), c as (select count(*) filter (where truth and said) as tp, count(*) filter (where not truth and said) as fp, count(*) filter (where truth and not said) as fn from p), m as (select *, round(tp / cast(tp + fp as double), 6) as precision, round(tp / cast(tp + fn as double), 6) as recall from c)
select tp, fp, fn, precision, recall, round(2 * precision * recall / (precision + recall), 6) as f1, round(1.25 * precision * recall / (0.25 * precision + recall), 6) as f05 from m""")
def n5_b45_prf(t: Tables):
    truth, said = F.col("quality") == 1, F.col("n_chars") > 800
    c = t.labels.join(t.documents, "doc_id").agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 6))
    c = c.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))
    return c.withColumn("f1", scores.f_beta(F.col("precision"), F.col("recall"), 1.0)).withColumn("f05", scores.f_beta(F.col("precision"), F.col("recall"), 0.5))


@query("""with g as (select unnest([200, 500, 1000, 2000]) as threshold), p as (select quality, n_chars from labels join documents using (doc_id)) select threshold, count(*) filter (where n_chars >= threshold and quality = 1) as tp, count(*) filter (where n_chars >= threshold and quality = 0) as fp, count(*) filter (where n_chars < threshold and quality = 1) as fn from g, p group by 1""")
def n10_threshold_grid(t: Tables):
    grid = [200, 500, 1000, 2000]
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    over, good = lambda k: F.col("n_chars") >= k, F.col("quality") == 1
    one = rows.agg(*[x for k in grid for x in (F.count_if(over(k) & good).alias(f"tp{k}"), F.count_if(over(k) & ~good).alias(f"fp{k}"), F.count_if(~over(k) & good).alias(f"fn{k}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), *[F.col(f"{m}{k}").alias(m) for m in ("tp", "fp", "fn")]) for k in grid])).alias("x")).select("x.*")


@query("""with w as (select doc_id, unnest(range(1, length(text))) as pos, text from documents) select doc_id, pos - 1 as char_start, pos + 3 as char_end, 'sha256:' || substr(sha256(doc_id || '|' || (pos - 1) || '|' || 'that'), 1, 32) as mention_id from w where lower(substr(text, pos, 4)) = 'that' and not regexp_matches(substr(text, pos + 4, 1), '[\\p{L}\\p{N}_]') and (pos = 1 or not regexp_matches(substr(text, pos - 1, 1), '[\\p{L}\\p{N}_]'))""")
def n1_n3_literal_spans(t: Tables):
    """Places of a word by the lengths of the pieces between its matches; native, in code points."""
    pattern = r"(?i)(?<![\p{L}\p{N}_])that(?![\p{L}\p{N}_])"
    docs = t.documents
    gaps = F.split("text", pattern, -1)
    ends = docs.select("doc_id", F.posexplode(F.slice(gaps, 1, F.size(gaps) - 1)).alias("i", "gap"))
    w = Window.partitionBy("doc_id").orderBy("i")
    start = F.sum(F.length("gap")).over(w) + 4 * F.col("i")
    rows = ends.select("doc_id", start.cast("bigint").alias("char_start"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("char_start").cast("string"), F.lit("that"))
    return rows.select("doc_id", "char_start", (F.col("char_start") + 4).alias("char_end"), F.concat(F.lit("sha256:"), text.stable_hash(key)).alias("mention_id"))


@query(None)
def d12_fuzzy_join(t: Tables):
    """Names within the same size by sequence-match ratio; no SQL function has this ratio."""
    return names.pairs_of_rows(t.part, "p_partkey", "p_name", 0.8, ["p_size"])
