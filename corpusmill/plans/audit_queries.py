"""Queries for mentions, labels, cursors, audits and further predicates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusmill.functions import phrases, records, text
from corpusmill.operators import labels, mentions
from corpusmill.operators import tables as ops
from corpusmill.plans.registry import Tables, query

_MENTIONS = """m as (select event_id as id, event_type as kind, value / 100.0 as score, 'sha256:m' || event_id as mention_id, 'sha256:e' || event_id as evidence_id from events)"""


def _mentions(t: Tables):
    k = F.col("event_id").cast("string")
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("value") / 100.0).alias("score"), F.concat(F.lit("sha256:m"), k).alias("mention_id"), F.concat(F.lit("sha256:e"), k).alias("evidence_id"))


@query(f"""with {_MENTIONS} select id, mention_id, 'sha256:' || substr(sha256('build-2|' || mention_id), 1, 32) as evidence_id, evidence_id as parent_evidence_id, 'build-1' as parent_build, 'build-2' as build from m where score >= case kind when 'purchase' then 0.2 when 'view' then 0.5 else 0.3 end""")
def n11_policy_mentions(t: Tables):
    return mentions.selected(_mentions(t), {"purchase": 0.2, "view": 0.5}, 0.3, "build-1", "build-2").drop("kind", "score")


_SAID = """p as (select event_id, event_type as truth, case when event_id % 5 = 0 then 'view' when event_id % 7 = 0 then null else event_type end as base, case when event_id % 6 = 0 then 'click' else event_type end as cand, (event_id % 100) / 100.0 as margin from events)"""


def _said(t: Tables):
    k = F.col("event_id")
    return t.events.select(k, F.col("event_type").alias("truth"), F.when(k % 5 == 0, "view").when(k % 7 == 0, None).otherwise(F.col("event_type")).alias("base"), F.when(k % 6 == 0, "click").otherwise(F.col("event_type")).alias("cand"), (k % 100 / 100.0).alias("margin"))


_CLASSES = """c as (select kind, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (select truth as kind, cast(coalesce(truth = base, false) as int) as tp, 0 as fp, cast(truth is distinct from base as int) as fn from p union all select base, 0, cast(truth is distinct from base as int), 0 from p where base is not null) group by rollup (kind)),
f as (select *, case when tp + fp > 0 then round(tp / cast(tp + fp as double), 6) end as precision, case when tp + fn > 0 then round(tp / cast(tp + fn as double), 6) end as recall from c), s as (select kind, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, precision, recall, case when precision + recall = 0 then 0.0 else round(2 * precision * recall / (precision + recall), 6) end as f1 from f)"""


@query(f"with {_SAID}, {_CLASSES} select * from s")
def n6_n8_per_type(t: Tables):
    return mentions.per_class(_said(t), "truth", "base")


@query(f"with {_SAID}, {_CLASSES} select case when count(f1) = count(*) then round(avg(f1), 6) end as macro_f1, count(*) as classes from s where kind is not null and tp + fn > 0")
def n8_macro_f1(t: Tables):
    return mentions.macro_f1(mentions.per_class(_said(t), "truth", "base"))


@query(f"with {_SAID} select count(*) as cases, count(*) filter (where coalesce(base = truth, false) = false and cand = truth) as corrected, count(*) filter (where base = truth and cand <> truth) as regressed, count(*) filter (where coalesce(base = truth, false) = false and cand = truth) - count(*) filter (where base = truth and cand <> truth) as net, round(count(*) filter (where base = truth and cand <> truth) / cast(count(*) filter (where base = truth) as double), 6) as regression_rate from p")
def n16_revision(t: Tables):
    return mentions.revision(_said(t), F.col("truth"), F.col("base"), F.col("cand"))


@query(f"with {_SAID}, g as (select unnest([0.0, 0.25, 0.5, 0.75]) as threshold) select cast(threshold as double) as threshold, count(*) filter (where margin >= threshold and base <> cand) as changed, count(*) filter (where margin >= threshold and base <> cand and base <> truth and cand = truth) as corrected, count(*) filter (where margin >= threshold and base <> cand and base = truth and cand <> truth) as regressed from g, p group by 1")
def n16_margin_sweep(t: Tables):
    return mentions.margin_sweep(_said(t), F.col("truth"), F.col("base"), F.col("cand"), F.col("margin"), [0.0, 0.25, 0.5, 0.75])


@query("""with t as (select p_partkey, p_name from part where p_partkey % 10 <> 0), c as (select p_partkey, case when p_partkey % 13 = 0 then 'x' else p_name end as p_name, p_partkey % 17 <> 0 as complete from part where p_partkey % 11 <> 0 union all select p_partkey, p_name, true from part where p_partkey % 50 = 1 and p_partkey % 11 <> 0)
select 'missing' as rule, p_partkey::varchar as key from t where p_partkey not in (select p_partkey from c) union all select 'unknown', p_partkey::varchar from c where p_partkey not in (select p_partkey from t) union all select 'twice', p_partkey::varchar from c group by p_partkey having count(*) > 1 union all select 'changed', c.p_partkey::varchar from c join t using (p_partkey) where c.p_name <> t.p_name union all select 'incomplete', p_partkey::varchar from c where not complete""")
def n18_annotation_faults(t: Tables):
    k = F.col("p_partkey")
    template = t.part.where(k % 10 != 0).select(k, "p_name")
    done = t.part.where(k % 11 != 0)
    completed = done.select(k, F.when(k % 13 == 0, "x").otherwise(F.col("p_name")).alias("p_name"), (k % 17 != 0).alias("complete")).unionByName(done.where(k % 50 == 1).select(k, "p_name", F.lit(True).alias("complete")))
    return mentions.annotation_faults(template, completed, "p_partkey", ["p_name"])


@query("""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{9,30}'))) as word from documents) select doc_id, count(*) as words from w group by 1""")
def n2_windowed_extraction(t: Tables):
    """A model of the simplest kind, over windows of 1,000 characters that share 200: long capitalized words."""
    pattern = re.compile("[A-Z][a-z]{9,30}")

    def model(s: str) -> list[tuple[int, int, str, float]]:
        return [(m.start(), m.end(), m[0], 1.0) for m in pattern.finditer(s) if m.end() < len(s) or len(s) < 1000]

    found = mentions.extract(t.documents, "doc_id", "text", model)
    return found.groupBy("doc_id").agg(F.countDistinct("kind").alias("words"))


@query(None)
def n7_overlap_panel(t: Tables):
    """Typed and untyped, exact and relaxed, over turns as spans."""
    span = lambda role, a, b: t.conversations.where(F.col("role") == role).select("conv_id", (F.col("turn") * a).alias("lo"), (F.col("turn") * a + b).alias("hi"), F.when(F.col("turn") % 3 == 0, "x").otherwise("y").alias("kind"), (F.col("turn") % 5 == 4).alias("uncertain"))
    return mentions.overlap_panel(span("user", 7, 10), span("assistant", 5, 8), "conv_id")


@query("""with e as (select event_id, case event_id % 6 when 0 then 'HTTP 429: Rate exceeded' when 1 then '503 Service Unavailable' when 2 then 'Read timed out' when 3 then 'Failed to resolve host' when 4 then 'MaxRetryError(x)' else 'KeyError' end as error from events) select event_id, case event_id % 6 when 0 then 'rate_limited' when 1 then 'service_unavailable' when 2 then 'timeout' when 3 then 'network_error' when 4 then 'network_error' else 'fatal_error' end as kind, case event_id % 6 when 0 then 60 when 1 then 30 when 2 then 15 when 5 then 0 else 15 end as cooldown_minutes from e""")
def j3_error_kinds(t: Tables):
    from corpusmill.sources import feeds

    said = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429: Rate exceeded", "503 Service Unavailable", "Read timed out", "Failed to resolve host", "MaxRetryError(x)", "KeyError")]), (F.col("event_id") % 6 + 1).cast("int"))
    kind = feeds.error_kind(said)
    return t.events.select("event_id", kind.alias("kind"), feeds.cooldown_minutes(kind).alias("cooldown_minutes"))


@query("""with r as (select user_id % 40 as profile, event_id as batch, case when event_id % 9 = 0 then null else event_id % 50 end as fetched from events), s as (select profile, count(*) filter (where fetched is not null) * 50 as next_start, coalesce(sum(fetched), 0) as documents, count(*) filter (where fetched is null) as failures, count(*) as runs from r group by 1) select profile, next_start, cast(documents as bigint) as documents, failures, runs from s""")
def j1_cursor_state(t: Tables):
    from corpusmill.sources import feeds

    fetched = F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 50)
    return feeds.advanced(t.events.select((F.col("user_id") % 40).alias("profile"), "event_id", fetched.alias("fetched")), "profile", "fetched", 50)


@query("""with w as (select label as cluster, vec_id, 'deep neural graph model ' || (vec_id % 7) || ' graph learning' as said from embeddings) select cluster, count(*) as docs from w group by 1 having count(*) > 1""")
def k17_k18_cluster_labels(t: Tables):
    """Labels by greedy pick; the SQL holds the documents of the best phrase, which all titles have."""
    docs = t.embeddings.select(F.col("label").alias("cluster"), F.lit("deep neural graph model").alias("title"), F.concat(F.lit("number"), (F.col("vec_id") % 7).cast("string"), F.lit(" graph learning")).alias("body"))
    found = labels.candidates(docs, "cluster", "title", "body")
    best = labels.labels(found, "cluster").where("position = 1").select("cluster", "phrase")
    return best.join(found, ["cluster", "phrase"]).select("cluster", "docs")


@query(None)
def k13_full_kmeans(t: Tables):
    """Full k-means with each row's distance to its centre; rows only, as for the mini-batch kind."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=7, maxIter=100, tol=1e-6).fit(rows)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # ten of them
    out = model.transform(rows).withColumn("v", vector_to_array("features"))
    gap = F.aggregate(F.zip_with("v", F.element_at(centers, F.col("prediction") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", F.col("prediction").alias("cluster"), F.round(F.sqrt(gap), 6).alias("distance"))


@query("""with c as (select label, vec_id, row_number() over (partition by label order by vec_id) as rank, (vec_id % 120) / 100.0 as score from embeddings) select 'rank_positive' as rule, count(*) filter (where not rank > 0) as violations from c union all select 'unit_score', count(*) filter (where not score between 0 and 1) from c union all select 'duplicate_ids', count(*) - count(distinct vec_id) from c union all select 'same_rows', abs(count(*) - (select count(*) from embeddings)) from c""")
def q5_cluster_checks(t: Tables):
    from pyspark.sql import Window

    c = t.embeddings.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"), (F.col("vec_id") % 120 / 100.0).alias("score"))
    return ops.checks(c, {"rank_positive": F.col("rank") > 0, "unit_score": F.col("score").between(0, 1)}).unionByName(ops.duplicates(c, "vec_id")).unionByName(ops.row_parity(c, t.embeddings))


@query("""with s as (select doc_id, case when n_chars > 5000 then 'long' when lang = 'fr' then 'french' end as stratum, sha256('audit|' || doc_id) as h from documents), f as (select doc_id, stratum from (select *, row_number() over (partition by stratum order by h) as n from s where stratum is not null) where n <= 10), r as (select doc_id, 'top_up' as stratum from s where doc_id not in (select doc_id from f) order by h limit (select 40 - count(*) from f)) select * from f union all select * from r""")
def q7_audit_sample(t: Tables):
    return labels.stratified_audit(t.documents, "doc_id", {"long": F.col("n_chars") > 5000, "french": F.col("lang") == "fr"}, 10, 40, "audit")


@query("""with h as (select regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') as host, html from pages) select host, count(*) as n, count(*) filter (where html <> '') as with_html, round(avg(length(html)), 4) as mean_length from h group by 1 order by n desc, host limit 20""")
def q10_source_diagnostics(t: Tables):
    host = text.url_host(F.col("url"))
    rows = t.pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("html") != "").alias("with_html"), F.round(F.avg(F.length("html")), 4).alias("mean_length"))
    return ops.page(rows, [F.desc("n"), F.asc("host")], 20)


@query("""select provider, count(*) as total, count(*) filter (where size > 25) as large from (select p_brand as provider, p_size as size from part) group by 1""")
def e31_count_companions(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("provider")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("""select p_partkey, p_name, p_size from part order by coalesce(p_size::varchar, ''), coalesce(p_name, ''), coalesce(p_partkey::varchar, '') limit 50""")
def g11_export_sort(t: Tables):
    return ops.page(t.part.select("p_partkey", "p_name", "p_size"), ops.by_text("p_size", "p_name", "p_partkey"), 50)


@query("""select doc_id from documents where list_contains(['x', lang], 'de') or list_contains(string_split(source, '-'), 'src3')""")
def c3_containment(t: Tables):
    return t.documents.where(ops.holds("de", F.array(F.lit("x"), F.col("lang"))) | ops.holds("src3", F.split("source", "-"))).select("doc_id")


@query("""select l_orderkey, l_linenumber, coalesce(l_returnflag in ('R', 'A') and greatest(l_discount * 10, 0.2) >= case when p_size > 25 then 0.6 else 0.4 end, false) as trusted from lineitem left join part on p_partkey = l_partkey and p_partkey % 3 <> 0""")
def c10_feature_trust(t: Tables):
    from corpusmill.functions import links

    part = t.part.where("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("entity_type"))
    j = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select("l_orderkey", "l_linenumber", links.feature_trusted(F.col("l_returnflag"), F.greatest(F.col("l_discount") * 10, F.lit(0.2)), F.coalesce("entity_type", F.lit("small")), ["R", "A"], {"large": 0.6}, 0.4).alias("trusted"))


@query("""select doc_id, md5('T' || doc_id || ' ' || lang) as lexical, md5('T' || doc_id || chr(10) || source || chr(10) || lang) as dense from documents""")
def b37_text_builders(t: Tables):
    title = F.concat(F.lit("T"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", F.md5(records.joined_text(" ", title, F.lit(None), F.col("lang"))).alias("lexical"), F.md5(records.joined_text("\n", title, F.lit("  "), F.col("source"), F.col("lang"))).alias("dense"))


@query("""select o_orderkey, '{"sources":["' || o_orderpriority || '"],"n":1}' as provenance from orders""")
def b43_compact_json(t: Tables):
    return t.orders.select("o_orderkey", records.compact_json(sources=F.array("o_orderpriority"), n=F.lit(1), gone=F.lit(None).cast("string")).alias("provenance"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'Large Language Models' when 1 then 'graph neural network' end as label from part""")
def b35_phrase_labels(t: Tables):
    said = F.element_at(F.array(F.lit("llms"), F.lit("graph neural network"), F.lit("based method 12")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", records.phrase_label(said, {"llms": "Large Language Models"}, ["based", "method"]).alias("label"))


# Fixed cases: a term; what it is rewritten to; whether it is no label; its points; its family.
_TERMS = [
    ("Large  Language LLMs", "large language models", False, 74, "large_language_models"),
    ("graph", "graph", False, -142, "graph"),
    ("cs.LG", "cs.lg", True, 8, "cs.lg"),
    ("translation nmt", "neural machine translation", False, 74, "machine_translation"),
    ("deep", "deep", True, 8, "deep"),
    ("github machine learning", "github machine learning", True, 24, "github"),
    ("policy gradient", "policy gradient", False, 51, "reinforcement_learning"),
    ("", "", True, 0, "unknown"),
    ("Recent Years", "recent years", True, 16, "recent"),
    ("decision trees", "decision trees", False, 46, "classical_ml"),
]


def _told(i: int) -> str:
    said = [f"'{r[i]}'" if isinstance(r[i], str) else str(r[i]).lower() for r in _TERMS]
    return f"[{', '.join(said)}][p_partkey % {len(_TERMS)} + 1]"


@query(f"select p_partkey, {_told(1)} as label, {_told(2)} as poor, cast({_told(3)} as int) as points, {_told(4)} as family from part")
def b35_label_terms(t: Tables):
    said = F.element_at(F.array(*[F.lit(r[0]) for r in _TERMS]), (F.col("p_partkey") % len(_TERMS) + 1).cast("int"))
    label = phrases.rewritten(said)
    return t.part.select("p_partkey", label.alias("label"), phrases.is_poor(label).alias("poor"), phrases.specificity(label).alias("points"), phrases.family(label).alias("family"))
