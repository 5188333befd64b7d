"""Small cases with edges: nulls, ties, constant sets."""

import json

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators import retrieval, tables
from corpusmill.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


def test_normalize_text(spark):
    assert one(spark, text.normalize_text, "  a\n\t b ") == "a b"
    assert one(spark, text.normalize_text, None) == ""


def test_canonical_url(spark):
    assert one(spark, text.canonicalize_url, "HTTPS://Ex.Com/A/?b=2&a=1#f") == "https://ex.com/A?a=1&b=2"
    assert one(spark, text.canonicalize_url, None) is None


def test_doi_key(spark):
    assert one(spark, text.doi_key, "see https://doi.org/10.1000/AB.1.") == "10.1000/ab.1"
    assert one(spark, text.doi_key, "10.1000/a and 10.1000/b") is None
    assert one(spark, text.doi_key, "10.1000/a, 10.1000/a") == "10.1000/a"


def test_arxiv_key(spark):
    assert one(spark, text.arxiv_key, "https://arxiv.org/abs/2101.00001v3") == "2101.00001"
    assert one(spark, text.arxiv_key, "none") is None


def test_merge_unique(spark):
    assert one(spark, text.merge_unique, ["A", "b", "a", None, " ", "B", "c"], "array<string>") == ["A", "b", "c"]


def test_map_lookup(spark):
    assert one(spark, lambda c: text.map_lookup(c, "doi"), {"x": "1", "DOI": "10.1/a"}, "map<string,string>") == "10.1/a"


def test_abstract(spark):
    assert one(spark, text.abstract_of, {"b": [1, 3], "a": [0], "c": [2]}, "map<string,array<int>>") == "a b c b"


def test_in_domain(spark):
    host = lambda u: one(spark, lambda c: text.in_domain(text.url_host(c), ["github.com"]), u)
    assert host("https://www.github.com/a") and host("http://gist.github.com/") and not host("http://xgithub.com/") and not host(None)


def test_minmax_of_a_constant_set_is_one(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "q int, s double")
    got = sorted(df.select("q", scores.minmax(F.col("s"), scores.by_set("q")).alias("x")).collect())
    assert [tuple(r) for r in got] == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_f_beta(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.0, 0.0), (None, 1.0)], "p double, r double")
    assert [r.x for r in df.select(scores.f_beta(F.col("p"), F.col("r"), 1.0).alias("x")).collect()] == [0.666667, 0.0, None]


def test_metrics(spark):
    runs = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 5)], "query_id string, k string, rank int")
    qrels = spark.createDataFrame([("q", "d2", 1), ("q", "d4", 1)], "query_id string, k string, grade int")
    m = retrieval.metrics_at_k(runs, qrels, "k", 2).first()
    assert (m.precision, m.recall, m.reciprocal_rank) == (0.5, 0.5, 0.5)


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.7), (1, "b", "y", 0.1)], "g int, a string, b string, s double")
    rows = tables.greedy_pairs(df.withColumn("o", -F.col("s")), ["g"], "a", "b", ["o"]).collect()
    assert {(r.a, r.b) for r in rows} == {("a", "x"), ("b", "y")}


def test_upsert_keeps_other_columns(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k int, v string, w string")
    b = spark.createDataFrame([(2, "z", "r"), (3, "n", "s")], "k int, v string, w string")
    assert sorted(map(tuple, tables.upsert(a, b, "k", ["v"]).collect())) == [(1, "x", "p"), (2, "z", "q"), (3, "n", "s")]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    assert files.sniff_json(spark, str(p)) == "ndjson"
    q = tmp_path / "b.json"
    q.write_text('[{"a": 1}, {"a": 5}]')
    assert files.sniff_json(spark, str(q)) == "array"
    assert files.read_json_array(spark, str(q), "a int").agg(F.sum("a")).first()[0] == 6


def test_latest():
    assert files.latest(["x/documents.1.jsonl", "x/documents.3.new.jsonl", "x/documents.2.jsonl"]) == "x/documents.2.jsonl"


def test_feed_source(spark):
    spark.dataSource.register(files.FeedSource)
    df = spark.read.format("recorded_feed").option("pages", json.dumps([[{"id": 1}, {"id": 2}], None])).load()
    assert sorted((r.page, r.status) for r in df.collect()) == [(0, "found"), (0, "found"), (1, "error")]


def test_dataset_manifest(spark, tmp_path):
    df = spark.range(10).repartition(3)
    a = files.write_dataset(df, str(tmp_path / "a")).first()
    b = files.write_dataset(df.orderBy(F.desc("id")), str(tmp_path / "b")).first()
    assert a == b and a.rows == 10


def test_change_stream(spark, tmp_path):
    from corpusmill.streaming import changes

    src = tmp_path / "in"
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]]):
        spark.createDataFrame(pd.DataFrame(rows, columns=["key", "digest"])).coalesce(1).write.parquet(str(src / f"b{i}"))
        stream = changes.changes(changes.read_files(spark, f"{src}/*", "key long, digest string"))
        changes.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.key, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "new"), (1, "unchanged"), (2, "new"), (2, "updated"), (3, "new")]


def test_urls_lose_what_closes_them(spark):
    said = "(see https://a.org/x) “https://b.org/y}” «www.c.org/z»’ https://d.org/q?a=1;"
    assert spark.range(1).select(text.extract_urls(F.lit(said)).alias("u")).first().u == ["https://a.org/x", "https://b.org/y", "https://www.c.org/z", "https://d.org/q?a=1"]


def test_ngrams_cut_the_words_once(spark, capsys):
    """A long text's words were cut anew for each place of a run."""
    df = spark.createDataFrame([(0, None), (1, ""), (2, "one"), (3, "one two"), (4, "the one and two three two"), (5, " ".join(f"w{i:05d}" for i in range(20_000)))], "k int, c string")
    grams = df.select("k", text.ngrams(text.topic_tokens(F.col("c")), 2).alias("x"))
    grams.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1
    got = {r.k: r.x for r in grams.collect()}
    assert [got[k] for k in range(5)] == [[], [], [], ["one two"], ["one two", "two three", "three two"]]
    assert got[5] == [f"w{i:05d} w{i + 1:05d}" for i in range(19_999)]
    assert one(spark, lambda c: text.ngrams(F.split(c, " "), 3), "a b c d") == ["a b c", "b c d"]
    assert one(spark, lambda c: text.ngrams(F.split(c, " "), 1), "a b") == ["a", "b"]
