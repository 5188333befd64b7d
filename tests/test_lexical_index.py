"""The kept BM25 index gives the ranks of a full scan, reads only its words' buckets, and stops early."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical_index, retrieval


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, None if i == 7 else " ".join(rnd.choices(words, [1 / (k + 1) for k in range(300)], k=rnd.randint(1, 60)))) for i in range(1500)] + [(9000, "w1 " * 90), (9001, ""), (9002, "Größe w299 W299")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path_factory.mktemp("lexical"))
    lexical_index.append(docs.where("doc_id < 700"), path, "doc_id", "text", 0)
    lexical_index.append(docs.where("doc_id >= 700"), path, "doc_id", "text", 1)
    return docs, path


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_ranks_equal_a_full_scan(spark, indexed):
    docs, path = indexed
    queries = ask(spark, "w1 w250 w299", "w0", "größe", "w3 w3 w17 nothing", "nothing at all", "", "w0 w1 w2 w3 w4")
    for top in (1, 5, 40):
        want = sorted(map(tuple, retrieval.bm25(docs, "doc_id", "text", queries, top).select("query_id", "rank", "doc_id", "score").collect()))
        got = sorted(map(tuple, lexical_index.search(spark, path, queries, top, key="doc_id").select("query_id", "rank", "doc_id", "score").collect()))
        assert got == want


def test_fewer_words_read_fewer_files(spark, indexed):
    _, path = indexed
    parts = []
    for texts in (["w250"], ["w1 w2 w3 w4 w5 w6 w7 w8 w9"]):
        plan = lexical_index.asked_blocks(spark, path, ask(spark, *texts))._jdf.queryExecution().executedPlan().toString()
        parts.append(len(re.search(r"PartitionFilters: \[bucket#\d+ INSET ([\d, ]+)|PartitionFilters: \[(?:bucket#\d+ IN \()?([^\]]*)", plan)[0].split(",")))
    assert parts[0] < parts[1]


def test_blocks_that_cannot_matter_are_left(spark, tmp_path):
    """A rare word that decides, and a common one with thousands of postings: most blocks of the common word are not read."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("filler "), (F.col("id") % 50).cast("int")), F.lit("common "), F.when(F.col("id") % 500 == 3, "rare rare").otherwise("")).alias("text"))
    lexical_index.append(docs, str(tmp_path / "i"), "doc_id", "text", 0)
    queries = ask(spark, "rare common")
    blocks = lexical_index.asked_blocks(spark, str(tmp_path / "i"), queries)
    first = lexical_index._scores(blocks.where("block < 1")).orderBy(F.desc("score")).limit(10).agg(F.min("score").alias("bar")).first().bar
    whole = {r.term: r.best for r in blocks.groupBy("term").agg(F.max("most").alias("best")).collect()}
    limits = spark.createDataFrame([(0, t, sum(whole.values()) - b, first) for t, b in whole.items()], "query_id long, term string, others double, bar double")
    assert lexical_index.reachable(blocks, limits).count() <= blocks.count()
    got = [r.doc_id for r in lexical_index.search(spark, str(tmp_path / "i"), queries, 10, key="doc_id").orderBy("rank").collect()]
    want = [r.doc_id for r in retrieval.bm25(docs, "doc_id", "text", queries, 10).orderBy("rank").collect()]
    assert got == want


def test_a_segment_is_written_once(spark, indexed):
    docs, path = indexed
    with pytest.raises(Exception, match="exist"):
        lexical_index.append(docs, path, "doc_id", "text", 1)
