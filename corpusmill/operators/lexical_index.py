"""A kept BM25 index: postings in buckets of terms, blocks with maxima, early stop, segments that documents are appended to.

Layout below a folder, each table partitioned by segment (one for each append) and, where it has terms, by bucket:

* postings: term, shard, block, keys, tfs, lens, n, max_tf, min_len. A shard holds at most about ``SHARD`` documents of
  the segment, so no term has more postings than that in one sorted group; within a shard the postings are ordered by
  impact and cut into blocks of ``BLOCK``.
* terms: term, df.
* lengths: key, len.

A search reads the buckets of its words only (pruned when the plan is made). First come the leading blocks: the k-th best
of the sums they give is a score that the k-th best document surely reaches. Then those blocks are read in which
a document could still reach it: what the block's maxima allow, plus the best that the query's other words have anywhere.
All postings of a document that can be among the best are read, so ranks equal those of a full scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill import storage
from corpusmill.functions import text
from corpusmill.operators.retrieval import K1, B
from corpusmill.operators.tables import small

BUCKETS, BLOCK, SHARD = 64, 128, 100_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def append(docs: DataFrame, path: str, key: str, column: str, segment: int, buckets: int = BUCKETS) -> None:
    """Indexes documents as one more segment; what is there stays as it is. Keys must be new."""
    split = docs.select(F.col(key).alias("key"), text.tokens(F.coalesce(column, F.lit(""))).alias("words"))
    lens = split.select("key", F.size("words").alias("len"))
    lens.write.mode("errorifexists").parquet(f"{path}/lengths/segment={segment}")
    n = docs.sparkSession.read.parquet(f"{path}/lengths/segment={segment}").count()
    rows = split.select("key", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("key", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(1, -(-n // SHARD)))).cast("int"))
    dealt = rows.repartition("bucket", "shard")
    order = Window.partitionBy("bucket", "shard", "term").orderBy(F.desc(F.col("tf") / (F.col("tf") + F.lit(K1) * F.col("len") / 100)), "key")
    blocks = dealt.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int")).groupBy("bucket", "shard", "term", "block")
    lists = F.array_sort(F.collect_list(F.struct("key", "tf", "len")))  # at most BLOCK entries
    made = blocks.agg(lists.alias("x"), F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
    made = made.select("bucket", "term", "shard", "block", F.col("x.key").alias("keys"), F.col("x.tf").alias("tfs"), F.col("x.len").alias("lens"), "n", "max_tf", "min_len").sortWithinPartitions("bucket", "term", "block")
    made.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    kept = docs.sparkSession.read.parquet(f"{path}/postings/segment={segment}")
    kept.groupBy("bucket", "term").agg(F.sum("n").alias("df")).write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/terms/segment={segment}")


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, terms, lengths."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "lengths"))


def _part(tf: Column, length: Column) -> Column:
    """A word's share in a document's score, for the word's weight and the mean length in columns."""
    return F.col("idf") * F.col("times") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg")))


def _scores(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("query_id", "idf", "times", "avg", F.inline(F.arrays_zip("keys", "tfs", "lens")))
    return rows.groupBy("query_id", F.col("keys").alias("key")).agg(F.sum(_part(F.col("tfs"), F.col("lens"))).alias("score"))


def asked_blocks(spark: SparkSession, path: str, queries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The blocks of the queries' words with what each needs for its score; reads only these words' buckets."""
    postings, terms, lengths = tables(spark, path)
    words = queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    words = storage.cut(words.withColumn("bucket", _bucket(F.col("term"), buckets)), "asked")
    at = [r.bucket for r in words.select("bucket").distinct().collect()]  # at most as many as there are buckets
    size = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg"))
    df = terms.where(F.col("bucket").isin(at)).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    known = words.join(df, ["bucket", "term"]).join(F.broadcast(size))  # one row
    known = known.withColumn("idf", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("query_id", "bucket", "term", "times", "idf", "avg")
    blocks = postings.where(F.col("bucket").isin(at)).join(small(known), ["bucket", "term"])
    return blocks.withColumn("most", _part(F.col("max_tf"), F.col("min_len")))


def search(spark: SparkSession, path: str, queries: DataFrame, top: int, buckets: int = BUCKETS, key: str = "key", lead: int = 1) -> DataFrame:
    """(query_id, key, score, rank) as bm25 gives it. queries: query_id, query; lead: blocks of each word and shard that are read first."""
    blocks = asked_blocks(spark, path, queries, buckets)
    first = _scores(blocks.where(F.col("block") < lead))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bar = first.withColumn("n", F.row_number().over(w)).where(F.col("n") == top).select("query_id", F.col("score").alias("bar"))
    best = blocks.groupBy("query_id", "term").agg(F.max("most").alias("best"))
    whole = best.groupBy("query_id").agg(F.sum("best").alias("whole"))
    limits = storage.cut(best.join(whole, "query_id").join(bar, "query_id", "left").select("query_id", "term", (F.col("whole") - F.col("best")).alias("others"), "bar"), "limits")
    live = reachable(blocks, limits)
    hit = _scores(live).select("query_id", F.col("key").alias(key), "score")
    lengths = tables(spark, path)[2]
    fill = queries.select("query_id").join(F.broadcast(lengths.select(F.col("key").alias(key)).orderBy(key).limit(top)))  # top rows
    fill = fill.join(hit.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return hit.unionByName(fill.select("query_id", key, "score")).withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def reachable(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Blocks in which a document can reach the bar (a margin keeps scores that rounding makes equal)."""
    rows = blocks.join(small(limits), ["query_id", "term"])
    return rows.where(F.col("bar").isNull() | (F.col("most") + F.col("others") >= F.col("bar") - 2e-6))
