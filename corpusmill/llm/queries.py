"""Queries of the training-data operators: thin views that derive digest columns from their operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import alignment, bpe, decontam, lsh_forest, merkle, pii, pst, quality, rans, ring, ss_packing, suffix_dedup, vector_codes
from corpusmill.llm.frames import load


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; it lies in the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_documents(spark, sf_dir), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op3_pst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(_documents(spark, sf_dir))


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_documents(spark, sf_dir), size=4, percent=80)


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(_documents(spark, sf_dir))


def op6_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(_documents(spark, sf_dir), shards=40)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, load(spark, sf_dir, "labels")).drop("text_hash")


def op8_ss_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss_packing.pack(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2, capacity=4096).drop("ids")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_documents(spark, sf_dir), load(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.new_path(spark)
    rans.write_ids(_documents(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return rans.read_ids(spark, path).drop("ids")


def op11_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), parts=8, entries=16, rounds=6)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def _lloyd_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op12 as one query, a step for each; vectors of parts x width components."""
    span = lambda v: f"list_transform(range({parts}), lambda p: {v}[p * {width} + 1 : (p + 1) * {width}])"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        f"cut AS (SELECT vec_id, label, unnest(range({parts})) AS part, unnest({span('v')}) AS x FROM kept)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries})",
        "book0 AS (SELECT part, entry, x AS c FROM cut JOIN first USING (vec_id))",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT part, vec_id, any_value(label) AS label, any_value(x) AS x, min({{'d': {far}::BIGINT, 'entry': entry}}) AS best FROM cut JOIN book{k} USING (part) GROUP BY part, vec_id)")
        if k < rounds:
            mean = ", ".join(f"floor(sum(x[{i + 1}]) / count(*))::BIGINT" for i in range(width))
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT part, best.entry AS entry, [{mean}] AS c FROM near{k} GROUP BY ALL) m USING (part, entry))")
    last = f"near{rounds}"
    steps += [
        f"done AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(hex(best.entry), 2, '0')), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM {last} GROUP BY vec_id)",
        f"said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM done, said"


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pii": op2_pii,
    "op3_pst": op3_pst,
    "op4_lsh_forest": op4_lsh_forest,
    "op5_merkle": op5_merkle,
    "op6_ring": op6_ring,
    "op7_quality": op7_quality,
    "op8_ss_packing": op8_ss_packing,
    "op9_decontam": op9_decontam,
    "op10_rans": op10_rans,
    "op11_pair_index": op11_pair_index,
    "op12_vector_codes": op12_vector_codes,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {"op12_vector_codes": _lloyd_sql()}
