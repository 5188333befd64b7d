"""A corpus from raw documents to packed sequences.

Each stage takes the session, the documents that the stage before kept and the
folder of the other tables; all but the last return documents with the same
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontam, frames, lsh_forest, pii, quality, ss_packing
from corpusmill.llm.queries import tokenizer_file


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not neither toxic nor of low quality."""
    return quality.clean(docs, frames.load(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return lsh_forest.distinct(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or all of a shorter one)."""
    return decontam.clean(docs, frames.load(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return ss_packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]
ORACLE_SQL = None  # signatures, a fitted classifier and packing have no SQL form; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs, before = frames.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = frames.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            frames.delete(spark, before)  # what the stage has read
        docs, before = spark.read.parquet(path), path
    return docs
