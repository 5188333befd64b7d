"""File sources and sinks: JSON lines, JSON arrays, XML, Parquet with a manifest, and a poll-based feed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file (gzip too); strict: a malformed line fails the read, else it goes to _corrupt_record."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sniff_json(spark: SparkSession, path: str, sample: int = 65_536) -> str:
    """empty, array or ndjson, from the start of the first file."""
    head = spark.read.text(path, wholetext=False).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).where("c <> ''").limit(1).collect()
    return "empty" if not head else "array" if head[0].c == "[" else "ndjson"


def write_jsonl(df: DataFrame, path: str, split_by: str | None = None) -> None:
    """One write; a folder for each value of split_by (new, updated, unchanged)."""
    (df.write.partitionBy(split_by) if split_by else df.write).mode("overwrite").json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def latest(paths: list[str], kind: str = "documents") -> str | None:
    """The last primary snapshot by name; change files are not primary."""
    own = [p for p in paths if (name := p.rsplit("/", 1)[-1]).startswith(f"{kind}.") and name.endswith(".jsonl") and not any(x in name for x in (".new.", ".updated.", ".unchanged."))]
    return max(own, default=None, key=lambda p: p.rsplit("/", 1)[-1])


def write_dataset(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Parquet, and a manifest row: rows, columns and a digest that doesn't depend on row order."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).cast("string").alias("digest"))


class FeedSource(DataSource):
    """Recorded pages of a feed as a batch source: option pages is a JSON list of lists of records; a page is a partition.

    A page that is null stands for a failed fetch: it becomes a row with the status error, never an exception.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_feed"

    def schema(self) -> str:
        return "page int, status string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(json.loads(self.options["pages"]))


class _FeedReader(DataSourceReader):
    def __init__(self, pages: list):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.pages))]

    def read(self, partition: InputPartition):
        page = self.pages[partition.value]
        if page is None:
            yield (partition.value, "error", None)
        else:
            for record in page:
                yield (partition.value, "found", json.dumps(record, sort_keys=True))
