"""Incremental change detection as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream; offsets are kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest_only(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key hasn't come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def changes(stream: DataFrame, key: str = "key", digest: str = "digest") -> DataFrame:
    """(key, digest, change): new, updated or unchanged against the digest last seen for the key; keyed state."""

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for frame in frames:
            for d in frame[digest]:
                rows.append((k[0], d, "new" if last is None else "unchanged" if d == last else "updated"))
                last = d
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["key", "digest", "change"])

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(digest).cast("string").alias("digest"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, digest string, change string", "digest string", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that is there, batch by batch, into Parquet, and stops."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """An extension: counts by tumbling window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
