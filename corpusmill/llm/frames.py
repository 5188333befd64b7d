"""DataFrame helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of keys is broadcast up to so many rows of 8 bytes; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: An order is cut into no more parts than these; larger parts stream through a sort that can spill.
MOST_BUCKETS = 20_000
_OWN: dict[str, SparkSession] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they start: Spark's file server hands them a copy."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_has_corpusmill", False) or not package.is_dir():
        return
    d = tempfile.mkdtemp(prefix=f"{package.name}-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(d, package.name), "zip", package.parent, package.name))
    sc._has_corpusmill = True


def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Rows and bytes of an Arrow batch: texts can be long, and a worker holds a batch at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one where none is set and all tasks run in this process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver ends, if not before."""
    if not _OWN:
        atexit.register(_sweep)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _OWN[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder: later jobs survive lost executors without computing them anew."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()  # lets Spark delete the shuffle files of the plan that has been written
    return out


def release(df: DataFrame) -> None:
    """Deletes what cut() wrote, when no later step reads it."""
    delete(df.sparkSession, df.cut_path)


def delete(spark: SparkSession, path: str) -> None:
    _OWN.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in list(_OWN.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            delete(spark, path)


def fetch(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table of bounded size as arrays on the driver, without a row object for each row."""
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int) -> DataFrame:
    """Left-semi join that broadcasts the keys if they are few; otherwise it shuffles."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on, "left_semi")


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def order_bucket(src: DataFrame, parts: int, pos: str = "pos") -> Column:
    """The number of (approximate) quantiles not above a numeric column, found by binary search."""
    cuts = sorted(set(src.select(F.col(pos).cast("double").alias("p")).approxQuantile("p", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if not cuts:
        return F.lit(0)
    where = "array(" + ",".join(f"{x!r}D" for x in cuts) + ")"
    steps = f"sequence({len(cuts).bit_length() - 1}, 0, -1)"
    return F.expr(f"aggregate({steps}, 0, (a, k) -> if(a + shiftleft(1, k) <= {len(cuts)} and get({where}, a + shiftleft(1, k) - 1) <= cast({pos} as double), a + shiftleft(1, k), a))")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps; O(log^2 n) rounds, no list of
    a node's neighbours is ever gathered in one row.
    """
    spark = edges.sparkSession
    cur = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        was, cur = cur, cut(small.where("u <> v").distinct())
        release(was)
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
