"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they start: Spark's file server hands them a copy."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, f"_has_{package.name}", False) or not package.is_dir():
        return
    d = tempfile.mkdtemp(prefix=f"{package.name}-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(d, package.name), "zip", package.parent, package.name))
    setattr(sc, f"_has_{package.name}", True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all tasks run in this process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own; what is written there goes when the driver ends, if not before."""
    if not _OWN:
        atexit.register(_sweep)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _OWN[path] = spark
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    _OWN.pop(path, None)
    files, at = filesystem(spark, path)
    files.delete(at, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows, computed once and written; later jobs read them and survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what cut() wrote, when no later step reads it."""
    delete(df.sparkSession, df.cut_path)


def _sweep() -> None:
    for path, spark in list(_OWN.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            delete(spark, path)
