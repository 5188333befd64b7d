"""Versioned tables: a failing task leaves the old table whole; exports remap URLs and keep what is known."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_append_overwrite_and_old_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(5).selectExpr("id", "cast(id as string) as s", "array(id) as l"), path)
    versions.write(spark.range(5, 9).selectExpr("id", "cast(id as string) as s", "array(id) as l"), path)
    assert rows(versions.read(spark, path)) == [(i, str(i), [i]) for i in range(9)]
    versions.write(spark.range(2).selectExpr("id", "cast(null as string) as s", "array(id) as l"), path, overwrite=True)
    assert rows(versions.read(spark, path)) == [(0, None, [0]), (1, None, [1])]
    assert versions.read(spark, path, 2).count() == 9 and versions.versions(path) == [1, 2, 3]
    with pytest.raises(Exception, match="another schema"):
        versions.write(spark.range(2), path)
    with pytest.raises(FileNotFoundError):
        versions.manifest(path, 9)


def test_a_failing_task_leaves_the_table_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(50), path)
    staged = set(Path(path).rglob("*.*"))
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id"))
    for overwrite in (False, True):
        with pytest.raises(Exception, match="boom"):
            versions.write(bad, path, overwrite)
        assert versions.versions(path) == [1] and versions.read(spark, path).count() == 50
        versions.vacuum(path)  # what a task wrote that was killed after the others had been cleared away
        assert set(Path(path).rglob("*.*")) == staged
    versions.write(spark.range(7), path, overwrite=True)
    versions.vacuum(path, keep=1)
    assert versions.versions(path) == [2] and versions.read(spark, path).count() == 7 and not staged & set(Path(path).rglob("*.parquet"))


def test_a_write_that_was_overtaken_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(3), path)
    late = versions._Writer(path, spark.range(1).schema, False)
    versions.write(spark.range(3), path)
    with pytest.raises(RuntimeError, match="another write"):
        late.commit([])
    assert versions.read(spark, path).count() == 6


def test_a_changed_file_is_named(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(3).coalesce(1), path)
    name = json.loads(Path(path, "versions", "00000001.json").read_text())["files"][0]["name"]
    raw = bytearray(Path(path, name).read_bytes())
    raw[len(raw) // 2] ^= 1
    Path(path, name).write_bytes(raw)
    with pytest.raises(Exception, match="is not the file that was written"):
        versions.read(spark, path).collect()


def test_export_of_artifacts(spark, tmp_path):
    shape = "artifact_id string, normalized_url string, name string, stars int"
    seen = "observation_id string, artifact_id string"
    versions.export_artifacts(spark.createDataFrame([("a2", "u1", "first", 5), ("a9", None, None, None)], shape), spark.createDataFrame([("o1", "a2")], seen), str(tmp_path), "2024")
    fresh = spark.createDataFrame([("a1", "u1", None, 7), ("b2", "u2", "b", 1), ("b1", "u2", "b", None), ("a9", None, "nine", None)], shape)
    versions.export_artifacts(fresh, spark.createDataFrame([("o2", "a1"), ("o3", "b2"), ("o1", "a2")], seen), str(tmp_path), "2025")
    got = rows(versions.read(spark, f"{tmp_path}/entities").select("artifact_id", "normalized_url", "name", "stars", "first_seen_at", "last_seen_at"))
    assert got == [("a2", "u1", "first", 7, "2024", "2025"), ("a9", None, "nine", None, "2024", "2025"), ("b1", "u2", "b", 1, "2025", "2025")]
    got = rows(versions.read(spark, f"{tmp_path}/observations").select("observation_id", "artifact_id", "first_seen_at"))
    assert got == [("o1", "a2", "2024"), ("o2", "a2", "2025"), ("o3", "b1", "2025")]
