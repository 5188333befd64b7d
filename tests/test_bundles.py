"""Matrices by row ranges, bundles whose shapes are checked, manifests that name a changed byte, mini-batch k-means."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import kmeans
from corpusmill.sources import bundles


def test_a_matrix_is_read_by_row_ranges(spark, tmp_path):
    x = np.arange(600, dtype=np.float32).reshape(100, 6)
    np.save(tmp_path / "x.npy", x)
    df = bundles.read_matrix(spark, str(tmp_path / "x.npy"), part_bytes=240)
    assert df.rdd.getNumPartitions() == 10
    assert [r.vector for r in df.orderBy("position").collect()] == x.tolist()
    for bad in (np.arange(6), np.asfortranarray(np.ones((2, 3)))):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(ValueError, match="no matrix"):
            bundles.header(str(tmp_path / "bad.npy"))
    os.truncate(tmp_path / "x.npy", 2000)
    with pytest.raises(ValueError, match="header tells"):
        bundles.header(str(tmp_path / "x.npy"))


def test_bundles_by_position(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.eye(4))
    (tmp_path / "ids.json").write_text(json.dumps(["a", "b", "c", "d"], indent=2))
    (tmp_path / "short.json").write_text(json.dumps(["a", "b"]))
    (tmp_path / "meta.jsonl").write_text("\n".join(json.dumps({"position": i, "doc_id": f"m{i}"}) for i in range(4)))
    got = {r.id: r.vector for r in bundles.read_bundle(spark, str(tmp_path / "x.npy"), str(tmp_path / "ids.json")).collect()}
    assert got == {c: np.eye(4)[i].tolist() for i, c in enumerate("abcd")}
    with pytest.raises(ValueError, match="4 rows.* 2 ids"):
        bundles.read_bundle(spark, str(tmp_path / "x.npy"), str(tmp_path / "short.json"))
    assert sorted(r.id for r in bundles.read_bundle(spark, str(tmp_path / "x.npy"), str(tmp_path / "short.json"), str(tmp_path / "meta.jsonl")).collect()) == ["m0", "m1", "m2", "m3"]


def test_a_bundle_written_in_shards(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(250).select(F.format_string("k%03d", "id").alias("id"), F.array(F.col("id").cast("float"), F.lit(0.5)).alias("v"))
    bundles.write_bundle(df.repartition(7), path, "id", "v", per_shard=60, meta={"model": "m"})
    assert len(list(Path(path, "vectors").glob("*.npy"))) > 2
    whole = np.concatenate([np.load(p) for p in sorted(Path(path, "vectors").glob("part*.npy"))])
    assert whole.shape == (250, 2)
    got = {r.id: r.vector for r in bundles.read_bundle(spark, f"{path}/vectors", f"{path}/ids", part_bytes=64).collect()}
    assert got == {f"k{i:03d}": [float(i), 0.5] for i in range(250)}
    assert json.loads(Path(path, "meta.json").read_text()) == {"rows": 250, "columns": 2, "model": "m"}
    with pytest.raises(ValueError, match="1 to 2 components"):
        bundles.write_bundle(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, v array<double>"), str(tmp_path / "c"), "id", "v")


def test_a_changed_byte_is_found_and_named(spark, tmp_path):
    data, told = str(tmp_path / "data"), str(tmp_path / "manifest")
    spark.range(100).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(data)
    bundles.write_manifest(spark, data, told)
    assert bundles.read_verified(spark, data, told).count() == 100
    victim = sorted(Path(data).rglob("*.parquet"))[0]
    raw = bytearray(victim.read_bytes())
    raw[40] ^= 1
    victim.write_bytes(raw)
    victim.with_name(f".{victim.name}.crc").unlink()  # only local folders have these
    extra = victim.with_name("extra.parquet")
    extra.write_bytes(b"x")
    rows = {r.name.rsplit("/", 1)[-1]: r.fault for r in bundles.verify(spark, data, told).collect()}
    assert rows == {victim.name: "changed", "extra.parquet": "unknown"}
    with pytest.raises(ValueError, match=victim.name):
        bundles.read_verified(spark, data, told)
    victim.unlink()
    assert {r.fault for r in bundles.verify(spark, data, told).collect()} == {"missing", "unknown"}


def test_mini_batch_k_means(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 8)) * 6
    x = np.concatenate([m + rng.normal(size=(150, 8)) for m in middle])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [None] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = [kmeans.fit(df.repartition(n), "id", "v", 6, batches=3, epochs=2) for n in (1, 7)]
    assert np.array_equal(found[0], found[1])
    centres = x[:: len(x) // 6][:6]
    for _ in range(50):
        at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(6)])
    full = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()
    assert kmeans.inertia(df, "id", "v", found[0]) <= 1.05 * full
    assert kmeans.assign(df, "id", "v", found[0]).count() == 900
    assert kmeans.fit(df.where("id > 9000"), "id", "v", 3, batches=2, epochs=1).shape == (0, 0)
    assert len(kmeans.fit(df.where("id < 2"), "id", "v", 5, batches=2, epochs=1)) == 2
