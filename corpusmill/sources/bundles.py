"""Dense bundles (.npy matrices with ids and metadata), and manifests of files by SHA-256."""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill import storage

#: Bytes of a matrix that a task reads, and that it holds at a time.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
MAGIC = b"\x93NUMPY"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def header(path: str) -> tuple[np.dtype, int, int, int]:
    """dtype, rows, columns and where the rows begin, of a two-dimensional .npy in row order."""
    files, at = _open(path)
    with files.open_input_file(at) as f:
        start = f.read(12)
        if start[:6] != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        wide = start[6] >= 2
        size, first = (struct.unpack("<I", start[8:12])[0], 12) if wide else (struct.unpack("<H", start[8:10])[0], 10)
        f.seek(first)
        told = ast.literal_eval(f.read(size).decode("latin1"))
        length = f.size()
    kind, shape = np.dtype(told["descr"]), told["shape"]
    if len(shape) != 2 or told["fortran_order"] or kind.kind not in "fiu":
        raise ValueError(f"{path} holds no matrix of numbers in row order: {told}")
    if length != first + size + kind.itemsize * shape[0] * shape[1]:
        raise ValueError(f"{path} has {length} bytes, its header tells {first + size + kind.itemsize * shape[0] * shape[1]}")
    return kind, shape[0], shape[1], first + size


def shards(path: str) -> list[str]:
    """A file, or the .npy files of a folder by name: one matrix, cut between rows."""
    files, at = _open(path)
    if files.get_file_info(at).type == fs.FileType.File:
        return [path]
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda f: f.base_name) if f.base_name.endswith(".npy")]


class NpyMatrix(DataSource):
    """Options: path (a file, or a folder of shards), part_bytes. A partition is a range of rows; position counts over all shards."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "position long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.parts, first = [], 0
        width = None
        for name in shards(path):
            kind, n, columns, offset = header(name)
            if width not in (None, columns):
                raise ValueError(f"{name} has {columns} columns, the shards before it {width}")
            width = columns
            rows = max(1, part_bytes // max(1, kind.itemsize * columns))
            self.parts += [(name, kind.str, columns, offset, a, min(a + rows, n), first) for a in range(0, n, rows)]
            first += n

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, kind, columns, offset, a, z, first = partition.value
        kind = np.dtype(kind)
        width = kind.itemsize * columns
        step = max(1, BATCH_BYTES // max(1, width))
        files, at = _open(name)
        with files.open_input_file(at) as f:
            for i in range(a, z, step):
                j = min(i + step, z)
                f.seek(offset + i * width)
                flat = np.frombuffer(f.read((j - i) * width), dtype=kind).astype(np.float32)
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + i, first + j)), pa.ListArray.from_arrays(ends, pa.array(flat))], ["position", "vector"])


def read_matrix(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    storage.ship(spark)
    spark.dataSource.register(NpyMatrix)
    return spark.read.format("npy_matrix").option("path", path).option("part_bytes", str(part_bytes)).load()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(position, id): of a JSON array of ids, of JSON lines with position and id, or of Parquet with these columns."""
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("ids"))
        return text.select(F.posexplode("ids").alias("position", "id")).select(F.col("position").cast("long").alias("position"), "id")
    rows = spark.read.schema("position long, id string").json(path) if path.endswith(".jsonl") else spark.read.parquet(path)
    return rows.select(F.col("position").cast("long").alias("position"), F.col("id").cast("string").alias("id"))


def read_bundle(spark: SparkSession, vectors: str, ids: str, meta: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(position, id, vector): as many ids as rows, none empty; else the ids of row-level metadata (JSON lines with canonical_id, doc_id or id), if they fit.

    Counts come from headers and from the id tables; the matrix is read once, by the join.
    """
    n = sum(header(name)[1] for name in shards(vectors))
    found = read_ids(spark, ids)
    state = lambda df: df.agg(F.count(F.lit(1)), F.countDistinct("position"), F.min("position"), F.max("position"), F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "")).first()
    fits = lambda s: s[0] == s[1] == n and (not n or (s[2], s[3]) == (0, n - 1))
    got = state(found)
    if not fits(got) and meta:
        rows = spark.read.schema("position long, canonical_id string, doc_id string, id string").json(meta)
        other = rows.select("position", F.coalesce("canonical_id", "doc_id", "id").alias("id"))
        told = state(other)
        if fits(told) and not told[4]:
            found, got = other, told
    if not fits(got):
        raise ValueError(f"the bundle's shapes differ: {n} rows in {vectors}, {got[0]} ids at {got[1]} positions in {ids}")
    return read_matrix(spark, vectors, part_bytes).join(found, "position").select("position", "id", "vector")


def write_bundle(df: DataFrame, path: str, id: str, vector: str, per_shard: int = 100_000, meta: dict | None = None) -> None:
    """vectors/ (shards of .npy), ids (Parquet with position and id) and meta.json; rows in order of id, each shard written by one task."""
    spark = df.sparkSession
    storage.ship(spark)
    kept = storage.cut(df.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")), "bundle")
    n, width, other = kept.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.min(F.size("vector"))).first()
    if n and (width != other or width < 1):
        raise ValueError(f"vectors have {other} to {width} components")
    parts = max(1, -(-n // per_shard))
    dealt = storage.cut(kept.repartitionByRange(parts, "id").sortWithinPartitions("id").select(F.spark_partition_id().alias("shard"), "id", "vector"), "bundle")
    sizes = sorted((r.shard, r["count"]) for r in dealt.groupBy("shard").count().collect())  # a row for each shard
    first, at = {}, 0
    for shard, count in sizes:
        first[shard], at = at, at + count
    counts = dict(sizes)

    def shard_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        shard = rows.column("shard")[0].as_py()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(counts[shard], width)
        files, where = _open(f"{path}/vectors")
        files.create_dir(where, recursive=True)
        task = TaskContext.get()
        draft = f"{where}/.{shard}-{task.taskAttemptId() if task else 0}"
        with files.open_output_stream(draft) as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": flat.shape})
            f.write(flat.tobytes())
        files.move(draft, f"{where}/part-{shard:06d}.npy")
        return pa.table({"position": pa.array(np.arange(first[shard], first[shard] + counts[shard])), "id": rows.column("id")})

    ids = dealt.groupBy("shard").applyInArrow(shard_of, "position long, id string")
    ids.write.mode("errorifexists").parquet(f"{path}/ids")
    files, where = _open(f"{path}/meta.json")
    with files.open_output_stream(where) as f:
        f.write(json.dumps({"rows": n, "columns": width, **(meta or {})}).encode())
    storage.release(kept)
    storage.release(dealt)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files below a folder; each is read by one task, none by the driver."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").split("://")[-1]
    return rows.select(F.substring_index(F.col("path"), base + "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, manifest: str) -> None:
    """The digests of a folder's files as JSON lines in another folder."""
    file_digests(spark, path).coalesce(1).write.mode("errorifexists").json(manifest)


def verify(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """(name, fault): files that are missing, changed or not in the manifest; no rows if all is as it was written."""
    told = spark.read.schema("name string, bytes long, sha256 string").json(manifest).select("name", F.col("sha256").alias("_told"))
    both = file_digests(spark, path).join(told, "name", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("_told").isNull(), "unknown").when(F.col("sha256") != F.col("_told"), "changed")
    return both.select("name", fault.alias("fault")).where("fault is not null")


def read_verified(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """A Parquet dataset whose files are those of its manifest; else an error that names the first that aren't."""
    wrong = verify(spark, path, manifest).orderBy("name").limit(10).collect()
    if wrong:
        raise ValueError("files differ from the manifest: " + ", ".join(f"{r.name} ({r.fault})" for r in wrong))
    return spark.read.parquet(path)
