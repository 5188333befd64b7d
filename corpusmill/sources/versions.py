"""Tables with versions: a data source whose writers stage files and whose commit is one rename.

Layout: data/<write>/<file>.parquet, and versions/<number>.json with the files of the table in that version (name, rows,
bytes and SHA-256 of each). A write stages its own files; only its commit makes a new version, from the files of the last
one (append) or without them (overwrite: truncate and load). A write that fails deletes what it staged (a task that is
killed later may leave a file that no version names; ``vacuum`` removes it) and the table stays as it was; readers hold on to the version they began with. Two writes that commit at once cannot both take a number: the
second fails.

Folders are reached through pyarrow's file systems, from the driver and from every executor alike.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusmill import storage

#: Bytes of rows that a task puts into one file.
FILE_BYTES = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def versions(path: str) -> list[int]:
    files, at = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{at}/versions", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.removesuffix(".json").isdigit())


def manifest(path: str, version: int | None = None) -> dict:
    """schema and files of a version, the last one if none is named."""
    known = versions(path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a table in {path}")
    files, at = _open(path)
    with files.open_input_stream(f"{at}/versions/{known[-1] if version is None else version:08d}.json") as f:
        return json.loads(f.read())


def _shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


@dataclass
class Staged(WriterCommitMessage):
    files: list


class VersionedTable(DataSource):
    """Options: path; for reading, version."""

    @classmethod
    def name(cls) -> str:
        return "versioned_table"

    def schema(self) -> StructType:
        return StructType.fromJson(manifest(self.options["path"], self._version())["schema"])

    def _version(self) -> int | None:
        return int(self.options["version"]) if "version" in self.options else None

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], manifest(self.options["path"], self._version()), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, told: dict, schema: StructType):
        self.path, self.files, self.columns = path, told["files"], schema.names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, at = _open(self.path)
        raw = files.open_input_file(f"{at}/{partition.value['name']}").read()
        if hashlib.sha256(raw).hexdigest() != partition.value["sha256"]:
            raise ValueError(f"{partition.value['name']} is not the file that was written")
        yield from pq.ParquetFile(BytesIO(raw)).iter_batches(columns=self.columns)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.own = f"data/{uuid.uuid4().hex}"
        known = versions(path)
        self.base = known[-1] if known else 0
        if known and not overwrite and _shape(StructType.fromJson(manifest(path, self.base)["schema"])) != _shape(schema):
            raise ValueError("rows to append have another schema than the table")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, at = _open(self.path)
        files.create_dir(f"{at}/{self.own}", recursive=True)
        shape = to_arrow_schema(self.schema)
        done, held, size = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held).cast(shape)
            out = BytesIO()
            pq.write_table(table, out, compression="zstd")
            raw, name = out.getvalue(), f"{self.own}/{uuid.uuid4().hex}.parquet"
            with files.open_output_stream(f"{at}/{name}") as f:
                f.write(raw)
            done.append({"name": name, "rows": table.num_rows, "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()})
            held.clear()

        for batch in iterator:
            held.append(batch)
            size += batch.nbytes
            if size >= FILE_BYTES:
                flush()
                size = 0
        if held:
            flush()
        return Staged(done)

    def commit(self, messages: list[Staged]) -> None:
        files, at = _open(self.path)
        before = [] if self.overwrite or not self.base else manifest(self.path, self.base)["files"]
        told = {"schema": json.loads(self.schema.json()), "files": before + [f for m in messages if m for f in m.files]}
        known = versions(self.path)
        if (known[-1] if known else 0) != self.base:
            raise RuntimeError("another write has made a version since this one began")
        files.create_dir(f"{at}/versions", recursive=True)
        draft = f"{at}/{self.own}.json"
        files.create_dir(f"{at}/data", recursive=True)
        with files.open_output_stream(draft) as f:
            f.write(json.dumps(told).encode())
        files.move(draft, f"{at}/versions/{self.base + 1:08d}.json")

    def abort(self, messages: list[Staged]) -> None:
        files, at = _open(self.path)
        if files.get_file_info(f"{at}/{self.own}").type != fs.FileType.NotFound:
            files.delete_dir(f"{at}/{self.own}")  # with what tasks left that never reported


def write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    storage.ship(df.sparkSession)
    df.sparkSession.dataSource.register(VersionedTable)
    df.write.format("versioned_table").mode("overwrite" if overwrite else "append").option("path", path).save()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    storage.ship(spark)
    spark.dataSource.register(VersionedTable)
    reader = spark.read.format("versioned_table").option("path", path)
    return (reader if version is None else reader.option("version", str(version))).load()


def vacuum(path: str, keep: int | None = None) -> None:
    """Deletes versions but the last ``keep`` (all stay if none is given), and files that no version names; not while a write goes on."""
    files, at = _open(path)
    known = versions(path)
    for v in known[: max(0, len(known) - keep)] if keep else []:
        files.delete_file(f"{at}/versions/{v:08d}.json")
    named = {f["name"] for v in versions(path) for f in manifest(path, v)["files"]}
    for f in files.get_file_info(fs.FileSelector(f"{at}/data", recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and f.path.split(f"{at}/", 1)[-1] not in named:
            files.delete_file(f.path)


def remap_collisions(entities: DataFrame, observations: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and observations in which one normalized_url has one artifact_id: the known table's, else the smallest.

    Entities without a URL keep their id.
    """
    url = F.col("normalized_url")
    ids = entities.where(url.isNotNull()).select("normalized_url", "artifact_id", F.lit(1).alias("_new"))
    if known is not None:
        ids = ids.unionByName(known.where(url.isNotNull()).select("normalized_url", "artifact_id", F.lit(0).alias("_new")))
    keep = ids.groupBy("normalized_url").agg(F.min(F.struct("_new", "artifact_id")).alias("x")).select("normalized_url", F.col("x.artifact_id").alias("_keep"))
    moved = ids.where("_new = 1").join(keep, "normalized_url").where("artifact_id <> _keep").select("artifact_id", "_keep").distinct()

    def remapped(df: DataFrame) -> DataFrame:
        return df.join(moved, "artifact_id", "left").withColumn("artifact_id", F.coalesce("_keep", "artifact_id")).drop("_keep").select(*df.columns)

    return remapped(entities), remapped(observations)


def upserted(known: DataFrame | None, fresh: DataFrame, key: str, now: str, fill: list[str]) -> DataFrame:
    """Rows of both with first_seen_at and last_seen_at; of a known row, new values replace the old, but for ``fill`` only where they are not null.

    Of repeated fresh keys the last (by all columns, in order) counts.
    """
    values = [c for c in fresh.columns if c != key]
    one = fresh.groupBy(key).agg(F.max(F.struct(*values)).alias("x")).select(key, "x.*").alias("b")
    if known is None:
        return one.select(key, *values, F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at"))
    a, there = known.alias("a"), F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if c in fill else F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    both = a.join(one, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return both.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[pick(c).alias(c) for c in values], F.coalesce("a.first_seen_at", F.lit(now)).alias("first_seen_at"), F.when(there, F.lit(now)).otherwise(F.col("a.last_seen_at")).alias("last_seen_at"))


#: Columns of an artifact that a later export without a value leaves as they are.
FILLED = ["name", "owner", "title", "description", "license", "stars", "forks", "downloads", "likes", "fetched_at", "created_at", "updated_at"]


def export_artifacts(entities: DataFrame, observations: DataFrame, path: str, now: str) -> None:
    """Entities and observations into two versioned tables; URLs that collide are remapped before anything is committed."""
    spark = entities.sparkSession
    old = {t: read(spark, f"{path}/{t}") if versions(f"{path}/{t}") else None for t in ("entities", "observations")}
    entities, observations = remap_collisions(entities, observations, old["entities"])
    for name, rows, key in (("entities", entities, "artifact_id"), ("observations", observations, "observation_id")):
        write(upserted(old[name], rows, key, now, [c for c in FILLED if c in rows.columns]), f"{path}/{name}", overwrite=True)
