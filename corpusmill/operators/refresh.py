"""A staged refresh: stages run when their inputs have changed, gates decide, one switch shows the result.

Every stage writes a table into a folder named by its digest: of its name, its version, and the digests of what it reads
(for a source: of its files' names, sizes and times). A folder that is complete (it has _SUCCESS) is used as it
is, so a run that was killed resumes at the first stage that isn't there, and a changed input runs again only what
depends on it. Gates are counts of violations over a stage's result; a gate that fails ends the run. The published state
is one small file that names the folders of a run's stages; it is replaced in one rename after all gates have passed, so
readers see the whole of one run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusmill.storage import filesystem

Tables = dict[str, DataFrame]


@dataclass
class Stage:
    """run(tables) gives the result from the tables named by ``reads`` (stages before, or sources); gates: names and counts of violations."""

    name: str
    reads: list[str]
    run: Callable[[Tables], DataFrame]
    version: str = "1"
    gates: dict[str, Callable[[DataFrame, Tables], int]] = field(default_factory=dict)


class GateFailed(RuntimeError):  # noqa: N818  names what happened
    pass


def _digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def source_digest(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of a source's files."""
    files, at = filesystem(spark, path)
    found, listed = files.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if not name.startswith((".", "_")):
            listed.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return _digest(*sorted(listed))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A draft, then a rename over what is there."""
    files, at = filesystem(spark, path)
    draft = filesystem(spark, f"{path}.draft")[1]
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(draft, at, options)


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Folders of the published stages; empty before the first publication."""
    files, at = filesystem(spark, f"{root}/published.json")
    if not files.exists(at):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/published.json").collect()))


def read(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(published(spark, root)[stage])


def refresh(spark: SparkSession, root: str, sources: dict[str, str], stages: list[Stage], publish: bool = True) -> list[tuple[str, str]]:
    """(stage, kept or run) of a run over Parquet sources; publishes its folders if all gates hold."""
    digests = {name: source_digest(spark, path) for name, path in sources.items()}
    tables: Tables = {name: spark.read.parquet(path) for name, path in sources.items()}
    folders, told = {}, []
    for stage in stages:
        missing = [r for r in stage.reads if r not in tables]
        if missing or stage.name in tables:
            raise ValueError(f"stage {stage.name} reads what no stage before it gives: {missing}" if missing else f"{stage.name} is there twice")
        digests[stage.name] = _digest(stage.name, stage.version, *[digests[r] for r in stage.reads])
        folder = f"{root}/stages/{stage.name}-{digests[stage.name]}"
        files, mark = filesystem(spark, f"{folder}/_SUCCESS")
        own = {r: tables[r] for r in stage.reads}
        if files.exists(mark):
            told.append((stage.name, "kept"))
        else:
            stage.run(own).write.mode("overwrite").parquet(folder)
            told.append((stage.name, "run"))
        tables[stage.name], folders[stage.name] = spark.read.parquet(folder), folder
        for gate, violations in stage.gates.items():
            if n := violations(tables[stage.name], own):
                raise GateFailed(f"{stage.name}: {gate} has {n} violations")
    if publish:
        _write_text(spark, f"{root}/published.json", json.dumps(folders))
    return told


def sweep(spark: SparkSession, root: str) -> None:
    """Deletes stages' folders that are not published; not while a run goes on."""
    kept = {p.rsplit("/", 1)[-1] for p in published(spark, root).values()}
    files, at = filesystem(spark, f"{root}/stages")
    for f in list(files.listStatus(at)) if files.exists(at) else []:
        if f.getPath().getName() not in kept:
            files.delete(f.getPath(), True)
