"""Polled feeds as a stream: ticks from a data source, a cursor for each profile in keyed state.

``feed_ticks`` is a Python data source: an offset is a number of ticks, a micro-batch holds the ticks since the last one,
one row for each profile and tick. ``poll`` fetches a page for each tick on the executor that holds the profile's
state: a page moves the cursor, a failure leaves it, remembers what failed and sets a cooldown; the page is asked for
again when that is over. Cursors live in the query's checkpoint and are written with the batch's offsets, so a query that
is killed in the middle fetches the same pages again and hands on each page once (with a sink that replaces a batch, as
files do).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill import storage
from corpusmill.sources.feeds import COOLDOWN, ERRORS

#: fetch(profile, start, size) gives a page's records, at most size of them; none at the end of the feed.
Fetch = Callable[[str, int, int], list[dict]]
PAGE = "profile string, tick long, start long, status string, record string, error string"
_STATE = "next_start long, pages long, records long, failures long, last_status string, last_error string, wait_until long"


class FeedTicks(DataSource):
    """Options: profiles (a JSON list), and either ticks (how many there are) or seconds (the length of one; counted from 1970)."""

    @classmethod
    def name(cls) -> str:
        return "feed_ticks"

    def schema(self) -> str:
        return "profile string, tick long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  the data source interface's name
        return _Ticks(json.loads(self.options["profiles"]), self.options.get("ticks"), self.options.get("seconds"))


class _Range(InputPartition):
    def __init__(self, profile: str, first: int, last: int):
        super().__init__((profile, first, last))


class _Ticks(DataSourceStreamReader):
    def __init__(self, profiles: list[str], ticks: str | None, seconds: str | None):
        if (ticks is None) == (seconds is None):
            raise ValueError("either ticks or seconds")
        self.profiles, self.ticks, self.seconds = profiles, ticks, seconds

    def now(self) -> int:
        return int(self.ticks) if self.ticks is not None else int(time.time() // float(self.seconds))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0 if self.ticks is not None else self.now() - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": self.now()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(p, start["tick"], end["tick"]) for p in self.profiles]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        profile, first, last = partition.value
        for tick in range(first, last):
            yield profile, tick

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


def error_kind(error: BaseException) -> str:
    """As feeds.error_kind tells a text."""
    said = repr(error).lower()
    return next((kind for kind, parts in ERRORS if any(p in said for p in parts)), "fatal_error")


def poll(ticks: DataFrame, fetch: Fetch, size: int, seconds_per_tick: float = 60.0, cooldown: dict[str, int] = COOLDOWN) -> DataFrame:
    """Rows of PAGE: a row for each record (status found), one for an empty page (end), a failed one (its kind) or a tick in a cooldown (cooling)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (profile,) = key
        at, pages, records, failures, last, said, until = state.get if state.exists else (0, 0, 0, 0, "initialized", None, -1)
        rows = []
        for tick in sorted(int(t) for frame in frames for t in frame["tick"]):
            if tick < until:
                rows.append((profile, tick, at, "cooling", None, said))
                continue
            try:
                page = fetch(profile, at, size)
            except Exception as error:  # noqa: BLE001  whatever a feed does, its cursor stays and the others go on
                last, said, failures = error_kind(error), repr(error), failures + 1
                until = tick + 1 + int(cooldown.get(last, 0) * 60 // seconds_per_tick)
                rows.append((profile, tick, at, last, None, said))
                continue
            rows += [(profile, tick, at + i, "found", json.dumps(r, sort_keys=True, ensure_ascii=False), None) for i, r in enumerate(page)]
            if page:
                pages += 1
            else:
                rows.append((profile, tick, at, "end", None, None))
            at, records, last, said, until = at + len(page), records + len(page), "success", None, -1
        state.update((at, pages, records, failures, last, said, until))
        yield pd.DataFrame(rows, columns=["profile", "tick", "start", "status", "record", "error"])

    return ticks.groupBy("profile").applyInPandasWithState(step, PAGE, _STATE, "append", GroupStateTimeout.NoTimeout)


def ticks(spark: SparkSession, profiles: list[str], **options: str) -> DataFrame:
    storage.ship(spark)
    spark.dataSource.register(FeedTicks)
    return spark.readStream.format("feed_ticks").options(profiles=json.dumps(profiles), **options).load()


def records(pages: DataFrame, schema: str) -> DataFrame:
    """profile, start, and the fields of the records that were found."""
    return pages.where(F.col("status") == "found").select("profile", "start", F.from_json("record", schema).alias("r")).select("profile", "start", "r.*")


def cursors(pages: DataFrame) -> DataFrame:
    """(profile, next_start, records, failures, last_status) as what has been handed on tells it; a batch view for reports."""
    moved = F.when(F.col("status") == "found", F.col("start") + 1)
    told = ~F.col("status").isin("cooling")
    return pages.groupBy("profile").agg(
        F.coalesce(F.max(moved), F.lit(0)).alias("next_start"), F.count(moved).alias("records"), F.count_if(told & ~F.col("status").isin("found", "end")).alias("failures"),
        F.max_by(F.when(F.col("status").isin("found", "end"), "success").otherwise(F.col("status")), F.when(told, F.struct("tick", "start"))).alias("last_status"),
    )
