"""Feeds as a stream: cursors, failures, cooldowns, and a query that is killed in the middle."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import feed_stream


def run(spark, fetch, folder, ticks, sink=None, size=3, **options):
    pages = feed_stream.poll(feed_stream.ticks(spark, ["a", "b"], ticks=str(ticks)), fetch, size, **options)
    writer = pages.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{folder}/out")
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def found(spark, folder, profile):
    rows = spark.read.parquet(f"{folder}/out").where((F.col("status") == "found") & (F.col("profile") == profile)).orderBy("start").collect()
    return [(r.start, r.record) for r in rows]


def make_feed():
    """A function that workers get by value."""

    def feed(profile, start, size):
        total = {"a": 8, "b": 100}[profile]
        return [{"id": f"{profile}{i}"} for i in range(start, min(start + size, total))]

    return feed


def test_cursors_go_on_after_a_restart(spark, tmp_path):
    run(spark, make_feed(), tmp_path, 2)
    assert len(found(spark, tmp_path, "a")) == 6
    run(spark, make_feed(), tmp_path, 5)
    assert [s for s, _ in found(spark, tmp_path, "a")] == list(range(8)) and [s for s, _ in found(spark, tmp_path, "b")] == list(range(15))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.profile, r.next_start, r.records, r.failures, r.last_status) for r in feed_stream.cursors(out).collect()} == {("a", 8, 8, 0, "success"), ("b", 15, 15, 0, "success")}
    assert out.where("status = 'end'").count() == 2
    assert feed_stream.records(out, "id string").where("start = 4").orderBy("profile").collect()[0].id == "a4"


def test_a_failed_page_is_asked_for_again_after_its_cooldown(spark, tmp_path):
    marker, feed = str(tmp_path / "marker"), make_feed()

    def flaky(profile, start, size):
        import os

        if profile == "a" and start == 3 and not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("HTTP 429: Rate exceeded")
        return feed(profile, start, size)

    run(spark, flaky, tmp_path, 6, cooldown={"rate_limited": 2})
    rows = spark.read.parquet(f"{tmp_path}/out").where("profile = 'a'").select("tick", "start", "status").distinct().orderBy("tick", "start").collect()
    assert [(r.tick, r.status) for r in rows if r.status not in ("found",)] == [(1, "rate_limited"), (2, "cooling"), (3, "cooling")]
    assert [s for s, _ in found(spark, tmp_path, "a")] == list(range(8)) and len(found(spark, tmp_path, "b")) == 18
    assert [r.failures for r in feed_stream.cursors(spark.read.parquet(f"{tmp_path}/out")).orderBy("profile").collect()] == [1, 0]


def test_a_query_killed_in_the_middle_loses_and_repeats_nothing(spark, tmp_path):
    """The sink breaks after the pages were fetched; the next run fetches them again, with the cursors of before."""
    broken = [True]

    def sink(batch, number):
        if number == 1 and broken.pop():
            batch.count()  # pages are fetched, the cursors in the task have moved
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    run(spark, make_feed(), tmp_path, 2, sink)
    with pytest.raises(Exception, match="killed"):
        run(spark, make_feed(), tmp_path, 4, sink)
    broken.append(False)
    run(spark, make_feed(), tmp_path, 6, sink)
    assert [s for s, _ in found(spark, tmp_path, "a")] == list(range(8)) and [s for s, _ in found(spark, tmp_path, "b")] == list(range(18))


def test_kinds_of_errors():
    said = {"503 Service Unavailable": "service_unavailable", "Read timed out": "timeout", "Failed to resolve host": "network_error", "boom": "fatal_error"}
    assert {k: feed_stream.error_kind(RuntimeError(k)) for k in said} == said
    with pytest.raises(ValueError, match="either"):
        feed_stream._Ticks(["a"], None, None)
