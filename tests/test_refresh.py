"""A refresh resumes, runs again only what a change reaches, and never shows half a result."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import refresh as r


def test_a_refresh(spark, tmp_path):
    root, a, b = (str(tmp_path / x) for x in ("root", "a", "b"))
    spark.range(10).write.parquet(a)
    spark.range(3).write.parquet(b)
    broken = {"on": False}

    def total(t):
        if broken["on"]:
            raise RuntimeError("killed")
        return t["double"].agg(F.sum("x").alias("s"))

    def stages(limit=10**6, version="1"):
        return [
            r.Stage("double", ["a"], lambda t: t["a"].select((F.col("id") * 2).alias("x")), version, {"no_negatives": lambda df, t: df.where("x < 0").count()}),
            r.Stage("other", ["b"], lambda t: t["b"].withColumn("y", F.lit(1))),
            r.Stage("total", ["double", "other"], total, gates={"small_enough": lambda df, t: df.where(F.col("s") > limit).count()}),
        ]

    run = lambda *s, **k: r.refresh(spark, root, {"a": a, "b": b}, stages(*s, **k))
    assert run() == [("double", "run"), ("other", "run"), ("total", "run")] and r.read(spark, root, "total").first().s == 90
    assert [x for _, x in run()] == ["kept"] * 3
    before = r.published(spark, root)
    spark.range(10, 20).write.mode("append").parquet(a)
    broken["on"] = True
    with pytest.raises(RuntimeError, match="killed"):
        run()
    assert r.published(spark, root) == before and r.read(spark, root, "total").first().s == 90
    broken["on"] = False
    with pytest.raises(r.GateFailed, match="small_enough has 1"):
        run(100)
    assert r.published(spark, root) == before
    assert run() == [("double", "kept"), ("other", "kept"), ("total", "kept")] and r.read(spark, root, "total").first().s == 380
    assert run(version="2") == [("double", "run"), ("other", "kept"), ("total", "run")]
    r.sweep(spark, root)
    assert len(list((tmp_path / "root" / "stages").iterdir())) == 3 and r.read(spark, root, "total").first().s == 380
    with pytest.raises(ValueError, match="no stage before"):
        r.refresh(spark, root, {}, stages())
