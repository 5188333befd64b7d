"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``points`` places of a ring; a document goes to the owner of
the next place clockwise of its hash, and if that shard is full, on to the next
place whose owner has room.  Loads are bounded at n/shards rows, rounded up for
the first n mod shards shards, down for the others: shard sizes differ by one
row at most.  With ``slack``, shards may take that much more, and fewer rows
move when a shard is added.

Only arcs (the stretches between places) and their counts are needed to decide:
the arcs' overflow is settled on the driver over shards*points numbers, however
large the table.  Each arc is then cut at ranks; a row's rank in its arc gives
its shard and, with the running count of the cut, its slot.  Ranks are taken in
parts of an arc of about ``part_rows`` rows, so that a crowded arc is no single
task.  Ranks follow a hash of doc_id and text, so the rows' order and files don't
matter; only a part that equal rows crowd is dealt out by where they lie.
DataFrame operations only.

A null text counts as no bytes.  Rows with equal or null doc_id are spread by
their text; wholly equal rows go to the same arc and take different slots.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import frames


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """(place, shard), by place; places are 63-bit."""
    at = lambda s, p: int.from_bytes(hashlib.blake2b(f"{s}/{p}".encode(), digest_size=8).digest(), "big") >> 1
    return sorted((at(s, p), s) for s in range(shards) for p in range(points))


def settle(counts: dict[int, int], owner: list[int], room: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each arc (arc i ends at place i): its cuts (from rank, to rank, shard, first slot).

    Every arc first asks its own shard, then all that is left asks the owner of the next place, and so on.
    """
    room, used = list(room), [0] * len(room)
    cuts: dict[int, list] = {a: [] for a in counts}
    left = {a: 0 for a, n in counts.items() if n}
    for step in range(len(owner)):
        if not left:
            break
        for a in sorted(left):
            s = owner[(a + step) % len(owner)]
            take = min(room[s], counts[a] - left[a])
            if take:
                cuts[a].append((left[a], left[a] + take, s, used[s]))
                room[s] -= take
                used[s] += take
                left[a] += take
                if left[a] == counts[a]:
                    del left[a]
    return cuts


def shard(docs: DataFrame, shards: int = 40, points: int = 64, part_rows: int = 100_000, slack: float = 0.0) -> DataFrame:
    """Each row's doc_id, size, text_crc32, law, shard, slot and grown_shard (null under either law).

    Without slack the law is "rows"; with it a shard takes up to (1 + slack) * rows / shards rows, and the law is "bounded".
    """
    spark = docs.sparkSession
    places = ring(shards, points)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("doc_id", raw).alias("key"), F.monotonically_increasing_id().alias("rid"))
    table = "array(" + ",".join(f"{p}L" for p, _ in places) + ")"
    bits = len(places).bit_length() - 1
    rows = rows.withColumn("place", F.shiftrightunsigned("key", 1))
    below = F.expr(f"aggregate(sequence({bits}, 0, -1), 0, (a, k) -> if(a + shiftleft(1, k) <= {len(places)} and get({table}, a + shiftleft(1, k) - 1) < place, a + shiftleft(1, k), a))")
    rows = frames.cut(rows.withColumn("arc", F.pmod(below, F.lit(len(places)))).drop("place"))

    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # one for each place of the ring at most
    n = sum(counts.values())
    room = [math.ceil((1 + slack) * n / shards)] * shards if slack else [n // shards + (s < n % shards) for s in range(shards)]
    cuts = settle(counts, [s for _, s in places], room)
    plan = json.dumps([{"arc": a, "parts": -(-counts[a] // part_rows), "cuts": [{"lo": lo, "hi": hi, "shard": s, "slot": slot} for lo, hi, s, slot in c]} for a, c in sorted(cuts.items())])
    arcs = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(plan), "array<struct<arc:int,parts:int,cuts:array<struct<lo:long,hi:long,shard:int,slot:long>>>>"))))

    rows = rows.join(arcs.select("arc", "parts"), "arc").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    full = frames.cut(rows.groupBy("arc", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * part_rows)).alias("subs")).where("subs > 1"))  # crowded by equal rows
    full_rows = full.count()
    rows = rows.join(F.broadcast(full) if full_rows <= frames.BROADCAST_ROWS // 4 else full, ["arc", "part"], "left").withColumn("sub", F.pmod(F.xxhash64("rid"), F.coalesce("subs", F.lit(1))))
    sizes = rows.groupBy("arc", "part", "sub").count()
    before = Window.partitionBy("arc").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = frames.cut(sizes.select("arc", "part", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    nth = F.row_number().over(Window.partitionBy("arc", "part", "sub").orderBy("key", "rid"))
    known = F.broadcast(sizes) if sizes.count() <= frames.BROADCAST_ROWS // 4 else sizes
    ranked = rows.withColumn("nth", nth).join(known, ["arc", "part", "sub"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    ranked = ranked.join(arcs.select("arc", "cuts"), "arc").withColumn("cut", F.get(F.filter("cuts", lambda c: (c["lo"] <= F.col("rank")) & (F.col("rank") < c["hi"])), F.lit(0)))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bounded" if slack else "rows").alias("law"), F.col("cut.shard").alias("shard"), (F.col("cut.slot") + F.col("rank") - F.col("cut.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
