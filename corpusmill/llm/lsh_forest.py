"""Near-duplicate documents by an LSH forest, links confirmed on whole shingle sets.

A document is the set of its distinct word shingles (lower-cased A-Z, words
split at ASCII white space).  Documents with equal sets form a class and go on
as one.  A class has ``trees`` signature orders: each is a sequence of min-hash
values, cut into a head of ``root`` values and a tail.  Classes with the same
head are one region of a tree; sorted by tail, the neighbours in a region are
those with the longest common prefixes, so a crowded region compares at a
greater depth than a sparse one.  A class is paired with its ``near`` next
neighbours in each tree, never with all of a region.

Candidates are confirmed on their full sets, strongest first; those that
confirmed links already connect need no test.  Regions of more members than are
all paired, and of several components still, are then compared exactly: two
sets that reach the similarity share a shingle early in an order by rarity, so
pairs of different components are joined on the first part of each set, held
against the overlap that can still follow, and confirmed.  So neither the
number of neighbours nor the parts of large regions decide what is found.

At a similarity of 0.8 with 24 trees of root depth 4, a lone pair shares no
region with a chance of 0.0000033.

Rows with a null doc_id have no component and stay; a null text or one without
words has no shingle and links with nothing.  Repeated rows share a component.
A doc_id that occurs with several texts is one node that joins their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import frames, vectext
from corpusmill.llm.vectext import U64, mix, signed

#: Members that are held against one anchor in a group of the confirming step.
GROUP = 64
#: In a region of more classes than these only the next neighbour is a candidate at first; rare shingles find the rest.
CROWD = 16
#: A region of more classes than these is dealt into parts.
ROOM = 1024
_ID = "__corpusmill_id"  # beside the columns of the input


def shingle_sets(block: vectext.Block, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    words = vectext.Words(block)
    all_grams = vectext.grams(words.hash, size)
    out = []
    for lo, hi in zip(words.lo, words.hi, strict=True):
        if hi - lo >= size:
            g = np.sort(all_grams[lo : hi - size + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        else:
            out.append(vectext.grams(words.hash[lo:hi], int(hi - lo), seed=1) if hi > lo else all_grams[:0])
    return out


def _signatures(size: int, trees: int, root: int, depth: int):
    rng = np.random.default_rng(4)
    factor = rng.integers(1, 2**32, trees * depth, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vectext.blocks(batch.column("bytes")):
                sets = shingle_sets(block, size)
                counts = np.array([len(x) for x in sets], dtype=np.int64)
                full = np.flatnonzero(counts)
                n = len(sets)
                k1, k2 = np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)
                head, tail = np.zeros((n, trees), dtype=U64), np.zeros((n, trees), dtype=U64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    first = np.cumsum(counts[full]) - counts[full]
                    k1[full] = mix(np.add.reduceat(mix(every), first))
                    k2[full] = mix(np.add.reduceat(mix(every ^ U64(0x5851F42D4C957F2D)), first))
                    low = (every >> U64(16)).astype(np.uint32)
                    for t in range(trees):
                        h = np.full(len(full), t + 1, dtype=U64)
                        rest = np.zeros(len(full), dtype=U64)
                        for d in range(depth):
                            i = t * depth + d
                            least = np.minimum.reduceat((low ^ shift[i]) * factor[i], first)
                            if d < root:
                                h = mix(h * U64(0x9E3779B97F4A7C15) + least)
                            else:
                                rest = rest << U64(15) | (least >> np.uint32(17)).astype(U64)
                        head[full, t], tail[full, t] = h, rest
                flat = lambda x: pa.ListArray.from_arrays(np.arange(0, (n + 1) * trees, trees, dtype=np.int32), pa.array(signed(x.ravel())))
                ids, own = (batch.column(c).slice(block.first, n) for c in ("doc_id", "t"))
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(counts), pa.array(signed(k1)), pa.array(signed(k2)), flat(head), flat(tail)], ["doc_id", "t", "n_shingles", "k1", "k2", "heads", "tails"])

    return run


def _confirm(size: int, percent: int):
    """Rows in order of group, the anchor (role 0) first; yields the pairs that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor, node = None, None, None
        for batch in batches:
            a, b = [], []
            gs, roles, nodes = (batch.column(c).to_pylist() for c in ("g", "role", "node"))
            for block in vectext.blocks(batch.column("bytes")):
                for i, s in enumerate(shingle_sets(block, size), block.first):
                    if roles[i] == 0:
                        group, anchor, node = gs[i], s, nodes[i]
                    elif gs[i] == group:
                        if min(len(s), len(anchor)) * 100 < percent * max(len(s), len(anchor)):
                            continue
                        both = np.concatenate((anchor, s))
                        both.sort(kind="stable")
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        if shared and 100 * shared >= percent * (len(both) - shared):
                            a.append(node)
                            b.append(nodes[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])

    return run


def _shingles(size: int):
    """(node, c, n, h): a row for each shingle h of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vectext.blocks(batch.column("bytes")):
                sets = shingle_sets(block, size)
                counts = np.array([len(x) for x in sets], dtype=np.int64)
                at = pa.array(np.repeat(np.arange(len(sets)), counts))
                keep = [batch.column(c).slice(block.first, len(sets)).take(at) for c in ("node", "c")]
                h = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
                yield pa.RecordBatch.from_arrays([*keep, pa.array(np.repeat(counts, counts)), pa.array(signed(h))], ["node", "c", "n", "h"])

    return run


def _alike(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs (a, b) of different components c that can reach the similarity.

    Shingles are put in one order, rare ones first.  Two sets alike enough
    share a shingle so early in both that what follows it suffices for the
    overlap they need; pairs are joined on the first part of each set and held
    against this bound.
    """
    rows = frames.cut(texts.join(rest, "node").select("node", "c", "bytes").mapInArrow(_shingles(size), "node long, c long, n long, h long"))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    w = Window.partitionBy("node").orderBy("df", "h")
    rank = rows.join(often, "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", F.row_number().over(w))
    rare = frames.cut(rank.where(f"df > 1 and rank <= n - (n * {percent} + 99) div 100 + 1").select("h", "node", "c", "n", "rank"))
    frames.release(rows)
    main = rare.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "c")).alias("x"), F.count(F.lit(1)).alias("cs")).where("cs > 1").select("h", F.col("x.c").alias("main"))
    rare = rare.join(main, "h")
    x = rare.where("c <> main").select("h", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("rank").alias("rx"))  # a large component is never joined with itself
    y = rare.select("h", F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("rank").alias("ry"), (F.col("c") == F.col("main")).alias("largest"))
    enough = f"(least(nx - rx, ny - ry) + 1) * {100 + percent} >= {percent} * (nx + ny)"
    pairs = x.join(y, "h").where(f"cx <> cy and (largest or x < y) and least(nx, ny) * 100 >= {percent} * greatest(nx, ny) and {enough}")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. An anchor's partners are dealt out in groups."""
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("n"))
    dealt = pairs.join(n, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("n"))).alias("g"))
    rows = dealt.select("g", F.lit(1).alias("role"), F.col("b").alias("node")).unionByName(dealt.select("g", F.lit(0).alias("role"), F.col("a").alias("node")).distinct())
    return rows.join(texts, "node").repartition("g").sortWithinPartitions("g", "role").select("g", "role", "node", "bytes").mapInArrow(_confirm(size, percent), "a long, b long")


def _neighbours(leaf: DataFrame, near: int) -> DataFrame:
    """(a, b, votes): members of a region that follow each other by tail, and in how many trees.

    Regions of more than ROOM members are dealt into parts, another deal for
    each tree; of more than CROWD, only the next member is taken.
    """
    large = frames.cut(leaf.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROOM))
    leaf = leaf.join(F.broadcast(large) if large.count() <= frames.BROADCAST_ROWS else large, "head", "left")
    leaf = leaf.select("head", "tail", "node", F.pmod(F.xxhash64("head", "node"), F.coalesce(F.ceil(F.col("n") / ROOM), F.lit(1))).alias("part"))
    own = Window.partitionBy("head", "part")
    w = own.orderBy("tail", "node")
    crowded = F.count(F.lit(1)).over(own) > CROWD
    ahead = leaf.select("node", *[(F.lag("node", i).over(w) if i == 1 else F.when(~crowded, F.lag("node", i).over(w))).alias(f"n{i}") for i in range(1, near + 1)])
    pairs = ahead.select("node", F.explode(F.array(*[f"n{i}" for i in range(1, near + 1)])).alias("m")).where("m is not null")
    return pairs.groupBy(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).agg(F.count(F.lit(1)).alias("votes"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = 24, root: int = 4, depth: int = 8, near: int = 3) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id (smallest linked doc_id) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), frames.text_bytes().alias("bytes"))
    rows = frames.cut(src.withColumn("t", F.xxhash64("bytes")).mapInArrow(_signatures(size, trees, root, depth), "doc_id long, t long, n_shingles long, k1 long, k2 long, heads array<long>, tails array<long>"))
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t")).alias("of"), F.first("heads").alias("heads"), F.first("tails").alias("tails"))
    classes = frames.cut(classes.select("k1", "k2", "of.doc_id", "of.t", "heads", "tails", F.monotonically_increasing_id().alias("node")))
    leaf = frames.cut(classes.select("node", F.explode(F.arrays_zip("heads", "tails")).alias("x")).select("node", F.col("x.heads").alias("head"), F.col("x.tails").alias("tail")))

    pairs = frames.cut(_neighbours(leaf, near))
    members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    members = frames.cut(classes.select("node", "doc_id", "t").join(members, "node", "left_semi"))
    n = members.count()
    texts = src.withColumn("t", F.xxhash64("bytes")).join(F.broadcast(members) if n <= frames.BROADCAST_ROWS else members, ["doc_id", "t"]).select("node", "bytes")
    again = frames.cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    repeats = again.count()
    texts = frames.cut(texts.dropDuplicates(["node"]) if repeats else texts)

    best = pairs.select(F.col("b").alias("node"), F.struct("votes", F.col("a").alias("to")).alias("x")).unionByName(pairs.select(F.col("a").alias("node"), F.struct("votes", F.col("b").alias("to")).alias("x")))
    best = best.groupBy("node").agg(F.max("x").alias("x")).select(F.col("x.to").alias("a"), F.col("node").alias("b"))
    best = frames.cut(best.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.first("a").alias("a"), F.first("b").alias("b")).select("a", "b"))
    links = confirmed(best, texts, size, percent)
    if repeats:  # the texts of a doc_id are one node
        same = named.join(F.broadcast(again) if repeats <= frames.BROADCAST_ROWS else again, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "node"), ["k1", "k2"])
        links = links.unionByName(same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    label = frames.cut(frames.components(frames.cut(links)))

    tested = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    todo = frames.cut(_apart(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"), label))
    label = _joined(label, frames.cut(confirmed(todo, texts, size, percent)))

    region = leaf.join(members, "node", "left_semi").join(label, "node", "left").select("head", "node", F.coalesce("component", "node").alias("c"))
    several = region.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where((F.col("c0") != F.col("c1")) & (F.col("n") > min(near + 1, CROWD))).select("head")  # smaller ones are paired in full
    rest = frames.cut(region.join(several, "head", "left_semi").select("node", "c").distinct())
    if not rest.isEmpty():
        ask = frames.cut(_alike(rest, texts, size, percent).join(pairs, ["a", "b"], "left_anti"))
        label = _joined(label, frames.cut(confirmed(ask, texts, size, percent)))

    least = classes.join(label, "node").groupBy("component").agg(F.min("doc_id").alias("c"))
    label = label.join(least, "component").select("node", "c")
    node = frames.cut(classes.join(label, "node", "left").select("k1", "k2", F.coalesce("c", "doc_id").alias("c")))  # written, so that the join below may split a class of many copies
    for done in (leaf, pairs, texts, best, todo, rest):
        frames.release(done)
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("c")))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(node, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def distinct(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """The kept documents; all columns stay. Of rows that repeat both doc_id and text one stays.

    The dropped are named, as they are the fewer.
    """
    found = near_duplicates(docs.select("doc_id", "text"), size, percent, **options)
    bad = frames.cut(found.where("not kept").select(F.col("doc_id").alias(_ID)).distinct())
    n = bad.count()
    out = docs.join(F.broadcast(bad) if n <= frames.BROADCAST_ROWS else bad, F.col("doc_id") == F.col(_ID), "left_anti")
    again = frames.cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(_ID)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_ID))
    if again.isEmpty():
        return out
    m = again.count()
    again = F.broadcast(again) if m <= frames.BROADCAST_ROWS else again
    once = out.join(again, F.col("doc_id") == F.col(_ID), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, F.col("doc_id") == F.col(_ID), "left_anti").unionByName(once)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs that no chain of confirmed links connects yet."""
    la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _joined(label: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after more links: components of the graph of components."""
    la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = new.join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    between = frames.cut(between)
    if between.isEmpty():
        return label
    merged = frames.components(between, "u", "v").withColumnRenamed("node", "c").withColumnRenamed("component", "to")
    ends = between.select(F.col("a").alias("node"), F.col("u").alias("component")).unionByName(between.select(F.col("b").alias("node"), F.col("v").alias("component")))
    every = label.unionByName(ends).distinct()
    return frames.cut(every.join(merged, every["component"] == merged["c"], "left").select("node", F.coalesce("to", "component").alias("component")))
