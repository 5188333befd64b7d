"""Language-model scores from a probabilistic suffix tree.

Tokens are words (lower-cased A-Z, split at ASCII white space) and one end for
each text.  The root is the add-one distribution over all words of the
training texts and one unknown.  Below it stand contexts of one up to ``depth``
words, read backwards from the scored place, the start of a text being one.  A
context is a candidate if it occurs ``least`` times; it is retained if its
next-symbol distribution diverges from its parent's (the longest retained
shorter suffix) by ``gain`` an occurrence.  A retained node interpolates
absolutely discounted counts with its parent, so every state sums to one.

A token's probability is that of the longest retained suffix of what stands
before it.  Its logarithm is the root's plus what each retained suffix adds to
the next shorter one: an entry's own lift, or the back-off weight where the
context has no entry for the token.  So a text's score is a sum of independent
look-ups, whatever their order.

Sizes.  Thresholds are absolute counts, so the tree grows with the corpus; it
is a table, built level by level by grouping and joins.  A level counts only
places whose shorter context is a candidate, found by a bitmap of bounded size
that may let others pass (they are dropped by the join).  For scoring, the most
frequent ``hot_words`` words, ``hot_contexts`` contexts and ``hot_entries``
entries are sent to all tasks, and what isn't among them is joined by a
shuffle; the result doesn't depend on these three.

Words and contexts are told apart by 64-bit hashes.  An entry is a next word
that occurs ``least`` times in all and ``entry`` times after the context.

A null text is empty: its end is its only token.  A null doc_id hashes as the
empty text.  Rows are scored one by one; repeated rows count as often as they
occur.  With no training text N and V are 0.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import filters, frames, vectext
from corpusmill.llm.vectext import U64, mix, signed, unmix

END, START = np.uint64(0xE0D), np.uint64(0x57A7)  # the hashes that stand for the end of a text and for what is before it
DISCOUNT = 0.75
#: Text whose tokens a task gathers before it counts them.
SEGMENT = 12 << 20
#: Keys whose counts a task holds, over all its text; with more it sends them on.
MOST_KEYS = 1 << 21
_STEP = 0x9E3779B97F4A7C15


def _part(words: np.ndarray, distance: int) -> np.ndarray:
    """What a word at a distance from the end of a sequence adds (xor) to the sequence's hash."""
    return mix(words + U64(distance * _STEP & (1 << 64) - 1))


def _streams(batches: Iterator[pa.RecordBatch], training: bool):
    """(batch, block, token hashes with ends, their rows, held-out flags of the rows, tokens of the rows); training: only these rows' tokens."""
    for batch in batches:
        ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
        out = np.fromiter((zlib.crc32(x.encode()) % 7 == 2 for x in ids), dtype=bool, count=len(ids))
        for block in vectext.blocks(batch.column("bytes")):
            words = vectext.Words(block)
            n = words.hi - words.lo
            ends = np.cumsum(n + 1) - 1
            h = np.full(int((n + 1).sum()), END, dtype=U64)
            mask = np.ones(len(h), dtype=bool)
            mask[ends] = False
            h[mask] = words.hash
            row = np.repeat(np.arange(len(block)), n + 1)
            held = out[block.first : block.first + len(block)]
            if training:
                keep = ~held[row]
                h, row = h[keep], row[keep]
            yield batch, block, h, row, held, n + 1


def _summed(key: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in ascending order, with its context and the sum of its counts."""
    if not len(key):
        return key, ctx, n
    o = vectext.order(key)
    key = key[o]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], ctx[o[first]], np.add.reduceat(n[o], first)


def _counted(parts: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Counts of keys, each with its context: a key once for all text of a task, unless it meets more than MOST_KEYS; by context, as rows that share one pack well."""
    fresh, size, held = [], 0, None

    def counted():
        key, ctx = (np.concatenate(x) for x in zip(*fresh, strict=True))
        fresh.clear()
        new = _summed(key, ctx, np.ones(len(key), dtype=np.int64))
        return new if held is None else _summed(*(np.concatenate(x) for x in zip(held, new, strict=True)))

    def out(key, ctx, n):
        o = vectext.order(ctx)
        return _rows(key[o], ctx[o], n[o])

    for key, ctx, n in parts:
        fresh.append((key, ctx))
        size += n
        if size >= SEGMENT:
            held, size = counted(), 0
            if len(held[0]) > MOST_KEYS:
                yield from out(*held)
                held = None
    if fresh:
        held = counted()
    if held is not None:
        yield from out(*held)


def _rows(key: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 1 << 16):
        j = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(signed(key[j])), pa.array(signed(ctx[j])), pa.array(n[j].astype(np.int64))], ["k", "ctx", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((key := _part(h, 1), np.zeros(len(key), dtype=U64), len(block.buf)) for _, block, h, _, _, _ in _streams(batches, True))


def _walk(h: np.ndarray, row: np.ndarray, at: np.ndarray, levels: list[filters.Filter]):
    """For each level: the places whose context is a candidate there and above; hashes of context, and of context and token; the oldest word."""
    first = np.searchsorted(row, row[at]) if len(at) else at
    ctx, key = np.zeros(len(at), dtype=U64), _part(h[at], 1)
    for d, level in enumerate(levels, 1):
        ok = at - d >= first - 1
        at, first, ctx, key = at[ok], first[ok], ctx[ok], key[ok]
        old = np.where(at - d >= first, h[np.maximum(at - d, 0)], START)
        ctx = ctx ^ _part(old, d)
        hit = level.find(ctx)
        at, first, ctx, old = at[hit], first[hit], ctx[hit], old[hit]
        key = key[hit] ^ _part(old, d + 1)
        if not len(at):
            return
        yield d, at, ctx, key, old


def _entries(held):
    """(k, ctx, n): counts of the last level's contexts with next symbols.

    What follows a context entry times follows its suffix as often, so a key goes out only if its suffix's key is an entry of the level above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, levels, above = held.value

        def parts():
            for _, block, h, row, _, _ in _streams(batches, True):
                for d, _, ctx, key, old in _walk(h, row, symbols.find(_part(h, 1)), levels):
                    if d == len(levels):
                        if above is not None:
                            hit = above.find(key ^ _part(old, d + 1))
                            ctx, key = ctx[hit], key[hit]
                        yield key, ctx, len(block.buf)

        yield from _counted(parts())

    return run


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ctx, total, turn) of contexts: what turns a context's keys into those of its suffix, its oldest word one place further from the end."""
    for batch in batches:
        old = batch.column("old").to_numpy(zero_copy_only=False).view(U64)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array(signed(mix(unmix(old) + U64(_STEP))))], ["ctx", "total", "turn"])


def _score(held, ids: list[str]):
    rare = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
    cold = pa.list_(pa.struct([("k", pa.int64()), ("ctx", pa.int64())]))

    def lists(row, k, columns, kind):
        """A list for each row of structs of its columns; rows are in order."""
        bounds = np.searchsorted(row, np.arange(k + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(c) for c in columns], [f.name for f in kind.value_type])).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size, levels, backs, lifts, any_context, any_entry = held.value
        for batch, block, h, row, out, n in _streams(batches, False):
            k = len(block)
            key = _part(h, 1)
            base, counts = np.zeros(len(h)), np.zeros(len(h), dtype=np.int64)
            hit, own = words.find(key)
            base[hit], counts[hit] = np.log10((own + 1.0) / size), own
            is_cold = np.ones(len(h), dtype=bool)
            is_cold[hit] = False
            lift, asked = np.zeros(len(h)), []
            for _, at, ctx, kk, _ in _walk(h, row, np.arange(len(h)), levels):
                own, sure = np.zeros(len(at)), np.ones(len(at), dtype=bool)
                if any_context is not None:
                    sure[any_context.find(ctx)] = False
                hit, value = backs.find(ctx)
                own[hit], sure[hit] = value, True
                if any_entry is not None:
                    sure[any_entry.find(kk)] = False
                hit, value = lifts.find(kk)
                own[hit], sure[hit] = value, True
                lift[at] += np.where(sure, own, 0.0)
                if not sure.all():
                    asked.append((row[at[~sure]], kk[~sure], ctx[~sure]))
            r, c = row[is_cold], key[is_cold]
            o = np.lexsort((c, r))
            r, c = r[o], c[o]
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])))) if len(r) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.concatenate((new, [len(r)]))).astype(np.int64)
            if asked:
                ar, ak, ac = (np.concatenate(x) for x in zip(*asked, strict=True))
                o = np.argsort(ar, kind="stable")
                ar, ak, ac = ar[o], ak[o], ac[o]
            else:
                ar, ak, ac = np.zeros(0, dtype=np.int64), key[:0], key[:0]
            sums = [np.bincount(row, weights=x, minlength=k) for x in (base, lift)]
            known = np.bincount(row, weights=counts > 0, minlength=k).astype(np.int64)
            keep = [batch.column(x).slice(block.first, k) for x in ids]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out), pa.array(n.astype(np.int64)), pa.array(known), pa.array(sums[0]), pa.array(sums[1]), lists(r[new], k, (signed(np.ascontiguousarray(c[new])), times), rare), lists(ar, k, (signed(ak), signed(ac)), cold)], [*ids, "held_out", "n_tokens", "n_hot", "base", "lift", "rare", "cold"])

    return run


def _most(df: DataFrame, limit: int) -> tuple[int, int]:
    """The least power of two so that no more than ``limit`` rows have n at or above it; and how many rows there are."""
    sizes = df.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("n") >= 1 << i).alias(f"c{i}") for i in range(48)]).first()
    return next(1 << i for i in range(48) if sizes[f"c{i}"] <= limit), sizes["all"]


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= frames.BROADCAST_ROWS // 2 else df


def _level(found: DataFrame, contexts: DataFrame, many: int, prior: DataFrame, prior_rows: int, gain: float) -> tuple[DataFrame, DataFrame]:
    """Retained contexts (ctx, n, back) and the level's entries (k, n, lift, lp, turn), from counts of candidate contexts.

    old is what a context's oldest word adds to its hash, turn what it adds to the keys; lp is the log probability of an entry under the longest retained suffix up to this level, lift what this level adds to it, null in a context that isn't retained.
    """
    known = frames.cut(contexts.select("k", "n", "old").mapInArrow(_turns, "ctx long, total long, turn long"))
    each = found.join(_small(known, many), "ctx").withColumn("pk", F.col("k").bitwiseXOR(F.col("turn")))
    each = each.join(_small(prior.select(F.col("k").alias("pk"), F.col("lp").alias("up")), prior_rows), "pk")
    each = frames.cut(each.select("k", "ctx", "n", "total", "up", "turn"))
    frames.release(found)
    each_rows = each
    each = each.withColumn("share", (F.col("n") - DISCOUNT) / F.col("total"))
    rest = each.groupBy("ctx").agg(F.greatest(1 - F.sum("share"), F.lit(1e-12)).alias("back"))
    each = each.join(_small(rest, many), "ctx").withColumn("own", F.log(F.col("share") + F.col("back") * F.exp("up")))
    told = each.groupBy("ctx").agg(F.sum(F.col("n") * (F.col("own") - F.col("up"))).alias("gained"), F.sum("n").alias("seen"), F.first("back").alias("back"))
    told = known.join(told, "ctx").where((F.col("gained") + (F.col("total") - F.col("seen")) * F.log("back")) >= gain * F.col("total"))
    told = frames.cut(told.select("ctx", F.col("total").alias("n"), F.log10("back").alias("back")))
    kept = _small(told.select("ctx", F.lit(True).alias("kept")), many)
    each = each.join(kept, "ctx", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    lift = (F.col("own") - F.col("up")) / F.lit(np.log(10.0).item())
    entries = frames.cut(each.select("k", "n", F.when(F.col("kept"), lift).alias("lift"), F.when(F.col("kept"), F.col("own")).otherwise(F.col("up")).alias("lp"), "turn"))
    frames.release(each_rows)
    frames.release(known)
    return told, entries


def score(docs: DataFrame, depth: int = 4, least: int = 512, entry: int = 8, gain: float = 0.005, hot_words: int = 400_000, hot_contexts: int = 400_000, hot_entries: int = 2_000_000) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    frames.arrow_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    send = spark.sparkContext.broadcast
    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", frames.text_bytes().alias("bytes"))
    shape = "k long, ctx long, n long"
    counts = frames.cut(src.mapInArrow(_word_counts, shape).groupBy("k").agg(F.sum("n").alias("n")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = n + v + 1.0

    start, end = (int(signed(_part(np.array([x]), 1))[0]) for x in (START, END))
    symbols = frames.cut(counts.where(F.col("n") >= least))
    many = symbols.count()
    contexts = symbols.withColumn("k", F.when(F.col("k") == end, F.lit(start)).otherwise(F.col("k"))).withColumn("old", F.col("k"))  # a text has one end, and one start
    prior, prior_rows = symbols.withColumn("lp", F.log((F.col("n") + 1.0) / size)), many
    above = None  # the first level's keys are of words in ``symbols``
    sound = filters.build(symbols.select("k"), many)
    levels, backs, lifts = [], [], []
    for d in range(1, depth + 1):
        if d > 1:
            contexts = prior.where(F.col("n") >= least).select("k", "n", F.col("turn").alias("old"))
            many = contexts.count()
        if not many:
            break
        if d > 1:
            above = filters.build(prior.select("k"), prior_rows)
        levels.append(filters.build(contexts.select("k"), many))
        found = frames.cut(src.mapInArrow(_entries(send((sound, levels, above))), shape).groupBy("k", "ctx").agg(F.sum("n").alias("n")).where(F.col("n") >= entry))
        told, prior = _level(found, contexts, many, prior, prior_rows, gain)
        prior_rows = prior.count()
        backs.append(told)
        lifts.append(prior.where("lift is not null").select("k", "n", "lift"))

    def hot(parts: list[DataFrame], value: str, limit: int) -> tuple[filters.Table, DataFrame | None, int]:
        """The most frequent rows, all rows if there are others, and the count from which rows are among the first."""
        if not parts:
            return filters.Table(np.zeros(0, dtype=np.int64), np.zeros(0)), None, 0
        every = reduce(DataFrame.unionByName, parts).toDF("k", "n", value)
        floor, rows = _most(every, limit)
        got = frames.fetch((every if rows <= limit else every.where(F.col("n") >= floor)).select("k", value))
        return filters.Table(got["k"].astype(np.int64), got[value].astype(np.float64)), every if rows > limit else None, floor

    words, more_words, floor = hot([counts.select("k", "n", F.col("n").alias("c"))], "c", hot_words)
    back, more_contexts, _ = hot(backs, "back", hot_contexts)
    lift, more_entries, entry_floor = hot(lifts, "lift", hot_entries)
    any_context = filters.build(more_contexts.select("k")) if more_contexts is not None else None
    any_entry = filters.build(more_entries.where(F.col("n") < entry_floor).select("k")) if more_entries is not None else None
    held = send((words, size, levels, back, lift, any_context, any_entry))
    rows = src.mapInArrow(_score(held, ["rid", "doc_id"]), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_hot long, base double, lift double, rare array<struct<h:long,n:long>>, cold array<struct<k:long,ctx:long>>")
    rows = frames.cut(rows)

    zero = F.lit(0.0)
    out = rows.drop("rare", "cold")
    if more_words is not None:
        each = rows.where(F.size("rare") > 0).select("rid", F.inline("rare")).withColumnRenamed("n", "times")
        each = each.join(counts.where(F.col("n") < floor).withColumnRenamed("k", "h"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:  # words that no training text has
        each = rows.where(F.size("rare") > 0).select("rid", F.inline("rare")).withColumnRenamed("n", "times").withColumn("n", F.lit(0))
    p0: Column = F.log10((F.col("n") + 1.0) / F.lit(size))
    rare = each.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * p0).alias("p_rare"))
    out = out.join(rare, "rid", "left")
    if any_context is not None or any_entry is not None:
        empty = spark.createDataFrame([], "k long, n long, value double")
        entries = (more_entries if more_entries is not None else empty).toDF("k", "n", "lift").select("k", "lift")
        nodes = reduce(DataFrame.unionByName, backs).select("ctx", "back")
        cold = rows.where(F.size("cold") > 0).select("rid", F.inline("cold")).join(entries, "k", "left").join(nodes, "ctx", "left")
        cold = cold.groupBy("rid").agg(F.sum(F.coalesce("lift", "back", zero)).alias("p_cold"))
        out = out.join(cold, "rid", "left")
    else:
        out = out.withColumn("p_cold", zero)
    base = F.col("base") + F.coalesce("p_rare", zero)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("lift") + F.coalesce("p_cold", zero)).alias("score"))
