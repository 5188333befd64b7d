"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from functools import reduce
from math import log, log10
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import decontam, filters, frames, lsh_forest, merkle, pii, pst, quality, rans, ring, ss_packing, suffix_dedup, tokens, vectext

rnd = random.Random(11)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def table(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind).repartition(3)


EDGES = [(900, None), (901, ""), (902, " \n "), (903, "a" * 2000), (904, "é" * 300), (905, "ab" * 300)]


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(b[i : i + n])
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[d] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("many", "largest"), [(suffix_dedup.MANY, suffix_dedup.LARGEST), (1, 150)])
def test_repeated_spans(spark, monkeypatch, many, largest):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    parts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(80, 260))) for _ in range(6)]
    rows = [(d, "".join(rnd.choice([rnd.choice(parts), rnd.choice(parts)[20:150], "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 120)))]) for _ in range(rnd.randint(0, 5)))) for d in range(60)] + EDGES
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(table(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeated_spans_by_join(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", -1)
    part = "".join(rnd.choice("abcdef ") for _ in range(220))
    rows = [(d, part[rnd.randint(0, 90) :] + str(d) + part[: rnd.randint(50, 200)]) for d in range(20)] + [(None, part)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(table(spark, rows)).collect()}
    want = brute_repeats([(10**9 if d is None else d, t) for d, t in rows])
    assert {10**9 if d is None else d: v for d, v in got.items()} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute_pii(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return all(int(p) <= 255 for p in m.split(".")) if k == "ip" else 13 <= len(d) <= 19 and luhn(d) if k == "card" else 9 <= len(d) <= 15 if k == "phone" else True

    return [(m.start(), m.end(), k) for k in PATTERNS for m in re.finditer(PATTERNS[k], t or "") if ok(k, m[0])]


def test_pii(spark):
    alphabet = ["a", "1", "2", "4", " ", "-", ".", "@", "+", "(", ")", "%", "_", "é", "😀", "255", "0", "4111111111111111", "a@b.c", "1.2.3.4", "+1 988 555-2485", "x"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))) for i in range(400)] + EDGES + [(950, "1" * 20000), (951, "a@b" + ".c" * 9000), (952, "write joe (at) mail dot com, card: 4111 1111 1111 1112")]
    got = {r.doc_id: r for r in pii.find(table(spark, rows)).collect()}
    for d, t in rows:
        assert [tuple(x) for x in got[d].base] == brute_pii(t), t
        assert set(map(tuple, got[d].base)) <= set(map(tuple, got[d].spans))
    wide = table(spark, [(1, "mail a@b.c now", 14, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, _row string")
    out = {r.doc_id: r for r in pii.redact(wide).collect()}
    assert (out[1].text, out[1].n_chars, out[1]._row, out[2].text) == ("mail [EMAIL] now", 16, "x", None)


def test_pii_loose_candidates(spark):
    rows = [(1, "joe at mail [dot] com"), (2, "joe at mail(dot)com"), (3, "é joe (at) mail dot com"), (4, "joe at mail"), (5, "ip 10[.]0[.]0[.]1 x"), (6, "10.0.0.1"), (7, "call 415 555-2671"), (8, "+1 415 555-2671"), (9, "4111 1111 1111 1112"), (10, "fe80:0:0:0:1:2:3:4")]
    docs = table(spark, rows).withColumnRenamed("doc_id", "rid")
    got = {(r.rid, r.kind, r.s, r.e) for r in pii.spans(pii.hits(docs, "rid")).where("not base").collect()}
    assert got == {(1, "email", 0, 21), (2, "email", 0, 19), (3, "email", 2, 23), (5, "ip", 3, 17), (7, "phone", 5, 17), (9, "card", 0, 19), (10, "ip", 0, 18)}


def test_pii_reliabilities():
    local, hit, miss = random.Random(8), [0.9, 0.8, 0.6, 0.7], [0.1, 0.3, 0.05, 0.2]
    counts = Counter()
    for _ in range(40_000):
        true = local.random() < 0.3
        counts["ip", sum(1 << i for i in range(4) if local.random() < (hit if true else miss)[i])] += 1
    got = pii.reliabilities(counts)["ip"]
    assert got["prior"] == pytest.approx(0.3, abs=0.04)
    assert got["hit"] == pytest.approx(hit, abs=0.05) and got["miss"] == pytest.approx(miss, abs=0.05)


def test_pii_adds_what_the_votes_and_features_tell(spark):
    local, rows = random.Random(9), []
    digits = lambda n: "".join(local.choice("23456789") for _ in range(n))
    for d in range(400):
        kind = d % 4
        if kind == 0:
            rows.append((d, f"please call +1 415 {digits(3)}-{digits(4)} now"))
        elif kind == 1:
            rows.append((d, f"please call 415 {digits(3)}-{digits(4)} now"))
        elif kind == 2:
            rows.append((d, f"lot 015 {digits(3)}-{digits(4)}x of parts"))
        else:
            rows.append((d, "nothing"))
    got = {r.doc_id: r for r in pii.find(table(spark, rows)).collect()}
    assert all(len(got[d].spans) == (d % 4 < 2) and len(got[d].base) == (d % 4 == 0) for d in range(400))
    out = {r.doc_id: r.text for r in pii.redact(table(spark, rows)).collect()}
    assert out[0] == out[1] == "please call [PHONE] now" and out[2] == rows[2][1]


def test_pii_redacts_many_matches(spark):
    text = "é joe@mail.example.com, 10.0.0.1 " * 20_000
    started = time.time()
    got = pii.redact(table(spark, [(1, text), (1, text), (2, "a@b.c, +1 415 555-2671; 4111 1111 1111 1111")])).collect()
    assert sorted(r.text for r in got) == sorted(["é [EMAIL], [IP] " * 20_000] * 2 + ["[EMAIL], [PHONE]; [CARD]"])
    assert time.time() - started < 60


def brute_tree(rows, depth, least, entry, gain, texts):
    """Score of each text by the definition: p by the longest retained suffix."""
    start, end = "<", ">"
    train = [[*words(t), end] for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(x for t in train for x in t)
    n, v = sum(count.values()), len(count)
    pairs = {d: Counter() for d in range(1, depth + 1)}
    for t in train:
        line = [start, *t]
        for i in range(1, len(line)):
            for d in range(1, min(depth, i) + 1):
                pairs[d][tuple(line[i - d : i]), line[i]] += 1
    kept = {}

    def prob(ctx, x):
        if not ctx:
            return (count[x] + 1) / (n + v + 1)
        if ctx not in kept:
            return prob(ctx[1:], x)
        entries, total, back = kept[ctx]
        return max(entries.get(x, 0) - 0.75, 0) / total + back * prob(ctx[1:], x)

    symbols = {x for x in count if count[x] >= least}
    for d in range(1, depth + 1):
        total = Counter()
        entries = {}
        for (ctx, x), k in pairs[d].items():
            total[ctx] += k
            if k >= entry and x in symbols:
                entries.setdefault(ctx, {})[x] = k
        new = {}
        for ctx, own in entries.items():
            if total[ctx] < least:
                continue
            back = max(1e-12, 1 - sum(k - 0.75 for k in own.values()) / total[ctx])
            gained = sum(k * log((k - 0.75) / total[ctx] / prob(ctx[1:], x) + back) for x, k in own.items()) + (total[ctx] - sum(own.values())) * log(back)
            if gained >= gain * total[ctx]:
                new[ctx] = (own, total[ctx], back)
        kept |= new
    out = {}
    for key, t in texts:
        line = [start, *words(t), end]
        out[key] = sum(log10(prob(tuple(line[max(0, i - depth) : i]), line[i])) for i in range(1, len(line)))
    return out, kept


@pytest.mark.parametrize("hot", [1 << 20, 3])
def test_language_model(spark, hot, monkeypatch):
    monkeypatch.setattr(filters, "EXACT_KEYS", hot)
    local = random.Random(21)
    vocabulary = [f"w{i}" for i in range(25)]
    rows = []
    for d in range(160):
        t = []
        for _ in range(local.randint(0, 60)):
            t.append(vocabulary[(vocabulary.index(t[-1]) * 3 + vocabulary.index(t[-2])) % 25] if len(t) > 1 and local.random() < 0.7 else local.choice(vocabulary[: 1 + d % 25]))
        rows.append((d, " ".join(t)))
    rows += [*EDGES, (None, "w1 w2"), (7, "w1"), (7, "w1"), (970, "never seen words w1 w2 w3")]
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update([*words(t), 0])
    n, v = sum(counts.values()), len(counts)
    texts = [(i, t) for i, (_, t) in enumerate(rows)]
    want, kept = brute_tree([("" if d is None else d, t) for d, t in rows], 3, 5, 3, 0.01, texts)
    assert max(map(len, kept)) == 3
    by = {}
    for i, (d, t) in enumerate(rows):
        by.setdefault(d, []).append((zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(words(t)) + 1, sum(x in counts for x in [*words(t), 0]), round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in [*words(t), 0]), 6), round(want[i], 6)))
    got = {}
    for r in pst.score(table(spark, rows), depth=3, least=5, entry=3, gain=0.01, hot_words=hot, hot_contexts=hot, hot_entries=hot).collect():
        assert r.train_tokens == n
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)))
    assert {k: sorted(x) for k, x in got.items()} == {k: [pytest.approx(y) for y in sorted(x)] for k, x in by.items()}


def test_language_model_learns_contexts(spark):
    rows = [(d, "alpha beta gamma delta " * 20) for d in range(60)] + [(100 + d, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(80))) for d in range(10)]
    got = pst.score(table(spark, rows)).where("held_out and doc_id < 60").collect()
    assert got and all(r.score > 0.5 * r.base_score for r in got)


def test_language_model_counts_keys_once(monkeypatch):
    monkeypatch.setattr(pst, "SEGMENT", 1)
    key = np.array([5, 3, 9, 5, 3, 7], dtype=np.uint64)
    ctx = np.array([2, 1, 1, 2, 1, 2], dtype=np.uint64)
    sent = lambda: [tuple(r.values()) for b in pst._counted(iter([(key[:2], ctx[:2], 9), (key[:0], ctx[:0], 9), (key[2:4], ctx[2:4], 9), (key[4:], ctx[4:], 9)])) for r in b.to_pylist()]
    assert sent() == [(3, 1, 2), (9, 1, 1), (5, 2, 2), (7, 2, 1)]  # once for all segments, by context
    monkeypatch.setattr(pst, "MOST_KEYS", 1)
    got = Counter()
    for k, c, n in sent():
        got[k, c] += n
    assert got == {(3, 1): 2, (9, 1): 1, (5, 2): 2, (7, 2): 1}


def test_language_model_sends_what_can_be_an_entry():
    texts = ["a b c", "a b d", "x b c"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 2, 3]), pa.array([x.encode() for x in texts])], ["doc_id", "bytes"])
    every = [h for _, _, h, _, _, _ in pst._streams([batch], True)][0]
    a, b, c, _, _, _, d = every[:7]
    part = lambda *w: reduce(np.bitwise_xor, (pst._part(np.array([x]), i) for i, x in enumerate(reversed(w), 1)))
    levels = [filters.Filter.of(part(b)), filters.Filter.of(part(a, b))]
    held = SimpleNamespace(value=(filters.Filter.of(np.concatenate([part(w) for w in np.unique(every)])), levels, filters.Filter.of(part(b, c))))
    rows = [r for x in pst._entries(held)([batch]) for r in x.to_pylist()]
    assert d != c and [(r["k"], r["ctx"], r["n"]) for r in rows] == [(pst.signed(part(a, b, c))[0], pst.signed(part(a, b))[0], 1)]
    old = pa.RecordBatch.from_arrays([pa.array(pst.signed(x)) for x in (part(a, b), np.ones(1, dtype=np.uint64), part(a, b) ^ part(b))], ["k", "n", "old"])
    turn = next(pst._turns([old])).to_pylist()[0]
    assert turn == {"ctx": pst.signed(part(a, b))[0], "total": 1, "turn": pst.signed(part(a, b, c) ^ part(b, c))[0]}


def brute_components(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_near_duplicates(spark):
    rows, d, vocabulary = [], 0, [f"v{i}" for i in range(300)]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(2, 120))]
        for _ in range(rnd.choice([1, 1, 2, 3, 8])):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((d, " ".join(t)))
            d += 1
    hub = [rnd.choice(vocabulary) for _ in range(300)]  # its copies are too far from one another
    rows.append((d, " ".join(hub)))
    for i in range(40):
        t = list(hub)
        for j in rnd.sample(range(300), 8):
            t[j] = f"x{i}_{j}"
        rows.append((d + 1 + i, " ".join(t)))
    rows += EDGES
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(table(spark, rows), size=4).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_in_crowded_regions(spark):
    local, rows = random.Random(5), []
    shared = [f"s{i}" for i in range(265)]
    for d in range(0, 200, 2):  # pairs at 0.81 whose members are at 0.77 or less to all others
        own = [f"u{d}_{i}" for i in range(40)]
        rows += [(d, " ".join(shared + own)), (1000 + d * 7919 % 9973, " ".join(shared + own[:9] + [f"v{d}_{i}" for i in range(31)]))]
    shared = [f"g{i}" for i in range(240)]
    for g in range(2):  # two groups in one region
        group = shared + [f"g{g}_{i}" for i in range(60)]
        rows += [(300 + 40 * g + i, " ".join([*group, *(f"z{g}_{i}_{j}" for j in range(local.randint(10, 30)))])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(table(spark, rows), size=4).collect()}
    want = brute_components(rows, 4)
    assert len({c for _, c, _ in want.values()}) == 102
    assert got == want


def test_near_duplicates_of_repeated_ids(spark):
    text = lambda c: [f"{c}{i}" for i in range(60)]
    near = lambda c: [*text(c)[:-1], "end"]
    rows = [(1, text("a")), (1, text("b")), (2, near("a")), (3, near("b")), (7, text("c")), (7, text("c")), (8, near("c")), (9, text("d")), (5, text("d")), (5, text("e")), (6, near("e"))]
    rows = [(d, " ".join(t)) for d, t in rows] + [(None, " ".join(text("a"))), (None, None), (20, None), (20, "x y")]
    got = lsh_forest.near_duplicates(table(spark, rows), size=4).collect()
    want = {1: {1}, 2: {1}, 3: {1}, 7: {7}, 8: {7}, 9: {5}, 5: {5}, 6: {5}, None: {None}, 20: {20}}
    assert len(got) == len(rows)
    for d, c in want.items():
        assert {r.component_id for r in got if r.doc_id == d} == c
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103)]
    got = {r.node: r.component for r in frames.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}


def test_merkle(spark):
    rows = [(d, "\n".join(" ".join(f"w{rnd.randint(0, 50)}" for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 6)))) for d in range(80)] + EDGES + [(990, "same text here"), (991, "same text here")]
    got = {r.doc_id: r for r in merkle.compare_with_next(table(spark, rows), rows_per_bucket=9).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == [merkle.fingerprints([x.encode()])[0] for x in (t, edited)]
        assert 0 <= r.near_edited <= 1 and r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprints([after.encode()])[0])
    assert got[990].fingerprint == got[991].fingerprint != got[901].fingerprint


def test_merkle_finds_edits():
    para = lambda: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(5, 60)))
    for _ in range(60):
        parts = [para() for _ in range(rnd.randint(1, 12))]
        text = "".join(p + rnd.choice(["\n", "\n\n"]) for p in parts).encode()
        lo = rnd.randint(0, len(text))
        hi = min(len(text), lo + rnd.randint(0, 80))
        after = text[:lo] + rnd.choice([b"", b"new words here", b"\n\n"]) + text[hi:]
        a, b = merkle.fingerprints([text, after])
        found = merkle.edits(a, b)
        assert bool(found) == (text != after)
        out, at = b"", 0
        for p, q, r, t in found:  # the ranges turn one text into the other
            out += text[at:p] + after[r:t]
            at = q
        assert out + text[at:] == after
        assert sum(q - p for p, q, _, _ in found) <= hi - lo + 2000
        assert 1 - (hi - lo + 700) / max(1, len(text)) <= merkle.likeness(a, b) <= 1
    assert merkle.likeness(*merkle.fingerprints([b"", b""])) == 1 and merkle.likeness(*merkle.fingerprints([b"", b"x"])) == 0


def test_ring(spark):
    rows = [(d, "x" * (d % 50)) for d in range(1003)] + [(5, "xxxxx")] * 30 + [(None, None)] * 20
    got = ring.shard(table(spark, rows), part_rows=11).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots[s]) for s in range(40)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t or "") + 16, zlib.crc32((t or "").encode())) for _, t in rows)


def test_ring_settles_as_documents_one_by_one_would():
    local = random.Random(4)
    for _ in range(20):
        shards = local.randint(1, 6)
        owner = [s for _, s in ring.ring(shards, 5)]
        counts = {a: local.randint(0, 30) for a in range(len(owner))}
        n = sum(counts.values())
        room = [n // shards + (s < n % shards) for s in range(shards)]
        cuts = ring.settle(counts, owner, room)
        left, want = list(room), {a: [] for a in counts}
        for step in range(len(owner)):  # every document that has no place yet asks the next one
            for a in sorted(counts):
                while len(want[a]) < counts[a] and left[owner[(a + step) % len(owner)]]:
                    left[owner[(a + step) % len(owner)]] -= 1
                    want[a].append(owner[(a + step) % len(owner)])
        for a in counts:
            assert [s for lo, hi, s, _ in cuts[a] for _ in range(lo, hi)] == want[a]


def test_ring_doesnt_depend_on_the_files_and_moves_few(spark):
    rows = [(d, f"text {d}") for d in range(4000)] + [(None, "same")] * 50
    place = lambda df, **x: sorted((-1 if r.doc_id is None else r.doc_id, r.shard, r.slot) for r in ring.shard(df, part_rows=300, **x).collect())
    one = place(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=10)
    assert one == place(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(2), shards=10)
    for slack, most in ((0.0, 0.45), (0.25, 0.2)):
        was, now = (dict((d, s) for d, s, _ in place(table(spark, rows), shards=k, slack=slack)) for k in (10, 11))
        moved = sum(was[d] != now[d] for d in range(4000)) / 4000
        assert moved <= most, moved


def test_quality_site_rates_by_hand(spark):
    rows = [("a", "x", 1, 0), ("a", "x", 0, 0), ("a", "y", 1, None), ("a", "y", 1, 1), ("b", "x", 0, 0), ("b", "x", 0, 0), ("b", "x", None, 0), (None, None, 1, 1)]
    got, base = quality.site_rates(spark.createDataFrame(rows, "host string, path string, toxic int, low int"))
    assert base["toxic"] == pytest.approx(4.5 / 8) and base["low"] == pytest.approx(2.5 / 8)

    def strength(sites, mean):
        own = [(k, n, mean(h)) for h, k, n in sites if n > 1]
        rows = sum(n for _, n, _ in own)
        between = (sum((k / n - m) ** 2 * n for k, n, m in own) - sum(m * (1 - m) for _, _, m in own)) / rows
        return min(1e4, max(2.0, base["toxic"] * (1 - base["toxic"]) / between)) if between > 0 else 1e4

    hosts = [("a", 3, 4), ("b", 0, 2), (None, 1, 1)]
    mh = strength(hosts, lambda h: base["toxic"])
    rate = {h: (k + mh * base["toxic"]) / (n + mh) for h, k, n in hosts}
    paths = [("a", 1, 2), ("a", 2, 2), ("b", 0, 2), (None, 1, 1)]
    mp = strength(paths, lambda h: rate[h])
    want = {("a", "x"): (1, 2), ("a", "y"): (2, 2), ("b", "x"): (0, 2), (None, None): (1, 1)}
    for r in got.collect():
        k, n = want[r.host, r.path]
        assert r.r_toxic == pytest.approx((k + mp * rate[r.host]) / (n + mp))


def test_quality_leaves_null_labels_out(spark):
    docs = spark.createDataFrame([(d, "x", "en", "s") for d in range(4)], "doc_id long, text string, lang string, source string")
    told = spark.createDataFrame([(0, None, None), (1, None, None), (2, 0, 1), (2, 1, None), (2, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    r = quality.judge(docs, told).first()
    assert (r.r_toxic, r.r_low) == (pytest.approx(0.75, abs=1e-3), pytest.approx(0.75, abs=1e-3))  # one labelled row, at fault


def test_quality(spark):
    bad = ["vile", "rotten"]
    rows, labels = [], []
    for d in range(1200):
        t = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 60))]
        toxic, low = d % 8 == 0, d % 9 == 1
        if toxic:
            t[rnd.randrange(len(t))] = rnd.choice(bad)
            t[rnd.randrange(len(t))] = rnd.choice(bad)
        rows.append((d, " ".join(t).upper() if low else " ".join(t), "en", f"s{d % 5}"))
        if d % 2:
            continue
        labels.append((d, int(not low), int(toxic)))
    rows += [(9000 + d, t, None, None) for d, t in EDGES]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, told).collect()}
    wrong = sum((got[d].p_toxic >= 0.5) != (d % 8 == 0) for d in range(1200))
    assert wrong <= 12
    assert len(got) == len(rows) and quality.clean(docs, told).count() == sum(r.kept for r in got.values())
    assert all(r.kept for r in quality.judge(docs, told.limit(0)).collect())


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_library_s(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "'ll", " '", "12", "!", "...", " ", "　", "中", "́", "<|endoftext|>", "<|start", "\x1c", "\x85", "😀", "ﬁ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    want = [e.ids for e in Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
    got = []
    for block in vectext.blocks(pa.array([t.encode() for t in texts]), limit=4000):
        ids, n = tokens.encoder(tokenizer(name)).encode(block)
        ends = np.cumsum(n)
        got += [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)]
    assert got == want


def test_packing(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode
    rows = [(d, " ".join(f"word{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 900)))) for d in range(60)] + EDGES + [(980, "long text " * 9000)]
    pieces, sequences = {}, {}
    for r in ss_packing.pack(table(spark, rows), tokenizer("word_bpe_49k.json"), 2).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d, t in rows:
        ids, at = [*encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            raw = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens, r.ids) == (at, zlib.crc32(raw), len(ids), raw)
            at += r.length
        assert at == len(ids)
    part = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        part += at < 4096
    assert part <= 3


def test_packer_takes_the_level_of_the_least_squares():
    local = random.Random(2)
    closed = []
    p = ss_packing.Packer(12, closed.append)
    for i in range(3000):
        size, levels = local.randint(1, 11), p.levels.copy()

        def squares(h, size=size, levels=levels):
            n = levels.copy()
            if h:
                n[h] -= 1
            if h + size < 12:
                n[h + size] += 1
            return int((n**2).sum())

        can = [h for h in range(13 - size) if not h or levels[h]]
        best = max(h for h in can if squares(h) == min(map(squares, can)))
        want = levels.copy()
        want[best] -= bool(best)
        if best + size < 12:
            want[best + size] += 1
        p.add(i, np.zeros(size, dtype=np.uint32))
        assert (p.levels == want).all()
    assert p.count < 300


def test_packer_bounds_open_sequences():
    closed = []
    p = ss_packing.Packer(64, closed.append, most_open=6)
    for i in range(500):
        p.add(i, np.arange(rnd.randint(1, 150), dtype=np.uint32))
        assert p.count <= 6
    p.close()
    fills = [sum(len(x[2]) for x in s) for s in closed]
    assert sum(f < 64 for f in fills) <= 1


def test_contamination(spark):
    vocabulary = ["Aa", "b", "é", "c9", "dd", "Straße", "x", "1"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(3 + i))) for i in range(25)] + [(100, None), (101, ".."), (102, "zz")]
    rows = []
    for d in range(80):
        t = [rnd.choice([*vocabulary, "yy"]) for _ in range(rnd.randint(0, 50))]
        if rnd.random() < 0.4:
            t[3:3] = (rnd.choice(items)[1] or "").split()
        rows.append((d, rnd.choice([" ", ", ", "\n"]).join(t)))
    rows += EDGES

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    docs, bench = table(spark, rows), table(spark, items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    clean = 0
    for d, t in rows:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        assert (got[d].n_words, got[d].n_hit, list(got[d]["items"])) == (len(w), len(hit), sorted(ids))
        clean += not hit
    assert decontam.clean(docs, bench).count() == clean
    twice = decontam.contamination(table(spark, [(1, "Aa b é"), (1, "Aa b é"), (None, "aa b " * 3000)]), table(spark, [(None, "aa b"), (5, "aa b"), (5, "aa b")], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in twice) == [(0, 6000, 6000, ("", "5")), (1, 3, 2, ("", "5")), (1, 3, 2, ("", "5"))]
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_rans_block(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50256).astype(np.uint32)
    t = rans.Table.of(ids) if n else rans.Table(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    raw = rans.encode_block(ids, t)
    assert (rans.decode_block(raw, rans.Table.load(t.dump())) == ids).all()
    if n > 1:
        with pytest.raises(ValueError):
            rans.decode_block(raw[:-1] + bytes([raw[-1] ^ 1]), t)


def test_rans_files(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode
    rows = [(d * 3, " ".join(f"tok{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 80)))) for d in range(70)] + EDGES
    path = rans.new_path(spark)
    rans.write_ids(table(spark, rows), path, tokenizer("byte_bpe_50k.json"), rows_per_bucket=9)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.read_ids(spark, path).collect()}
    start = 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_rans_files_of_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT_IDS", 50)
    rows = [(None, f"null {i}") for i in range(5)] + [(3, f"three {i} " * 40) for i in range(5)] + [(1, "long " * 300)]
    out = []
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)):
        path = rans.new_path(spark)
        rans.write_ids(df, path, tokenizer("byte_bpe_50k.json"))
        out.append(sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id or -1) for r in rans.read_ids(spark, path).collect()))
    assert out[0] == out[1] and [d for _, _, _, d in out[0]] == [1, *[3] * 5, *[-1] * 5]
    assert all(a[0] + a[1] == b[0] for a, b in zip(out[0], out[0][1:], strict=False))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = rans.new_path(spark)
    rans.write_ids(docs, path, tokenizer("byte_bpe_50k.json"))
    for df in (suffix_dedup.dedup(docs), pii.find(docs), pst.score(docs), lsh_forest.near_duplicates(docs), merkle.compare_with_next(docs), ring.shard(docs), quality.judge(docs, labels), ss_packing.pack(docs, tokenizer("word_bpe_49k.json"), 2), decontam.contamination(docs, items), rans.read_ids(spark, path), pii.redact(docs)):
        assert df.count() == 0
