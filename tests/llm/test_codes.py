"""Pair-index BPE, vector codes and token alignment against the libraries and plain programs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import alignment, bpe, rans, ss_packing, tokens, vector_codes, vectext
from corpusmill.llm.queries import tokenizer_file

rnd = random.Random(23)
BYTE, PIECE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
LETTERS = "aaab c \n\t é̀漢字🙂'sS1２٣xyz.,!_ ​\x00\x1f\x85ß▁ﬁ①"


def texts():
    made = ["".join(rnd.choice([rnd.choice(LETTERS)] * 6 + ["<|endoftext|>", "'s", "  ", "the", " Haus", "<s>", "<0x41>"]) for _ in range(rnd.randint(0, 60))) for _ in range(250)]
    words = ["der", "the", "la", "straße", "naïve", "token", "42", "e@x.org", "isn't"]
    made += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(120)]
    made += [None, "", " ", "   ", "a" * 6001, "ab" * 2500, "\n" * 700, " " * 500, "<|endoftext|>" * 3, "x ", " " + "y" * 40 + "\n z", "long text " * 30_000]
    return [*made, made[3], made[3], made[300]]


def table(spark, rows):
    """doc_ids repeat and are null; other columns bear the operators' own names."""
    return spark.createDataFrame([(None if i % 97 == 5 else i // 2, t, i, "x", [1]) for i, t in enumerate(rows)], "doc_id long, text string, block long, pair string, ids array<int>").repartition(5)


def as_table(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def test_pair_index_equals_the_library(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(BYTE)
    rows = texts()
    want = []
    for i, t in enumerate(rows):
        ids = known.encode(t or "", add_special_tokens=False).ids
        want.append((None if i % 97 == 5 else i // 2, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), known.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest(), r.text) for r in bpe.round_trip(table(spark, rows), BYTE).collect()]
    assert as_table(got) == as_table(want)
    assert bpe.round_trip(table(spark, rows).limit(0), BYTE).collect() == []


def test_decoding_of_any_ids_equals_the_library(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(BYTE)
    lists = [[rnd.randrange(50400) for _ in range(rnd.randint(0, 30))] for _ in range(300)]
    rows = [(i, len(x), bytearray(np.array(x, dtype="<u4").tobytes())) for i, x in enumerate(lists)] + [(900, 0, None)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"), BYTE).collect()}
    assert got == {i: known.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {900: ""}


def one_by_one(merges, word):
    """The lowest rank first, the leftmost of its places first."""
    rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
    word = list(word)
    while True:
        found = [(rank[x][0], i) for i, x in enumerate(zip(word, word[1:], strict=False)) if x in rank]
        if not found:
            return word
        i = min(found)[1]
        word[i : i + 2] = [rank[word[i], word[i + 1]][1]]


def test_merging_by_rank_equals_merging_one_by_one():
    for _ in range(60):
        merges, n = [], 3
        for _ in range(rnd.randint(1, 12)):
            pair = (rnd.randrange(n), rnd.randrange(n))
            if pair not in {m[:2] for m in merges}:
                merges.append((*pair, n))
                n += 1
        index = bpe.Merges(np.array([m[:2] for m in merges]), np.array([m[2] for m in merges]))
        words = [[rnd.randrange(3) for _ in range(rnd.randint(1, 30))] for _ in range(20)]
        last = np.zeros(sum(map(len, words)), dtype=bool)
        last[np.cumsum([len(w) for w in words]) - 1] = True
        got, _ = index.apply(np.concatenate(words).astype(np.int64), last)
        assert got.tolist() == [x for w in words for x in one_by_one(merges, w)]
    with pytest.raises(ValueError, match="later merge"):
        bpe.Merges(np.array([[4, 0], [0, 1]]), np.array([3, 4]))


def test_chunks_that_differ_are_never_taken_for_one_another(spark):
    """A text and its complement whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = tokens.Encoder(tokenizer_file(name))
        ids, n = encoder.encode(vectext.Block([thue.encode(), other.encode()], 0))
        assert [ids[: n[0]].tolist(), ids[n[0] :].tolist()] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (thue, other)]
    docs = spark.createDataFrame([(1, thue), (2, other)], "doc_id long, text string")
    assert len({bytes(r.ids) for r in ss_packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2).collect()}) == 2
    path = rans.new_path(spark)
    rans.write_ids(docs, path, BYTE, end_id=0)
    assert len({r.ids_crc32 for r in rans.read_ids(spark, path).collect()}) == 2


def test_a_worker_that_forgets_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    encoder = tokens.Encoder(BYTE)
    for _ in range(9):
        made = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(5)]
        ids, n = encoder.encode(vectext.Block([t.encode() for t in made], 0))
        assert ids.tolist() == [x for t in made for x in encoder.tokenizer.encode(t, add_special_tokens=False).ids] and len(n) == 5
    assert encoder.passing and len(encoder.known) > 60


def brute_align(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back = {bytes([v]).decode("latin1"): k for k, v in bpe.byte_letters().items()}
    letters = {v: ord(k) for k, v in back.items()}
    done, pairs = [], Counter()
    for i, t in enumerate(rows):
        doc = None if i % 97 == 5 else i // 2
        t = t or ""
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        part_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        part_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        raw = (" " + t).encode()
        if not t or b"".join(part_a) != raw or b"".join(part_b) != raw:
            done.append((doc, [], [], [], ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in part_a]).tolist(), np.cumsum([len(x) for x in part_b]).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        said = ";".join(",".join(str(x) for x, e in zip(ids_a, end_a, strict=True) if c0 < e <= c1) + "|" + ",".join(str(x) for x, e in zip(ids_b, end_b, strict=True) if c0 < e <= c1) for c0, c1 in zip([0, *cuts], cuts, strict=False)) if len(raw) < 9000 else None
        linked, j = [], 0
        for x, s, e in zip(ids_a, [0, *end_a], end_a, strict=False):
            while j and end_b[j - 1] > s:
                j -= 1
            while j < len(ids_b) and (end_b[j - 1] if j else 0) < e:
                if end_b[j] > s:
                    linked.append((x, ids_b[j]))
                j += 1
        pairs.update(linked)
        done.append((doc, ids_a, ids_b, linked, (said, len(cuts))))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    out = []
    for doc, ids_a, ids_b, linked, said in done:
        counts = [pairs[x] for x in linked]
        sha = "" if not said else None if said[0] is None else hashlib.sha256(said[0].encode()).hexdigest()
        out.append((doc, len(ids_a), len(ids_b), said[1] if said else 0, len(linked), sum(pairs[x] == most[x[1]] for x in linked), sum(counts), sha))
    return out


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 20_000)
    rows = texts()
    got = [tuple(r) for r in alignment.align(table(spark, rows), BYTE, PIECE).collect()]
    want = brute_align(rows)
    assert as_table(x[:7] for x in got) == as_table(x[:7] for x in want)
    assert sum(1 for w in want if w[1]) > 300 and any(w[1] == 0 and rows[i] for i, w in enumerate(want))
    sure = {str(w[:7]): w[7] for w in want if w[7] is not None}
    assert all(sure.get(str(x[:7]), x[7]) == x[7] for x in got)
    assert alignment.align(table(spark, rows).limit(0), BYTE, PIECE).collect() == []


def test_groups_are_spans_up_to_a_common_end():
    labels = np.frombuffer(b"nanbcnbac", dtype=np.uint8)
    assert [m.group() for m in re.finditer(alignment._GROUP, labels.tobytes())] == [b"nanbc", b"nbac"]
    at, a, b = alignment.links(labels, np.array([1, 2, 3, 4]), np.array([7, 8, 9, 6]))
    assert (at.tolist(), list(zip(a.tolist(), b.tolist(), strict=True))) == ([1, 3, 4, 6, 7, 8], [(1, 7), (2, 7), (2, 8), (3, 9), (3, 6), (4, 6)])


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    n = Counter(len(v) for _, v, _ in kept)
    length = max(n, key=lambda k: (n[k], k))
    kept = sorted((x for x in kept if len(x[1]) == length), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    cut = [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]
    books = [[v[a:z] for _, v, _ in kept[:entries]] for a, z in cut]

    def near(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, z) in enumerate(cut):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(books[p], v[a:z])[1], []).append(v[a:z])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in kept:
        found = [near(books[p], v[a:z]) for p, (a, z) in enumerate(cut)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    by = Counter()
    for _, lab, _, d in out:
        by[lab] += d
    return [(*x, by[x[1]]) for x in out], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize(("length", "n"), [(16, 90), (12, 60), (8, 5)])
def test_vector_codes_equal_brute_force(spark, length, n):
    common = [rnd.choice([-0.5, 0.25, 0.1]) for _ in range(length)]
    rows = [(rnd.choice([i, i, i // 3]), common if i % 3 == 0 else [rnd.choice([0.0, 0.5, -0.25, rnd.gauss(0, 1)]) for _ in range(length)], rnd.choice([None, 1, 1, 2])) for i in range(n)]
    rows += [rows[4], rows[4], (None, common, None), (None, [3.0] * length, 7)]
    bad = [(1, None, 1), (0, [float("nan")] * length, 1), (2, [1.0] * (length - 1) + [None], 1), (3, [], 2), (4, [float("inf")] * length, 2), (-5, [1.0] * (length + 3), 2)]
    df = spark.createDataFrame([(*r, "x", [0.0]) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, value array<double>").repartition(5)
    found, books = vector_codes.compress(df)
    want, sha = brute_codes(rows + bad)
    assert as_table(tuple(r) for r in found.collect()) == as_table(want)
    assert vector_codes.digest(books) == sha
    again, _ = vector_codes.compress(df.repartition(2))
    assert as_table(tuple(r) for r in again.collect()) == as_table(want)


def test_vectors_of_extreme_size_and_none_at_all(spark):
    shape = "vec_id long, embedding array<float>, label int"
    found, books = vector_codes.compress(spark.createDataFrame([(i, [3e38 * (-1) ** i] * 16, 1) for i in range(40)], shape), entries=1)
    assert all(r.error >= 0 for r in found.collect()) and len(books) == 8
    none, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], shape))
    assert none.collect() == [] and books == [] and none.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.compress(spark.createDataFrame([], shape))[0].collect() == []
