"""Rows and texts that must not be taken for one another: null and repeated doc_ids, colliding patterns, any partitioning."""

import hashlib
import random

import pytest

from corpusmill.llm import merkle, quality, suffix_dedup

rnd = random.Random(41)
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def noise(n):
    return "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))


def test_rows_without_an_id_lose_only_what_repeats(spark):
    text = noise(150)
    single = [noise(rnd.randint(100, 160)) for _ in range(600)]
    rows = [(1, text), (None, text), (2, text)] + [(None, t) for t in single] + [(3, t) for t in (noise(200), noise(200))]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    gone = {}
    for r in got:
        gone.setdefault(r.doc_id, []).append(r.n_removed)
    assert gone[1] == [0] and gone[2] == [150] and gone[3] == [0, 0]
    assert sorted(gone[None]) == [0] * 600 + [150]


def test_lengths_that_a_row_cannot_tell_are_refused(spark):
    with pytest.raises(ValueError, match="bytes are found"):
        suffix_dedup.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=400)


def digest(parts, level):
    return hashlib.blake2b(parts, digest_size=16, person=level).digest()


def root_by_hand(text, cuts):
    """cuts: sections of paragraphs of passages."""
    return digest(b"".join(digest(b"".join(digest(b"".join(digest(x.encode(), b"passage") for x in para), b"paragraph") for para in section), b"section") for section in cuts), b"root").hex()


def test_roots_are_digests_of_digests():
    one = merkle.fingerprints([b"x"])[0]
    assert one.split(":")[0] == root_by_hand("x", [[["x"]]])
    assert merkle.fingerprints([b"x\ny\n\nz"])[0].split(":")[0] == root_by_hand("", [[["x\n"], ["y\n"], ["\n"]], [["z"]]])
    a, b = merkle.fingerprints([THUE.encode(), OTHER.encode()])
    assert a != b and merkle.likeness(a, b) == 0


def test_likeness_equals_a_plain_comparison_of_trees():
    """Bytes of sections, then paragraphs, then passages that both have, by the printed leaves alone."""

    def levels(fp):
        sections, paragraphs, lens, hashes = (x.tolist() for x in merkle.parse(fp))
        leaf = list(zip(lens, hashes, strict=True))
        paras, at = [], 0
        for n in paragraphs:
            paras.append(tuple(leaf[at : at + n]))
            at += n
        made, at = [], 0
        for n in sections:
            made.append(tuple(paras[at : at + n]))
            at += n
        return made

    def size(x):
        return x[0] if isinstance(x[0], int) else sum(size(y) for y in x)

    def shared(a, b, level=0):
        total, rest_a, left = 0, [], list(b)
        for x in a:
            if x in left:
                left.remove(x)
                total += size(x)
            else:
                rest_a.append(x)
        return total if level == 2 else total + shared([y for x in rest_a for y in x], [y for x in left for y in x], level + 1)

    for _ in range(60):
        lines = [noise(rnd.randint(0, 90)) for _ in range(8)]
        texts = ["\n".join(rnd.choice([*lines, ""]) for _ in range(rnd.randint(1, 12))) for _ in range(2)]
        a, b = merkle.fingerprints([t.encode() for t in texts])
        x, y = levels(a), levels(b)
        total = sum(map(size, x)) + sum(map(size, y)) if x and y else 0
        want = 1.0 if texts[0] == texts[1] else round(2 * shared(x, y) / total, 6) if total else 0.0
        assert merkle.likeness(a, b) == want


def test_the_classifier_does_not_depend_on_how_rows_are_dealt(spark):
    bad, good = ["awful", "hate", "stupid"], ["river", "stone", "cloud", "light"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rnd.choice(bad if toxic and rnd.random() < 0.5 else good) for _ in range(40)), "en", f"s{i % 4}"))
        labels.append((i, int(not toxic), int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s1") for i in range(0, 100, 3)]
    labels += [(1000 + i, i % 2, i % 2) for i in range(0, 100, 3)]
    docs, said = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [sorted(map(str, quality.judge(docs.repartition(n), said.repartition(n)).drop("text_hash").collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
