"""The array primitives of the operators, against plain ones."""

import numpy as np
import pytest

from corpusmill.llm import filters, vectext
from corpusmill.llm.vectext import U64

TEXTS = [b"", b" ", b"One two  TWO\tthree", "naïve – 論文".encode(), b"x" * 70_000, b"a" + b" " * 40_000 + b"b", b" ".join(b"w%d" % (i * i) for i in range(30_000)), b"end"]


@pytest.mark.parametrize("is_word", [vectext.NOT_SPACE, vectext.ALNUM])
@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:4], TEXTS[6:], [b""], [b" \n "]])
def test_word_hashes_are_those_of_their_ranges(texts, is_word):
    block = vectext.Block(texts, 0)
    words = vectext.Words(block, is_word)
    low = vectext.LOWER[block.buf]
    assert (vectext.lowered(block) == low).all()
    want = vectext.mix(vectext.range_hash(low, words.start, words.end, 1))
    assert (words.hash == want).all() and (vectext._word_hash(low, words.start, is_word, 1) == vectext.range_hash(low, words.start, words.end, 1)).all()
    assert is_word[low].sum() == (words.end - words.start).sum()


def test_order_is_that_of_argsort():
    rng = np.random.default_rng(1)
    near = U64(1 << 60) + rng.integers(0, 50, 3000, dtype=U64)  # they differ only in the bits that the places take
    for x in (rng.integers(0, 2**64, 5000, dtype=U64), near, np.concatenate((near, near >> U64(7))), near[:1], near[:0]):
        assert (x[vectext.order(x)] == np.sort(x)).all() and sorted(vectext.order(x).tolist()) == list(range(len(x)))


@pytest.mark.parametrize("keys", [[7], [0, 1, 2, 2**64 - 1], list(range(500)), [x * 0x9E3779B97F4A7C15 % 2**64 for x in range(5000)]])
def test_places_are_found(keys):
    keys = np.sort(np.array(keys, dtype=U64))
    places = filters.Places(keys)
    assert (places(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(np.array([3, 10**6, 2**63, 2**64 - 2], dtype=U64), keys)
    assert not (keys[places(other)] == other).any()
    table = filters.Table(keys.view(np.int64), np.arange(len(keys)))
    hit, value = table.find(np.concatenate((other, keys)))
    assert hit.tolist() == list(range(len(other), len(other) + len(keys))) and value.tolist() == list(range(len(keys)))
