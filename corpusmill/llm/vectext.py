"""Array-at-a-time text primitives used by the Arrow operators.

Everything works on UTF-8 bytes joined into one buffer with a separator byte
after each text, so that no word or window crosses a document.  Words and other
ranges get 64-bit hashes: sum(T[byte] * R[position]) modulo 2**64 with random
tables T and R, finished by an avalanche step (powers of one base in place of R
would make texts of a Thue-Morse pattern collide).  Only windows of one short
length use powers.  No step works a word or a row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, np.ndarray] = {}
_POWERS: dict[int, np.ndarray] = {}
_PLACES: list[np.ndarray] = []

#: Bytes of text handled at a time; larger documents form a block of their own.
BLOCK_BYTES = 1 << 20
#: Bytes whose hash terms are computed at a time.
PIECE = 1 << 15


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    if seed not in _TABLES:
        _TABLES[seed] = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=U64, endpoint=False)
    return _TABLES[seed]


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled when more are needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def places(n: int) -> np.ndarray:
    """A random odd number for each position below n; kept and doubled when more are needed."""
    if not _PLACES or len(_PLACES[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        _PLACES[:] = [mix(np.arange(1, size + 1, dtype=U64) * U64(_BASE)) | U64(1)]
    return _PLACES[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix() made the values from."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lookup_table(is_word) -> np.ndarray:
    """256 booleans from a predicate on a byte."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words are runs of anything but the ASCII white space.
NOT_SPACE = lookup_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM = lookup_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


class Block:
    """Some texts as one buffer: ``buf``; text i is buf[start[i]:end[i]], rows first..first+len."""

    __slots__ = ("buf", "end", "first", "start")

    def __init__(self, texts: list[bytes], first: int, sep: bytes = b"\n"):
        self.first = first
        self.buf = np.frombuffer(sep.join(texts) + sep, dtype=np.uint8)
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.end = np.cumsum(lens + 1) - 1
        self.start = self.end - lens

    def __len__(self) -> int:
        return len(self.start)


def lowered(block: Block) -> np.ndarray:
    return np.frombuffer(block.buf.tobytes().translate(LOWER.tobytes()), dtype=np.uint8)


def blocks(column: pa.Array, sep: bytes = b"\n", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows of a binary column; null counts as empty."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, v in enumerate(column.to_pylist()):
        v = v or b""
        if held and size + len(v) > limit:
            yield Block(held, first, sep)
            held, size, first = [], 0, i
        held.append(v)
        size += len(v) + 1
    if held:
        yield Block(held, first, sep)


class Words:
    """Words of a block in order: byte range, owner (row in the block) and hash; ``lo``/``hi`` are each text's range of words."""

    __slots__ = ("doc", "end", "hash", "hi", "lo", "start")

    def __init__(self, block: Block, is_word: np.ndarray = NOT_SPACE, seed: int = 1, buf: np.ndarray | None = None):
        low = lowered(block) if buf is None else buf
        mask = np.frombuffer(low.tobytes().translate(is_word.tobytes()), dtype=bool)
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if len(mask) and mask[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # each text is followed by a separator, so every word ends
        self.lo = np.searchsorted(self.start, block.start)
        self.hi = np.searchsorted(self.start, block.end)
        self.doc = np.repeat(np.arange(len(block)), self.hi - self.lo)
        gap = int((self.start[1:] - self.end[:-1]).max()) if len(self.start) > 1 else 0
        far = gap > PIECE or len(self.start) > 0 and len(low) - int(self.end[-1]) > PIECE
        self.hash = mix(range_hash(low, self.start, self.end, seed) if far else _word_hash(low, self.start, is_word, seed))


def range_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each non-empty byte range; ranges must be disjoint and in order."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    lens = end - start
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total) - np.repeat(first, lens)
    at = pos + np.repeat(start, lens)
    terms = byte_table(seed)[buf[at]] * places(int(lens.max()))[pos]
    return np.add.reduceat(terms, first)


def _word_hash(buf: np.ndarray, start: np.ndarray, is_word: np.ndarray, seed: int) -> np.ndarray:
    """range_hash() of the words that start there: a word goes on to the next one, as the bytes between them add nothing. By pieces that stay in a core's cache."""
    table = np.where(is_word, byte_table(seed), U64(0))
    reach = np.diff(start, append=len(buf))
    own = places(int(reach.max())) if len(start) else None
    out = np.empty(len(start), dtype=U64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(buf) + PIECE, PIECE)))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, z = int(start[lo]), int(start[hi - 1] + reach[hi - 1])
        pos = np.arange(a, z)
        pos -= np.repeat(start[lo:hi], reach[lo:hi])
        terms = table[buf[a:z]]
        terms *= own[pos]
        out[lo:hi] = np.add.reduceat(terms, start[lo:hi] - a)
    return out


def order(x: np.ndarray) -> np.ndarray:
    """What np.argsort() gives, from a sort of the values with their places in the lowest bits, which is much faster; a plain one where these bits decide."""
    bits = U64(len(x).bit_length())
    o = x >> bits << bits | np.arange(len(x), dtype=U64)
    o.sort()
    o = (o & U64((1 << int(bits)) - 1)).astype(np.int64)
    y = x[o]
    return o if (y[1:] >= y[:-1]).all() else np.argsort(x, kind="stable")


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all n consecutive values (len(h)-n+1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(m, 0x243F6A8885A308D3 + 0x9E3779B9 * (n + seed * 64), dtype=U64)
    k = U64(0xD6E8FEB86659FD93)
    for i in range(n):
        out = (out ^ h[i : i + m]) * k
        out ^= out >> U64(32)
    return mix(out)


def rolling(buf: np.ndarray, spans: tuple[int, ...], seed: int) -> list[np.ndarray]:
    """For each span, the hash of each so many consecutive bytes, put together from strings of 1, 2, 4 .. bytes."""
    top = max(spans)
    parts = {1: byte_table(seed)[buf]}
    s = 1
    while 2 * s <= top:
        p = parts[s]
        m = max(0, len(p) - s)
        parts[2 * s] = p[:m] + p[s : s + m] * U64(pow(_BASE, s, 1 << 64))
        s *= 2
    out = []
    for span in spans:
        m, have, acc = max(0, len(buf) - span + 1), 0, None
        for s in sorted(parts, reverse=True):
            if have + s <= span and (span - have) & s:
                term = parts[s][have : have + m]
                acc = term if acc is None else acc + term * U64(pow(_BASE, have, 1 << 64))
                have += s
        out.append(mix(acc[:m]))
    return out
