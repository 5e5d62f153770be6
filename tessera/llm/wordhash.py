"""Word hashes of many texts at once (numpy): polynomial hashes modulo 2^64
with a final mix, and hashes of word sequences from prefix sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo 2^64
_SEQ = 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.where(_WHITE, 0, np.arange(256) + 1).astype(U)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)]) & ~_WHITE
#: What makes a word, by byte: 0 parts words, a change of the number parts them too.
BLANKS = (~_WHITE).astype(np.uint8)  # by white space alone
LETTERS = np.where(_MARK, 0, BLANKS).astype(np.uint8)  # ASCII marks part words
MARKS = np.where(_MARK, 2, BLANKS).astype(np.uint8)  # runs of marks are words
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse for i < n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p))
        have = _tables[base] = tuple(both)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@dataclass
class Words:
    """Words of several texts in order: text number, place in the text, hashes."""

    doc: np.ndarray
    pos: np.ndarray
    first: np.ndarray  # per text: index of its first word
    count: np.ndarray  # per text: number of words
    hashes: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.doc)


def hash_words(texts: list[bytes], n_hashes: int = 1, lower: bool = False, kinds: np.ndarray = BLANKS,
               prefix: int = 0, piece: int = 1 << 22) -> Words:
    """``prefix``: a last array hashes the first bytes of each word (zero for
    words that are no longer)."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    offsets = np.cumsum(sizes) - sizes
    kind = kinds[buf]
    new = np.ones(len(buf), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    starts = np.flatnonzero(new & (kind > 0))
    ends = np.flatnonzero(new[1:] & (kind[:-1] > 0)) + 1  # the last byte is white, so words end
    doc = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    first = np.cumsum(count) - count
    hashes = [np.empty(len(starts), dtype=U) for _ in range(n_hashes)]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        rel = starts[at:to] - lo
        values = (_LOWER if lower else _VALUE)[buf[lo:hi]]
        if kinds is not BLANKS:
            values[kind[lo:hi] == 0] = 0
        for base, out in zip(_BASES, hashes):
            up, down = _powers(base, hi - lo)
            out[at:to] = mix(np.add.reduceat(values * up[: hi - lo], rel) * down[rel])
        at = to
    if prefix:
        up, _ = _powers(_BASES[0], prefix)
        head = np.zeros(len(starts), dtype=U)
        for j in range(prefix):
            head += (_LOWER if lower else _VALUE)[buf[np.minimum(starts + j, len(buf) - 1)]] * up[j]
        hashes.append(np.where(ends - starts > prefix, mix(head), U(0)))
    pos = np.arange(len(starts)) - first[doc] if len(starts) else doc
    return Words(doc, pos, first, count, hashes)


class Sequences:
    """Hashes of any word ranges of one hash array."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(_SEQ, len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(h * up[: len(h)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(_BASES[0]))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` hashes (text borders are the caller's)."""
    if len(h) < n:
        return np.empty(0, dtype=U)
    up, _ = _powers(_SEQ, n)
    total = h[: len(h) - n + 1] * up[0]
    for i in range(1, n):
        total += h[i: len(h) - n + 1 + i] * up[i]
    return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        more = width - have
        x = np.minimum(x[:-more], x[more:])
    return x
