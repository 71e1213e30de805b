"""Word shingles of whole texts as sorted distinct 64-bit hashes, vectorised over many documents.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased;
a set holds the distinct shingles of five consecutive words, or the whole
sequence when there are fewer. No words, no shingles.
"""

from __future__ import annotations

import numpy as np

from tabulon.llm.shared import runs

SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = _rng.integers(1, 2**64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        seq = np.full(max(n, 1 << 16), base, np.uint64)
        seq[0] = 1
        have = np.multiply.accumulate(seq)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(offsets: np.ndarray, raw: np.ndarray):
    """(document index, hash, first byte, end byte) of every word, in text order."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, n), out=total[1:])
    h = mix64((total[e] - total[s]) * _power(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
    return np.searchsorted(offsets, s, side="right") - 1, h, s, e


def word_hashes_by_doc(offsets, raw):
    """(number of words of each document, hashes of all words in order)."""
    doc, h, _, _ = words(offsets, raw)
    return np.bincount(doc, minlength=len(offsets) - 1), h


def sets_of_run(offsets: np.ndarray, raw: np.ndarray):
    """(number of distinct shingles per document, their hashes sorted within each document)."""
    docs = len(offsets) - 1
    per, h = word_hashes_by_doc(offsets, raw)
    k, m = SHINGLE_WORDS, len(h)
    ends = np.cumsum(per)
    doc_of = np.repeat(np.arange(docs), per)
    if m >= k:
        s = h[: m - k + 1] * _MIX[0]
        for j in range(1, k):
            s += h[j:m - k + 1 + j] * _MIX[j]
        whole = doc_of[: m - k + 1] == doc_of[k - 1:]
        owner, s = doc_of[: m - k + 1][whole], s[whole]
    else:
        owner, s = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        start = ends[short] - per[short]
        few = per[short].astype(np.uint64) * _MIX[k]
        for j in range(k - 1):
            there = per[short] > j
            few[there] += h[start[there] + j] * _MIX[k + 1 + j]
        owner, s = np.concatenate([owner, short]), np.concatenate([s, few])
    s = mix64(s)
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    owner, s = owner[fresh], s[fresh]
    return np.bincount(owner, minlength=docs), s


def shingle_sets(offsets: np.ndarray, raw: np.ndarray):
    """Yield (i, j, sizes, hashes) for runs i..j of documents."""
    for i, j in runs(offsets):
        lo, hi = offsets[i], offsets[j]
        sizes, flat = sets_of_run(offsets[i:j + 1] - lo, raw[lo:hi])
        yield i, j, sizes, flat


def parity_bits(hashes: np.ndarray) -> bytes:
    """Parity bitmap of a set: bit (hash mod B) flips once per element, B = power of two >= size, 64 at least.

    Two bitmaps (folded to one width) differ in at most as many bits as the
    sets differ in elements, so their xor bounds the overlap from above.
    """
    n = len(hashes)
    b = max(64, 1 << max(0, int(n - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

