"""Word and shingle hashing of text chunks, vectorised.

Words are maximal runs of bytes other than ASCII white space; A-Z count as
a-z. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

# Bytes of text handled in one go (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
PLACE = _rng.integers(1, 2 ** 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False

# Words for matching across punctuation: letters, digits and bytes of
# non-ASCII characters.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[65:91] = IS_ALNUM[97:123] = True
IS_ALNUM[128:] = True


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its
    task, and idle workers count against the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Word hashes of chunks; keeps its tables of powers between calls."""

    def __init__(self, inside: np.ndarray = IS_WORD):
        self.inside = inside
        self.up = self.down = np.empty(0, np.uint64)

    def words(self, texts: list[bytes]):
        """(hash, begin byte, end byte, text) of every word, with byte offsets
        into the texts joined by one separator; and the texts' offsets."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.cumsum(sizes + 1) - sizes - 1
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if len(buf) > len(self.up):
            self.up, self.down = powers(STEP, len(buf)), powers(STEP_INVERSE, len(buf))
        inside = self.inside[buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        begin, end = edge[::2], edge[1::2]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE[buf] * self.up[:len(buf)], out=total[1:])
        h = mixed((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        return h, begin, end, np.searchsorted(offsets, begin, side="right") - 1, offsets


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Slices (from, to) of ``texts`` holding about ``limit`` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start = i
            size = 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def shingles(h: np.ndarray, text: np.ndarray, n_texts: int, k: int = SHINGLE):
    """(shingle hash, text) of all k-word shingles; a text of fewer words has
    one, its whole sequence; a text without words has none."""
    counts = np.bincount(text, minlength=n_texts)
    if len(h) >= k:
        total = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            total += h[j:len(h) - k + 1 + j] * PLACE[j]
        whole = text[:len(h) - k + 1] == text[k - 1:]
        out, owner = total[whole], text[:len(h) - k + 1][whole]
    else:
        out, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    short, who = [out], [owner]
    for m in range(1, k):
        those = np.flatnonzero(counts == m)
        if len(those):
            total = np.full(len(those), PLACE[8 + m], np.uint64)
            for j in range(m):
                total += h[first[those] + j] * PLACE[j]
            short.append(total)
            who.append(those)
    return mixed(np.concatenate(short)), np.concatenate(who)


def distinct_per_text(hashes: np.ndarray, owner: np.ndarray, n_texts: int):
    """Hashes sorted and distinct within each text, and the count per text.
    ``owner`` need not be sorted."""
    order = np.argsort(owner, kind="stable")
    hashes, counts = hashes[order], np.bincount(owner, minlength=n_texts)
    ends = np.cumsum(counts)
    for b, c in zip(ends.tolist(), counts.tolist()):
        hashes[b - c:b].sort()
    owner = owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.bincount(owner[first], minlength=n_texts)
