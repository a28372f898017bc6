"""Canonical length-limited Huffman code over token ids, on numpy arrays.

A block holds the ids of consecutive documents. Layout (little-endian):

    magic ``LLHB`` | version u16 | flags u16 | documents u64 | ids u64 |
    lane length u32 | words of the bit stream u32 |
    document ids i64[documents] | null-id marks u8[documents] |
    ids per document u64[documents] | bit offset of every lane u64[lanes] |
    bit stream u32[...], most significant bit first

A lane is a run of ``LANE`` ids; its checkpoint is the bit offset at which it
starts, so lanes decode independently and side by side: each step looks up
one code per lane in a table indexed by the next ``max_bits`` bits.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LLHB"
VERSION = 1
LANE = 256
MAX_BITS = 20
# Ids packed in one go; a multiple of LANE.
_SLICE = 1 << 15
_HEAD = "<4sHHQQII"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for
    symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need codes of more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    n, packages, leaves = len(used), np.empty(0, np.int64), []
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        leaves.append(order < n)
        merged = merged[order]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(leaves):
        here = int(leaf[:take].sum())
        bits[:here] += 1
        take = 2 * (take - here)
    lengths[used] = bits
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    ls = lengths[used].astype(np.int64)
    if len(used):
        # A code of length l covers 2^(top - l) leaves of the full tree.
        top = int(ls.max())
        width = np.left_shift(np.int64(1), top - ls)
        first = np.cumsum(width) - width
        out[used] = (first >> (top - ls)).astype(np.uint64)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol * 32 + length) for every value of the next ``top`` bits."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    ls = lengths[used].astype(np.int64)
    top = int(ls.max()) if len(used) else 1
    table = np.zeros(1 << top, np.uint32)
    entries = (used.astype(np.uint32) << np.uint32(5)) | ls.astype(np.uint32)
    filled = np.repeat(entries, np.left_shift(np.int64(1), top - ls))
    table[:len(filled)] = filled
    return table, top


def packing_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, code moved to the top of 64 bits) per id."""
    bits = lengths.astype(np.int64)
    return bits, np.where(bits > 0, codes(lengths) << (64 - np.maximum(bits, 1)).astype(np.uint64),
                          np.uint64(0))


def pack(ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bit stream words, bit offset of each lane)."""
    lengths, tops = tables
    lanes, pieces, at = [], [], 0
    for k in range(0, len(ids), _SLICE):
        part = ids[k:k + _SLICE]
        bits = lengths[part]
        if not bits.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(bits)
        ends += at
        begin = ends - bits
        lanes.append(begin[::LANE])
        # A code of at most 32 bits touches the word it starts in and the next.
        word = begin >> 5
        value = tops[part] >> (begin & 31).astype(np.uint64)
        word -= word[0]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        value = np.add.reduceat(value, first)
        here = np.zeros(int(word[-1]) + 2, np.uint32)
        here[word[first]] = value >> np.uint64(32)
        here[word[first] + 1] |= (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        pieces.append((int(begin[0] >> 5), here))
        at = int(ends[-1])
    words = np.zeros((at + 31) // 32 + 1, np.uint32)
    for start, here in pieces:
        words[start:start + len(here)] |= here[:len(words) - start]
    return words, np.concatenate(lanes or [np.empty(0)]).astype(np.uint64)


def unpack(words: np.ndarray, lanes: np.ndarray, n: int, table: np.ndarray, top: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint32)
    wide = words.astype(np.uint64)
    pairs = np.zeros(len(wide) + 1, np.uint64)
    pairs[:-1] = wide << np.uint64(32)
    pairs[:-2] |= wide[1:]
    at, last = lanes.astype(np.int64), len(pairs) - 1
    out = np.empty((LANE, len(at)), np.uint32)
    mask = np.uint64((1 << top) - 1)
    for step in range(LANE):
        window = pairs[np.minimum(at >> 5, last)] >> (64 - top - (at & 31)).astype(np.uint64)
        hit = table[(window & mask).astype(np.int64)]
        out[step] = hit >> np.uint32(5)
        at += hit & np.uint32(31)
    return out.T.reshape(-1)[:n]


def write_block(doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray,
                tables: tuple[np.ndarray, np.ndarray]) -> bytes:
    words, lanes = pack(ids, tables)
    head = struct.pack(_HEAD, MAGIC, VERSION, 0, len(doc_ids), len(ids), LANE, len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(),
                     sizes.astype("<u8").tobytes(), lanes.astype("<u8").tobytes(),
                     words.astype("<u4").tobytes()])


def read_block(blob: bytes, table: np.ndarray, top: int):
    """(document ids, null marks, ids per document, all ids)."""
    magic, version, _, docs, n, lane, words = struct.unpack_from(_HEAD, blob)
    if magic != MAGIC or version != VERSION or lane != LANE:
        raise ValueError("not a block of this format")
    at = struct.calcsize(_HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, sizes = take("<i8", docs), take("u1", docs), take("<u8", docs)
    lanes, stream = take("<u8", -(-n // lane)), take("<u4", words)
    return doc_ids, nulls, sizes, unpack(stream, lanes, n, table, top)
