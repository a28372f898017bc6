"""Shape features of texts, from their bytes and words alone."""

from __future__ import annotations

import numpy as np

from ledgerlens.llm import words

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = ~(_LETTER | _DIGIT | ~words.IS_WORD)
_END = np.zeros(256, bool)
_END[[33, 44, 46, 59, 63]] = True  # ! , . ; ?

NAMES = ("log_words", "word_length", "word_length_spread", "upper_share", "symbol_share",
         "digit_share", "newline_share", "distinct_share", "repeat_share", "capital_words",
         "ended_words", "bare_symbol_words", "inner_symbol_words", "symbol_end_words",
         "common_words", "line_length")


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n)


def matrix(texts: list[bytes], hasher: words.Hasher) -> np.ndarray:
    """texts x features; all 0 for a text without words."""
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    h, begin, end, owner, offsets = hasher.words(texts)
    if not len(h):
        return out
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.float64, n)
    count = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(count, 1)
    chars = np.maximum(sizes, 1)
    length = (end - begin).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[buf])])
        stop = np.append(offsets[1:], len(buf))
        return (total[stop] - total[offsets]) / chars

    newline = np.zeros(256, bool)
    newline[10] = True
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    in_word = (symbols[end] - symbols[begin]).astype(float)
    last = buf[end - 1]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    mean = _sums(length, owner, n) / some
    spread = np.sqrt(np.maximum(_sums(length ** 2, owner, n) / some - mean ** 2, 0))
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    ho, oo = h[order], owner[order]
    fresh[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    distinct = _sums(fresh, oo, n)
    breaks = share(newline)
    columns = (
        np.log1p(count), mean, spread, share(_UPPER), share(_SYMBOL), share(_DIGIT), breaks,
        # expected to fall with length: put on a scale that stays level
        np.log1p(distinct) / np.log1p(some), _sums(same, owner, n) / some,
        _sums(_UPPER[buf[begin]], owner, n) / some, _sums(_END[last], owner, n) / some,
        _sums(in_word == length, owner, n) / some,
        _sums((in_word >= 2) & (in_word < length), owner, n) / some,
        _sums(_SYMBOL[last] & ~_END[last], owner, n) / some,
        _sums(length <= 3, owner, n) / some, np.log1p(1 / (breaks + 1 / chars)))
    for k, c in enumerate(columns):
        out[:, k] = c
    out[count == 0] = 0
    return out
