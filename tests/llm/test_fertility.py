"""Operator 12: base counts, measures and bands against plain forms."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from ledgerlens.llm import fertility

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATHS = [public_tokenizers.path(p) for p in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]


def rules(df, **kw):
    return fertility.quality_rules(df, PATHS, public_tokenizers.PATTERN, **kw)


def plain_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    inside = set()
    for k in range(len(found) - 2):
        if windows[tuple(found[k:k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


def plain_measures(text):
    vocabularies = [fertility._built(*fertility.vocabulary(p, public_tokenizers.PATTERN))
                    for p in PATHS]
    found = WORD.findall(text)
    out = []
    for v in vocabularies:
        ids = Counter(i for w in found for i in v.encode([w])[0])
        n = sum(ids.values())
        out += [sum(map(len, found)) / n, sum(c for i, c in ids.items() if v.is_byte[i]) / n,
                -sum(c / n * math.log2(c / n) for c in ids.values())]
    return out


def some_text(rng, size):
    return "".join(rng.choice(["a ", "word ", "straße ", "日本 ", "#% ", "x\n", "x\n", "\t", " <b> ",
                               "é\x0b", " ", "🙂"]) for _ in range(size))


def test_counts_against_the_plain_form(docs):
    rng = random.Random(5)
    rows = [(i, some_text(rng, rng.randrange(0, 120))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, "a a a a"), (94, "a a a"), (95, "a b c a b"),
             (95, "a b c a b"), (96, "same\nsame\n same\nsame"), (None, "no id at all"),
             (97, "one two three " * 30), (98, "x" * 30_000), (99, "word " * 400_000)]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
            r.base_failed) for r in rules(docs(rows)).collect()}
    want = set()
    for i, text in rows:
        c = plain_counts(text)
        want.add((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == want


def test_measures_against_the_plain_form(docs):
    rng = random.Random(6)
    rows = [(i, some_text(rng, 80)) for i in range(12)] + [(20, "naïve Σύ 漢字 ไทย \U00010348 end")]
    for r in rules(docs(rows)).collect():
        want = plain_measures(dict(rows)[r.doc_id])
        got = [r.chars_0, r.bytes_0, r.bits_0, r.chars_1, r.bytes_1, r.bits_1]
        assert got == pytest.approx(want, abs=1e-9)


def test_long_texts_are_measured_whole(monkeypatch):
    rng = random.Random(7)
    text = some_text(rng, 3000).encode()
    monkeypatch.setattr(fertility, "PIECE", 100)
    assert b"".join(fertility.pieces(text)) == text
    assert [w for p in fertility.pieces(text) for w in p.split()] == text.split()
    assert list(fertility.pieces(b"y" * 1000)) == [b"y" * 1000]
    assert list(fertility.pieces(b"")) == [b""]


def prose(rng, n):
    """Words of a Zipf-like vocabulary."""
    vocabulary = [f"{a}{b}" for a in ("the", "over", "in", "water", "hand", "time", "night", "some")
                  for b in ("", "s", "ing", "ed", "er", "like", "ful", "less")]
    return " ".join(vocabulary[min(int(rng.paretovariate(0.7)) - 1, 63)] if rng.random() < 0.5
                    else rng.choice(vocabulary) for _ in range(n))


def test_bands_reject_what_stands_out_and_keep_the_rest(docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "en") for i in range(300)]
    odd = [(1000 + i, " ".join("".join(rng.choice("0123456789abcdef$#%") for _ in range(14))
                               for _ in range(120)), "en") for i in range(5)]
    flat = [(2000, " ".join(rng.choice(("ha", "hi", "ho")) + rng.choice("..!") for _ in range(120)), "en")]
    out = {r.doc_id: r for r in rules(docs(rows + odd + flat)).collect()}
    assert all(out[i].kept for i, *_ in rows if not out[i].base_failed)
    assert sum(out[i].base_failed for i, *_ in rows) < 10
    assert not any(out[i].kept for i, *_ in odd) and out[1000].broken
    assert not out[2000].kept


def test_copies_do_not_become_the_norm(docs):
    rng = random.Random(9)
    copy = " ".join(f"{k}x{k * 7919 % 1000}$" for k in range(120))
    rows = [(i, prose(rng, 120), "en") for i in range(260)] + [(1000 + i, copy, "en") for i in range(600)]
    out = {r.doc_id: r for r in rules(docs(rows)).collect()}
    assert not any(out[i].kept for i in range(1000, 1600))
    assert sum(out[i].kept for i in range(260)) > 240


def test_scripts_and_small_groups(docs):
    rows = [(0, "привет мир " * 3, None), (1, "漢字 かな 漢字", None), (2, "123 456", None),
            (3, "abc где abc", None), (4, "한국어 문장", None)]
    out = {r.doc_id: r.script for r in rules(docs(rows)).collect()}
    assert out == {0: "Cyrillic", 1: "Han", 2: "none", 3: "Latin", 4: "Hangul"}
    assert rules(docs([])).count() == 0
    assert rules(docs([(1, "a")]), lang_col=None).count() == 1


def test_verdicts_do_not_depend_on_the_dealing(docs):
    rng = random.Random(10)
    df = docs([(i, prose(rng, 100), "en") for i in range(250)])
    first = sorted(tuple(map(str, r)) for r in rules(df.repartition(1)).collect())
    assert first == sorted(tuple(map(str, r)) for r in rules(df.repartition(5)).collect())
