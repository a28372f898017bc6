"""Operator 11: dual-tree search against scoring every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import dual_tree, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(rows, items, top=50):
    counted = [(i, Counter(plain_terms(t))) for i, t, *_ in rows]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda r: r[:3])
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(found[:top])]
    return sorted(out, key=str)


def some_words(rng, n):
    return " ".join(rng.choice("ab Straße日 c9 dé x_y Q-r".split())
                    + str(int(rng.paretovariate(0.6)) % 40) for _ in range(n))


@pytest.fixture
def ranked(docs, spark):
    def run(rows, items, **kw):
        bench = spark.createDataFrame([(*i, 1, "x") for i in items],
                                      "item_id long, text string, rank int, doc_id string")
        return sorted((tuple(r) for r in lexical.ranked(docs(rows), bench, **kw).collect()), key=str)
    return run


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, some_words(rng, rng.randrange(1, 60))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(80)]  # copies: ties beyond the top
    rows += [(None, rows[5][1]), (7, rows[5][1]), (7, rows[5][1]), (9000, None), (9001, ""),
             (9002, "... --- !!"), (9003, "ab1 " * 4000), (-5, rows[3][1])]
    items = [(i, some_words(rng, rng.randrange(1, 15))) for i in range(30)]
    items += [(50, None), (51, "!"), (52, rows[3][1]), (52, rows[3][1]), (53, "nowhere"), (None, "ab1")]
    return rows, items


def test_against_scoring_every_pair(ranked):
    rows, items = corpus(1, 300)
    assert ranked(rows, items) == brute_force(rows, items)
    assert ranked(rows, items, top=3) == brute_force(rows, items, 3)


def test_rounds_and_blocks_change_nothing(ranked, monkeypatch):
    rows, items = corpus(2, 300)
    monkeypatch.setattr(lexical, "ROUND", 3)
    monkeypatch.setattr(lexical, "FIRST", 10)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 32)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    monkeypatch.setattr(lexical, "PIECE", 50)
    assert len(lexical._shares(388)) == 4
    assert ranked(rows, items) == brute_force(rows, items)


def test_empty_tables(ranked):
    assert ranked([], [(1, "word")]) == []
    assert ranked([(1, "word")], []) == []
    assert ranked([(1, None)], [(1, "word")]) == []


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 16)
    data = some_words(random.Random(4), 300).encode()
    assert b"".join(lexical.pieces(data)) == data
    assert [t for p in lexical.pieces(data) for t in lexical.terms(p)] == lexical.terms(data)


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    groups = [rng.choice(400, 60, replace=False) for _ in range(12)]

    def sparse(n, size):
        sets = [np.sort(rng.choice(groups[rng.integers(12)], size, replace=False)) for _ in range(n)]
        return np.arange(0, (n + 1) * size, size), np.concatenate(sets)

    items = dual_tree.Items(*sparse(64, 12), 400)
    start, coord = sparse(64, 12)
    items = dual_tree.Items(start, coord, 400)
    search = dual_tree.Search(items, 5, np.zeros(64, np.int64))
    dense = []
    for batch in range(4):
        s, c = sparse(1500, 20)
        v = rng.integers(1, 1000, len(c))
        search.add([(1, -(batch * 1500 + k)) for k in range(1500)], s, c, v)
        for k in range(1500):
            row = np.zeros(400, np.int64)
            row[c[s[k]:s[k + 1]]] = v[s[k]:s[k + 1]]
            dense.append(row)
    scores = np.array(dense) @ np.array([np.bincount(coord[start[i]:start[i + 1]], minlength=400)
                                         for i in range(64)]).T
    want = {(i, int(scores[d, i]), d) for i in range(64)
            for d in sorted(range(6000), key=lambda d: (-scores[d, i], d))[:5] if scores[d, i] > 0}
    assert {(i, s, -d) for i, s, (_, d) in search.results()} == want
    assert search.scored < 64 * 6000 / 4
