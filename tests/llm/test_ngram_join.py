import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import ngram_join, trie, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def brute(rows):
    """{(doc_id, n_shingles, component_id)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 and base:
            text = list(rng.choice(base))
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))]
            if kind > 0.8:
                text += passage
            base.append(text)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    hub = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(n, n + 60):  # a large group of near copies
        text = list(hub)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id)
                  for r in ngram_join.ngram_components(df).collect())


@pytest.mark.parametrize("block", [100_000, 400])
def test_equals_all_pairs(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rows = corpus()
    assert result(docs(rows)) == brute(rows)


def test_edge_cases(docs):
    rows = [(5, "A b c"), (4, "a B  c"), (3, None), (2, ""), (1, " \n"), (9, "one two three four five"),
            (8, "one two three four five"), (8, "one two three four five"), (7, "x")]
    assert result(docs(rows)) == brute(rows)
    kept = ngram_join.drop_near_copies(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8]  # one of the two 8s


def test_null_id_is_least(docs):
    found = ngram_join.ngram_components(docs([(None, "a b c d e f"), (3, "a b c d e f")]))
    got = [(r.doc_id, r.component_id) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(None, None), (3, None)], key=str)


def test_empty_table(docs):
    assert result(docs([])) == []


def test_threshold_is_exact():
    # 3 (a + b) / 7 elements are the least overlap of linked sets.
    for a in range(1, 60):
        for b in range(1, 60):
            need = trie.needed(a, b)
            linked = [o for o in range(min(a, b) + 1) if 100 * o >= 75 * (a + b - o)]
            assert (min(linked) if linked else None) == (need if need <= min(a, b) else None)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 60, (12, 25))
    sets = [np.unique(np.where(rng.random(25) < 0.1, rng.integers(0, 60, 25), base[k % 12]))
            .astype(np.uint64) for k in range(120)]
    freq = np.bincount(np.concatenate(sets).astype(int), minlength=60)
    freqs = [freq[s.astype(int)] for s in sets]
    sizes = np.array([len(s) + int(rng.integers(0, 4)) for s in sets])
    got = set(trie.links((sets[:50], freqs[:50], sizes[:50]), (sets[50:], freqs[50:], sizes[50:])))
    want = {(i, j) for i in range(50) for j in range(70)
            if len(np.intersect1d(sets[i], sets[50 + j])) >= trie.needed(sizes[i], sizes[50 + j])}
    assert got == want and want


def test_word_hashes_see_words_only():
    h = words.Hasher()
    a = h.words([b"One  two\tthree", b"", b"one\x0btwo"])
    assert a[0][0] == a[0][3] and a[0][1] == a[0][4]
    assert a[3].tolist() == [0, 0, 0, 2, 2] and len(set(a[0].tolist())) == 3


def test_bitmaps_lose_no_link(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.choice(900, (3, 200), replace=False)  # most sets near the first
    sets = [np.unique(np.where(rng.random(200) < 0.06, rng.integers(0, 3000, 200), base[max(0, k % 5 - 2)]))
            .astype(np.uint64) for k in range(200)] + [np.empty(0, np.uint64)]
    freq = np.bincount(np.concatenate(sets).astype(int), minlength=3000)
    freqs, sizes = [freq[s.astype(int)] for s in sets], np.array([len(s) for s in sets])
    sides = [(sets[a], freqs[a], sizes[a]) for a in (slice(0, 60), slice(60, None))]
    found = []
    for bits in (2048, 64):
        for least in (1, 10 ** 9):
            monkeypatch.setattr(trie, "HEAD_SETS", least)
            monkeypatch.setattr(trie, "HEAD_BITS", bits)
            found.append((sorted(trie.links(*sides)), trie.components(sets, freqs, sizes).tolist()))
    assert found[0][0] and all(f == found[0] for f in found)


def test_a_shingle_goes_out_in_few_bytes_however_many_the_ranges():
    # Sets have few shingles in each of many ranges: what names a set there
    # must not outweigh them.
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(200), pa.int64()), "_text": texts})
    (out,) = list(ngram_join._send(2000)([batch]))
    dealt = [len(p) for r, p in zip(out.column("range").to_pylist(), out.column("payload").to_pylist()) if r >= 0]
    assert sum(dealt) < 22 * 200 * 196


def test_families_that_chance_joins_are_cut(docs, monkeypatch):
    rng = random.Random(8)
    word = (f"w{k}" for k in range(10 ** 6))
    pairs, rows = 12, []
    passages = [[next(word) for _ in range(12)] for _ in range(pairs)]
    for k in range(pairs):
        text = [next(word) for _ in range(1000)]
        copy = list(text)
        for at in rng.sample(range(1000), 15):
            copy[at] = next(word)
        # Passages that only the neighbours have.
        rows += [(2 * k, " ".join(text + passages[k] + passages[k - 1])), (2 * k + 1, " ".join(copy))]
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2500)
    seen, kernel = [], ngram_join._join_families
    monkeypatch.setattr(ngram_join, "_join_families",
                        lambda sets, **k: seen.append(sets.select("sid", "family").collect()) or kernel(sets, **k))
    assert result(docs(rows)) == brute(rows)
    assert len({bytes(r.family) for r in seen[0]}) == pairs
