"""Edge cases and brute-force comparisons of the operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import (cgk, chat, decontamination, exact_dedup, huffman, language_id, licenses,
                            line_dedup, mixing, ppm, quality, token_output)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "It's  10 o'clock,\n<|endoftext|> ÉTÉ été! x<|STARTOFTEXT|>y"), (2, None), (3, ""),
       (None, "no id here"), (4, "a.b,c!d?e;f:g  h i 中文 🙂"), (4, "again the id 4"),
       (5, "word " * 3000), (6, "''s 'll can't WE'VE...'re"), (6, "''s 'll can't WE'VE...'re")]


# 1
def test_targets_stop_at_the_cap_and_reshare():
    sizes = {"a": 10, "b": 100, "c": 100, None: 0}
    got = mixing.capped_targets(sizes, mixing.cyclic_weights(list(sizes)), 3.0)
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(120) and got["c"] == pytest.approx(60)
    assert sum(got.values()) == pytest.approx(210)


def test_mix_meets_targets(docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 200), "en", rng.choice(["a", "b", "c", "d", None]))
            for i in range(600)] + [(None, "x y", "en", "a"), (7, "x", "en", "a"), (8, None, "en", "e")]
    out = mixing.mix(docs(rows)).collect()
    assert len(out) == len(rows)
    for source in ("a", "b", "c", "d", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100
        assert all(r.taken <= 3 * r.size for r in mine)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs(rows)).collect()))
    mixed = mixing.apply_mix(docs(rows))
    assert mixed.columns == docs(rows).columns
    assert mixed.count() == sum(r.copies for r in out)


def test_base_rates_are_balanced(docs):
    from pyspark.sql import functions as F
    df = docs([(i, "w " * (1 + i % 9), "en", "ab"[i % 2]) for i in range(400)])
    out = mixing.mix(df, base=F.when(F.col("doc_id") < 200, 2.5).otherwise(0.5)).collect()
    for s in "ab":
        mine = [r for r in out if r.source == s]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(mine[0].target, rel=1e-4)


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).collect() == []


# 2
def test_code_lengths_follow_the_definition():
    texts = [b"abracadabra", b"abcabc"]
    model = ppm.Model(["x"], [ppm.grams(texts)])
    counts = {}
    for t in texts:
        padded = ppm.PAD + t
        for i in range(3, len(padded)):
            for order in range(4):
                ctx = (order, padded[i - order:i])
                counts.setdefault(ctx, {}).setdefault(padded[i], 0)
                counts[ctx][padded[i]] += 1

    def probability(context, symbol, order=3):
        if order < 0:
            return 1 / 256
        seen = counts.get((order, context[len(context) - order:]))
        if not seen:
            return probability(context, symbol, order - 1)
        total = sum(seen.values()) + len(seen)
        if symbol in seen:
            return seen[symbol] / total
        return len(seen) / total * probability(context, symbol, order - 1)

    for text in (b"abra", b"zebra", b"", b"ccab\xc3\xa9"):
        padded = ppm.PAD + text
        want = -sum(np.log2(probability(padded[i - 3:i], padded[i])) for i in range(3, len(padded)))
        assert model.bits([text, b"q"])[0, 0] == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_languages_are_told_apart(docs):
    rng = random.Random(2)
    kinds = {"aa": ["tion", "ing", "the"], "bb": ["ung", "sch", "der"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k)
            for i, k in enumerate(["aa", "bb"] * 60)]
    df = docs(rows + [(500, None, None), (501, "12 34 !!", "aa"), (None, "the the tion", None)])
    out = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows)
    assert out[500].lang_pred == out[501].lang_pred == "und" and out[None].lang_pred == "aa"
    kept = language_id.drop_unknown(df, language_id.train(df), tuple(df.columns))
    assert kept.columns == df.columns and kept.count() == 121


def test_no_labels_means_unknown(docs):
    df = docs([(1, "some text", None)])
    got = language_id.predict(df, language_id.train(df)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language_id.predict(docs([]), language_id.train(df)).collect() == []


# 3
def test_chat_reads_back(spark):
    rows = [(1, 2, "assistant", "b & [END] <s>"), (1, 1, "user", None), (1, 3, "assistant", "&amp;"),
            (1, 4, "user", "[AND]"), (2, None, None, "x"), (2, 1, "as<s>", ""), (2, 1, "as<s>", ""),
            (None, 0, "assistant", "é🙂")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS turns", "2 AS formatted", "3 AS t")
    made = chat.format_conversations(df)
    out = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", ""), ("assistant", "b & [END] <s>"),
                                                ("assistant", "&amp;"), ("user", "[AND]")]
    assert out[1].loss_text == "b & [END] <s>&amp;" and out[None].loss_text == "é🙂"
    assert [tuple(t) for t in out[2].turns] == [("", "x"), ("as<s>", ""), ("as<s>", "")]
    assert out[1].formatted.count("[ROLE]") == 3  # neighbours of one role are one message
    assert chat.digest(chat.read_back(chat.format_conversations(df.limit(0)))).collect() == []


# 5
def test_quality_learns_and_scores(docs, spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(4)) + ("$$$" if i % 3 == 0 else "")
                         for _ in range(30))) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300, 2)] + [(None, 1), (5, None)],
                                   "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score(docs(rows), quality.train(docs(rows), labels)).collect()}
    assert all(out[i].predicted == int(i % 3 != 0) for i in range(300))
    assert 0 <= out[900].score <= 1 and out[900].score == out[901].score
    one_class = quality.train(docs(rows), labels.filter("quality = 1"))
    assert {r.score for r in quality.score(docs(rows), one_class).collect()} == {0.5}


# 6
def test_best_match_is_the_least_edit_distance():
    rng = random.Random(5)

    def slow(pattern, text):
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            new = [i]
            for j, c in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
            row = new
        return min(row), row.index(min(row))

    for _ in range(200):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(30)))
        assert cgk.best_match(pattern, text) == slow(pattern, text)


def test_contaminated_documents_are_found(docs, spark):
    rng = random.Random(6)

    def prose(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]

    items = [" ".join(prose(rng.randrange(14, 60))) for _ in range(60)]
    rows, planted = [], set()
    for i in range(240):
        text = prose(rng.randrange(20, 200))
        if i % 2 == 0:
            k = rng.randrange(60)
            passage = items[k].split()
            if i % 4 == 0:  # edited: about one word in twelve
                passage = [prose(1)[0] if rng.random() < 1 / 12 else w for w in passage]
            at = rng.randrange(len(text))
            text[at:at] = ["(" + passage[0].upper()] + passage[1:]
            planted.add((i, k))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "too short")],
                                  "item_id long, text string")
    found = decontamination.contaminated(docs(rows + [(None, items[0]), (999, None)]), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    exact = {p for p in planted if p[0] % 4 == 2}
    assert exact <= pairs and (None, 0) in pairs
    assert len(pairs & planted) >= 0.95 * len(planted)
    assert not {d for d, _ in pairs if d is not None and d % 2 == 1}
    text = dict(rows)
    for r in found:
        if r.distance == 0 and r.doc_id is not None:
            span = text[r.doc_id][r.start:r.start + r.length].lower()
            assert span.split() == items[r.item_id].split()
    left = decontamination.drop_contaminated(docs(rows), bench)
    assert {r.doc_id for r in left.collect()} >= {i for i in range(240) if i % 2}
    assert decontamination.contaminated(docs([]), bench).collect() == []
    assert decontamination.contaminated(docs(rows), bench.limit(0)).collect() == []


# 7
def brute_lines(rows, words):
    """Lines covered by a run of at least ``words`` words that occurs earlier."""
    texts = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    texts = sorted(set(texts))
    lines = [(i, t.split("\n")) for i, t in texts]
    weight = {x: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for _, l in lines for x in l}
    dropped = {i: set() for i, _ in lines}
    for d, (i, l) in enumerate(lines):
        for s in range(len(l)):
            for e in range(s + 1, len(l) + 1):
                if sum(weight[x] for x in l[s:e]) < words:
                    continue
                earlier = any(m[q:q + e - s] == l[s:e] and (c, q) < (d, s)
                              for c, (_, m) in enumerate(lines[:d + 1]) for q in range(len(m) - (e - s) + 1))
                if earlier:
                    dropped[i] |= set(range(s, e))
    return {i: sorted(v) for i, v in dropped.items()}


def test_line_runs_equal_brute_force(docs):
    rng = random.Random(8)
    pool = ["", "one", "two words", "three words here", "a much longer line of eight words now", "x y z"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(14)]
    rows += [(20, None), (None, "x y z\ntwo words"), (3, rows[3][1])]
    want = brute_lines(rows, 5)
    out = line_dedup.dedup_lines(docs(rows), min_words=5).collect()
    assert len(out) == len(rows)
    for r in out:
        assert sorted(r.dropped_lines) == want[-1 if r.doc_id is None else r.doc_id], r
    assert line_dedup.dedup_lines(docs([])).collect() == []


# 8
def test_exact_groups(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", 10)
    rows = [(i, "a \n b" if i % 2 else "a b") for i in range(40)] + [
        (50, None), (51, ""), (52, " "), (None, "z"), (53, "z"), (54, "a b "), (54, "a b ")]
    out = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs(rows)).collect()}
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for text, ids in norm.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        keep = None if None in ids else min(ids)
        for i in ids:
            r = out[i, sha]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)
    assert exact_dedup.exact_groups(docs([])).collect() == []


# 9
def test_licences_are_found(docs):
    text = "Intro é. " + licenses.TEMPLATES["Apache-2.0-text"].replace("compliance", "accordance") + " End."
    rows = [(1, "x\nreleased under the  MIT license!\n y"), (2, text), (3, "no licence here at all"),
            (None, "Licensed under CC BY-NC 4.0."), (4, None), (5, "released under the MIT")]
    out = licenses.scan_licenses(docs(rows)).collect()
    found = {(r.doc_id, r.license) for r in out}
    assert found == {(1, "MIT"), (2, "Apache-2.0"), (2, "Apache-2.0-text"), (None, "CC-BY-NC-4.0"), (5, "MIT")}
    span = next(r for r in out if r.license == "Apache-2.0-text")
    assert text[span.start:span.start + span.length].startswith("Licensed under") and span.coverage > 0.9
    assert licenses.scan_licenses(docs([])).collect() == []


def test_winnowing_keeps_one_of_every_window():
    hashes = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = set(licenses.winnowed(hashes).tolist())
    assert all(kept & set(range(k, k + licenses.WINDOW)) for k in range(200 - licenses.WINDOW + 1))


# 10
def test_tokens_round_trip(docs, spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    path = token_output.corpus_path(spark)
    token_output.write_tokens(docs(ODD), path, VOCABULARY)
    out = token_output.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 4, 5, 6, 6]
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in ODD)
    assert sorted(tuple(r.ids) for r in out) == want
    at = 0
    for r in out:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_no_documents_no_tokens(docs, spark):
    path = token_output.corpus_path(spark)
    token_output.write_tokens(docs([]), path, VOCABULARY)
    assert token_output.read_tokens(spark, path).collect() == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    counts = np.bincount(np.minimum(rng.zipf(1.3, 200_000), 30_000), minlength=40_000)
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.MAX_BITS
    assert np.sum(2.0 ** -lengths[lengths > 0].astype(float)) <= 1
    ids = rng.choice(np.flatnonzero(counts), n)
    words, lanes = huffman.pack(ids, huffman.packing_tables(lengths))
    assert (huffman.unpack(words, lanes, n, *huffman.decode_table(lengths)) == ids).all()


def test_code_lengths_are_optimal():
    counts = np.array([5, 9, 12, 13, 16, 45, 0])
    assert huffman.code_lengths(counts).tolist() == [4, 4, 3, 3, 3, 1, 0]
    assert huffman.code_lengths(counts, 3).max() == 3
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]
