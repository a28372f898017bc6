"""Operator 13: skip list and fill-in-the-middle against plain forms."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlens.llm import fill_middle, skiplist

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_cut(text, rank):
    return sum(map(len, UNIT.findall(text)[:rank]))


def plain_row(doc_id, text):
    """The contract, word by word."""
    units = UNIT.findall(text or "")
    n = len(units)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def mixed_text(rng, size):
    return "".join(rng.choice(["a", "Z", "bcd", " ", "\n", "é", "日", "🙂", "1", "<", "_"])
                   for _ in range(size))


def test_every_rank_of_small_texts():
    rng = random.Random(1)
    for size in (0, 1, 2, 7, 40, 400):
        text = mixed_text(rng, size)
        index = skiplist.SkipList(text)
        assert index.n_units == len(UNIT.findall(text)) and index.n_chars == len(text)
        for rank in range(index.n_units + 1):
            assert index.cut(rank) == plain_cut(text, rank)


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(skiplist, "PIECE", 7)
    rng = random.Random(2)
    for text in ("x" * 50, " " * 50, "é" * 50, mixed_text(rng, 300), "ab " * 30):
        index = skiplist.SkipList(text)
        for rank in range(index.n_units + 1):
            assert index.cut(rank) == plain_cut(text, rank)


def test_lanes_are_few_and_short():
    index = skiplist.SkipList("word " * 300_000)
    assert 5 <= len(index.lanes) <= 9
    assert index.cut(400_001) == 5 * 200_000 + 4
    for lower, upper in zip(index.lanes, index.lanes[1:]):
        assert upper[0].sum() == lower[0].sum() and upper[1].sum() == lower[1].sum()
        assert len(upper[0]) < len(lower[0]) / 4


def test_documents_against_the_plain_form(docs):
    rng = random.Random(3)
    rows = [(i, mixed_text(rng, rng.randrange(0, 60))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "holds <S> a marker"), (203, "<<P"), (203, "<<P"),
             (204, "word " * 60_000), (205, "x" * 100_000), (206, "<" * 40)]
    out = fill_middle.fill_in_middle(docs(rows)).withColumn("text", fill_middle.restored())
    got = sorted(tuple(r) for r in out.collect())
    want = sorted((*plain_row(*r), r[1] or "") for r in rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_a_text_cut_inside_a_marker_is_restored(docs):
    rows = [(i, "<P <S <M> P>"[:k] + "<") for i, k in enumerate(range(8))] * 4
    out = fill_middle.fill_in_middle(docs(rows).filter("text not like '%<M>%'"), rate=100)
    for r in out.withColumn("text", fill_middle.restored()).collect():
        assert r.text == dict(rows)[r.doc_id]


def test_null_ids_and_empty_table(docs, spark):
    out = fill_middle.fill_in_middle(docs([(None, "a b c")])).first()
    assert out.doc_id is None and out.n == 5
    assert fill_middle.fill_in_middle(docs([])).count() == 0


def test_rates_are_kept(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"))
    found = {r.form: r["count"] for r in
             fill_middle.fill_in_middle(rows).groupBy("form").count().collect()}
    assert abs(found["plain"] / 4000 - 0.10) < 0.03
    assert abs(found["spm"] / 4000 - 0.18) < 0.03
