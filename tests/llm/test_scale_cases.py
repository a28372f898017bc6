"""Many sources, shared ids and sizes, rows without ids, trees a language."""

import random
import re
import time

import numpy as np
import pytest

from ledgerlens.llm import language_id, line_dedup, mixing, ngram_join, ppm


def test_many_sources_equal_few(docs, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "b", "ç", "d", "e", "zz", None]))
            for i in range(500)] + [(900, None, "en", "empty")]
    rows += [(1000 + i, "w " * 100, "en", "big") for i in range(40)]
    few = {r.doc_id: r for r in mixing.mix(docs(rows)).collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    many = {r.doc_id: r for r in mixing.mix(docs(rows)).collect()}
    assert few.keys() == many.keys()
    for i, r in few.items():
        assert many[i].target == pytest.approx(r.target) and many[i].rate == pytest.approx(r.rate, rel=1e-3)
    for source in {r.source for r in few.values()}:
        mine = [r for r in many.values() if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100
    with pytest.raises(ValueError, match="on_table"):
        mixing.mix(docs(rows), weights=lambda sources: {s: 1.0 for s in sources})


def test_rows_of_one_id_and_size_fill_many_cohorts(docs, monkeypatch):
    monkeypatch.setattr(mixing, "COHORT_ROWS", 50)
    df = docs([(None, "two words", "en", "a")] * 700 + [(i, "w " * (1 + i % 5), "en", "b") for i in range(300)])
    seen = []
    kernel = mixing._dealt
    monkeypatch.setattr(mixing, "_dealt", lambda rated: seen.append(kernel(rated)) or seen[-1])
    out = mixing.mix(df).collect()
    sizes = [r["count"] for r in seen[0].groupBy("_source", "_cohort").count().collect()]
    assert len(out) == 1000 and max(sizes) <= 120
    mine = [r for r in out if r.source == "a"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df).collect()))


def test_rows_without_ids_are_documents_of_their_own(docs, spark, tmp_dir):
    text = "a line of some five words\nand one more of six words here\nshort"
    rows = [(None, text), (None, text), (7, text), (8, "nothing"), (8, "nothing")]
    stored = docs(rows)
    stored.write.parquet(tmp_dir + "/docs")
    for table in (stored, spark.read.parquet(tmp_dir + "/docs")):
        out = line_dedup.dedup_lines(table).collect()
        dropped = sorted((r.doc_id is None, len(r.dropped_lines)) for r in out)
        assert dropped == [(False, 0), (False, 0), (False, 3), (True, 0), (True, 3)]


def test_kept_lines_of_a_long_document(docs):
    rng = random.Random(2)
    own = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(12)) for _ in range(9_000)]
    shared = [" ".join(f"s{rng.randrange(10 ** 6)}" for _ in range(12)) for _ in range(9_000)]
    mixed = [x for pair in zip(own, shared) for x in pair]
    begin = time.time()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(
        docs([(1, "\n".join(shared)), (2, "\n".join(mixed)), (3, None)])).collect()}
    assert out[1].dropped_lines == [] and out[1].text == "\n".join(shared)
    assert out[2].text == "\n".join(own) and out[2].n_lines == 18_000
    assert out[2].dropped_lines == list(range(1, 18_000, 2)) and out[3].text == ""
    assert time.time() - begin < 60


def test_a_tree_does_not_depend_on_other_languages():
    few = ppm.grams([b"abc abc abd", b"zebra"])
    loud = ppm.grams([bytes(range(33, 255)) * 200, b"noise and noise " * 500])
    alone = ppm.Model(["x"], [few], nodes=30).bits([b"abc abd", b"zoo", b""])
    beside = ppm.Model(["loud", "x"], [loud, few], nodes=30).bits([b"abc abd", b"zoo", b""])
    assert np.array_equal(alone[:, 0], beside[:, 1])
    tree = ppm.tree(*loud)
    assert len(tree["cost"]) <= ppm.NODES * 256 and sum(x.nbytes for x in tree.values()) < 4 << 20


def test_slices_of_languages_agree(docs, monkeypatch):
    rng = random.Random(5)
    alphabets = {f"l{k}": [chr(97 + k + j) for j in range(6)] for k in range(6)}
    rows = [(100 * n + i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(12)), lang)
            for n, (lang, a) in enumerate(alphabets.items()) for i in range(20)] + [(9, None, None), (9, "123", "l0")]
    whole = language_id.predict(docs(rows), language_id.train(docs(rows))).collect()
    monkeypatch.setattr(language_id, "SLICE_LANGUAGES", 2)
    model = language_id.train(docs(rows))
    sliced = language_id.predict(docs(rows), model).collect()

    def key(r):
        return str(r.doc_id), r.lang_pred, round(r.score, 6)
    assert len(model) == 3 and sorted(map(key, whole)) == sorted(map(key, sliced))


def test_shingles_are_dealt_in_time_that_does_not_grow_with_the_ranges():
    import pyarrow as pa
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(200), pa.int64()), "_text": texts})
    begin = time.time()
    (out,) = list(ngram_join._send(1_000_000)([batch]))
    assert time.time() - begin < 5
    assert sum(x >= 0 for x in out.column("range").to_pylist()) <= 200 * 196
    assert re.match("binary", str(out.schema.field("payload").type))
