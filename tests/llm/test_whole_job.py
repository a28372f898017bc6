"""Cases in which an operator once did less than the whole job."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from ledgerlens.llm import cgk, decontamination, language_id, ngram_join, ppm, quality, token_output
from ledgerlens.llm.common import least_hashed


# pipeline
def table(docs, rows, tmp_path, written):
    """The rows as they are, or as a table of files."""
    if not written:
        return docs(rows)
    path = str(tmp_path / "docs")
    docs(rows).repartition(3).write.parquet(path)
    return docs([]).sparkSession.read.parquet(path)


def near_copy_rows():
    text = "one two three four five six seven eight"
    return [(None, text), (1, text), (2, text), (2, text), (None, text), (3, "a text of its own"),
            (4, "twice the same row"), (4, "twice the same row"), (5, None), (5, None),
            (6, "left alone by the others"), (6, "but with an id that is shared")]


def near_copies_left(docs, tmp_path, written):
    left = ngram_join.drop_near_copies(table(docs, near_copy_rows(), tmp_path, written))
    assert left.columns == docs([]).columns
    return sorted(((r.doc_id, r.text) for r in left.collect()), key=str)


# One row of each group stays, also of rows that repeat id and text; texts
# without words are linked with nothing.
WANT_LEFT = sorted([(None, "one two three four five six seven eight"), (3, "a text of its own"),
                    (4, "twice the same row"), (5, None), (5, None),
                    (6, "left alone by the others"), (6, "but with an id that is shared")], key=str)


def test_near_copies_of_null_and_repeated_ids_go(docs, tmp_path):
    assert near_copies_left(docs, tmp_path, False) == WANT_LEFT


def test_near_copies_of_null_and_repeated_ids_go_from_files(docs, tmp_path):
    assert near_copies_left(docs, tmp_path, True) == WANT_LEFT


def test_contaminated_rows_go_whatever_their_ids(docs, spark, tmp_path):
    item = "the item that a benchmark asks about in so many words"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(None, "before " + item), (None, "clean"), (1, item + " after"), (1, "clean too"),
            (2, "clean as well")]
    for written in (False, True):
        left = decontamination.drop_contaminated(table(docs, rows, tmp_path, written), bench)
        assert left.columns == docs([]).columns
        assert sorted((r.text for r in left.collect())) == ["clean", "clean as well", "clean too"]


# 6
def invented(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_copies_with_a_typo_in_every_second_word_are_found(docs, spark):
    rng = random.Random(3)
    items = [" ".join(invented(rng, rng.randrange(15, 60))) for _ in range(40)]
    rows = []
    for k, item in enumerate(items):
        copy = item.split()
        for j in range(0, len(copy), 2):
            at = rng.randrange(len(copy[j]))
            copy[j] = copy[j][:at] + "z" + copy[j][at + 1:]
        rows.append((k, " ".join(invented(rng, 30) + copy + invented(rng, 30))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs(rows), bench).collect()}
    assert len(found) >= 38 and all(a == b for a, b in found)
    assert all(r.distance == cgk.best_match(items[k], rows[k][1])[0] for (k, _), r in found.items())


def test_recall_holds_at_each_rate_for_items_of_any_size():
    rng = random.Random(5)
    texts = [" ".join(invented(rng, n)) for n in (5, 6, 7, 9, 12, 15, 30, 60, 150) for _ in range(8)]
    reader = cgk.Reader()
    sizes = np.diff(reader.read(texts).first)
    for w, members, *step in cgk.plan(texts, reader, 0.25, sizes):
        assert 2 * w <= 2 * cgk.MAX_WINDOW and cgk.Walk(w, 0).steps[-1] < 2 * w
        recall = cgk.recalls([texts[k] for k in members], reader, 0.25, w)(*step)
        assert min(recall.values()) >= 0.9


def test_a_walk_emits_and_moves_by_step_and_character():
    rng = random.Random(8)
    text = "".join(rng.choice("abc ") for _ in range(3000))
    plain = np.array([ord(c) for c in text], np.uint32)
    walk = cgk.Walk(5, 1)
    got = walk.keys(plain).tolist()
    assert got == cgk.Walk(5, 1).keys(plain).tolist() and list(walk.steps)[-1] < 10
    # One walk at a time: bit t of a character's hash says whether it is left.
    h = {c: (ord(c) + 1) * int(walk.factor) % 2 ** 32 for c in "abc "}
    for c in h:
        h[c] ^= h[c] >> 15
        h[c] = h[c] * int(walk.mix) % 2 ** 32
        h[c] ^= h[c] >> 13
    emitted = {}
    for start in range(2900):
        at, out = start, ""
        for step in range(10):
            out += text[at] if step in walk.steps else ""
            at += h[text[at]] >> step & 1
        emitted.setdefault(out, set()).add(got[start])
    assert all(len(keys) == 1 for keys in emitted.values())
    assert len(set.union(*emitted.values())) == len(emitted)


def test_walks_over_characters_alone_find_copies_of_long_items_with_typos():
    rng = random.Random(4)
    texts = [" ".join(invented(rng, n)) for n in (20, 40, 60) for _ in range(10)]
    reader = cgk.Reader()
    sizes = reader.read(texts).spans()[1]
    plan = cgk.plan(texts, reader, 0.25, sizes)
    copies = cgk.Copies(texts, reader, 0.25, seed=6)
    index, found = cgk.Index(copies.items, plan, copies.slack), np.zeros(len(copies.owner), bool)
    assert all(isinstance(walk, cgk.Walk) for pairs in index.tables.values() for walk, _ in pairs)
    for doc, item, _, _ in index.candidates(copies.read):
        found[doc[copies.owner[doc] == item]] = True
    assert min(found[those].mean() for those in copies.cells.values()) >= 0.9


def test_parts_abreast_have_the_least_edit_distance():
    rng = random.Random(6)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 65))),
              "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 90)))) for _ in range(60)]
    codes = [[np.array([ord(c) for c in x], np.uint32) for x in pair] for pair in pairs]
    got = cgk.least_distances([p for p, _ in codes], np.arange(60), [t for _, t in codes])
    assert got.tolist() == [cgk.best_match(p, t)[0] for p, t in pairs]


def test_short_items_and_scripts_without_spaces_are_found(docs, spark):
    items = ["Quo vadis?", "模型在测试集上的准确率是多少", "ภาษาไทยไม่มีช่องว่าง", "one two three four", None, "?!", "東京"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(0, "he asked: quo, VADIS"), (1, "问题：“模型在测试集的准确率是多少？”请回答。"),
            (2, "ดูภาษาไทยไม่มีช่องว่างนี้"), (3, "zero one two three four five"),
            (4, "quo non vadis"), (5, "one two three"), (6, "我住在東京都。"), (7, "京東"), (8, None)]
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs(rows), bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 3), (6, 6)}
    assert found[1, 1].distance == 1 and found[2, 2].distance == 0
    text = dict(rows)
    spans = {k: text[k[0]][r.start:r.start + r.length] for k, r in found.items()}
    assert spans[0, 0] == "quo, VADIS" and spans[1, 1] == "模型在测试集的准确率是多少" and spans[6, 6] == "東京"


# 2
def test_every_language_is_learned(docs):
    rng = random.Random(9)
    syllables = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    own = {f"l{k:02}": rng.sample(syllables, 4) for k in range(70)}
    rows = []
    for k, lang in enumerate(own):
        for copy in range(2 if k % 7 else 1):  # the rare ones come last by frequency
            rows.append((10 * k + copy, " ".join(rng.choice(own[lang]) for _ in range(60)), lang))
    df = docs(rows + [(None, "12 34", None)])
    model = language_id.train(df)
    assert [len(langs) for langs, _ in model] == [64, 6]
    out = {r.doc_id: r for r in language_id.predict(df, model, keep=("lang", "text")).collect()}
    assert len(out) == len(rows) + 1 and (out[None].lang_pred, out[None].score) == ("und", 0.0)
    one = ppm.Model([x for langs, _ in model for x in langs], [c for _, per in model for c in per], 10 ** 9)
    for i, text, lang in rows:
        r, bits = out[i], one.bits([text.encode()])[0]
        assert r.lang_pred == r.kept0 == lang and r.kept1 == text
        assert abs(r.score - 1 / np.exp2(bits.min() - bits).sum()) < 1e-6


# The sample of a training set
def test_a_language_under_few_ids_is_learned(docs):
    german = "der Hund und die Katze gehen durch den Wald nach Hause "
    english = "the dog and the cat go through the wood on their way home "
    rows = [(k % 10, german + str(k % 500), "de") for k in range(4000)]
    rows += [(10_000 + k, english + str(k), "en") for k in range(200)]
    model = language_id.train(docs(rows))
    assert [lang for langs, _ in model for lang in langs] == ["de", "en"]
    found = {r.doc_id: r.lang_pred for r in language_id.predict(
        docs([(1, german), (2, english)]), model).collect()}
    assert found == {1: "de", 2: "en"}


def test_the_sample_is_bounded_and_no_group_is_lost(spark):
    rows = spark.range(20_000).selectExpr(
        "CASE WHEN id < 12000 THEN 'one' WHEN id < 19500 THEN 'few' ELSE 'many' END AS g",
        "CASE WHEN id < 12000 THEN 7L WHEN id < 19500 THEN id % 5 ELSE id END AS m")
    got = {}
    for r in least_hashed(rows, "g", "m", 30).collect():
        got.setdefault(r.g, set()).add(r.m)
    assert got["one"] == {7} and got["few"] == {0, 1, 2, 3, 4} and len(got["many"]) == 30


def test_quality_learns_from_repeated_ids(docs, spark):
    good, bad = "calm words that follow one another in a line. ", "$$$ ### 123 &&& !!! "
    rows = [(k % 6, (good if k % 6 < 3 else bad) * (1 + k % 7)) for k in range(3000)]
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(6)], "doc_id long, quality int")
    model = quality.train(docs(rows), labels)
    out = {r.doc_id: r.score for r in quality.score(docs([(1, good * 3), (2, bad * 3)]), model).collect()}
    assert out[1] > out[2]


def test_quality_learns_from_every_label(docs, spark):
    # More than 4,000 of each class.
    rows = [(k, "calm words in a line " + ("and so on" if k % 23 else "77 88 99 66 55")) for k in range(4600)]
    rows += [(10_000 + k, "$$$ ### &&& !!! %%%" if k % 2 else "### $$$") for k in range(30_000)]
    labels = spark.createDataFrame([(k, int(k < 10_000)) for k, _ in rows], "doc_id long, quality int")
    seen = {}
    saved = quality.saved
    try:
        quality.saved = lambda df, name: seen.setdefault(name, saved(df, name))
        model = quality.train(docs(rows), labels)
    finally:
        quality.saved = saved
    assert seen["quality-train"].count() == len(rows)
    assert seen["quality-pairs"].count() == 30_000  # every bad text is met
    out = quality.score(docs(rows), model).groupBy("doc_id").agg({"raw": "max"}).collect()
    raw = sorted(r["max(raw)"] for r in out)
    assert abs(model["offset"] - raw[30_000]) < 1e-9


def test_quality_learns_from_each_text_of_an_id(docs, spark):
    good, bad = "calm words that follow one another. ", "$$$ ### 123 &&& !!! "
    rows = [(k % 2, (good if k % 2 else bad) * (1 + k)) for k in range(20)] * 2
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, quality int")
    seen = {}
    saved = quality.saved
    try:
        quality.saved = lambda df, name: seen.setdefault(name, saved(df, name))
        quality.train(docs(rows), labels)
    finally:
        quality.saved = saved
    assert seen["quality-train"].count() == 20


# 10
def test_documents_assembled_in_slices_are_the_same():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = token_output.Encoder(f.read(), 2)
    rng = random.Random(2)
    texts = [" ".join(invented(rng, rng.randrange(40))) for _ in range(60)] + [None, "", " ", "Ab.c <| É"]
    most, got = token_output.SLICE_PIECES, []
    try:
        for token_output.SLICE_PIECES in (most, 50, 1):
            got.append(encoder.encode(pa.array(texts)))
    finally:
        token_output.SLICE_PIECES = most
    for ids, sizes in got[1:]:
        assert ids.tolist() == got[0][0].tolist() and sizes.tolist() == got[0][1].tolist()
    ends = np.cumsum(got[0][1])
    for text, a, b in zip(texts, ends - got[0][1], ends):
        assert got[0][0][a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_the_arrays_of_a_group_stay_a_few_times_its_text():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_output.Encoder(f.read(), 2)
    rng = random.Random(2)
    some = invented(rng, 2000)
    texts = pa.array([" ".join(rng.choices(some, k=400)) for _ in range(2000)])
    encoder.encode(texts.slice(0, 10))
    tracemalloc.start()
    encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]  # numpy's arrays and Python's objects
    tracemalloc.stop()
    assert peak < 6 * texts.nbytes
