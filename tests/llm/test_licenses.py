import random

import numpy as np
import pytest

from ledgerlens.llm import license_notices, licenses
from ledgerlens.llm.license_notices import TELLING, TEMPLATES, licence_of


def found(docs, rows, **options):
    return sorted((r.doc_id, r.license) for r in licenses.scan_licenses(docs(rows), **options).collect())


def test_telling_words_keep_licences_apart(docs):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 2."),
        (2, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (3, "Released under the BSD License."), (4, "Released under the FOO License."),
        (5, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (6, "Licensed under CC BY-NC-ND 4.0."), (7, TEMPLATES["BSD-2-Clause-full"]),
        (8, TEMPLATES["BSD-3-Clause-full"])]
    assert found(docs, rows) == [
        (1, "GPL-2.0"), (2, "CC-BY-SA-4.0"), (3, "BSD"), (5, "LGPL-3.0"),
        (6, "CC-BY-NC-ND-4.0-short"), (7, "BSD-2-Clause-full"), (8, "BSD-3-Clause-full")]


def test_every_default_template_finds_itself_and_no_other_licence(docs):
    names = sorted(TEMPLATES)
    got = found(docs, [(i, f"é before\n{TEMPLATES[n]} after") for i, n in enumerate(names)])
    for i, name in enumerate(names):
        mine = {n for d, n in got if d == i}
        assert name in mine and {licence_of(n) for n in mine} == {licence_of(name)}


def test_edited_notices_are_found_with_their_spans(docs):
    rng = random.Random(3)
    rows, want = [], {}
    for i, name in enumerate(sorted(n for n in TEMPLATES if n.endswith(("-text", "-header")))):
        tell = {w for p in TELLING[name] for w in p.lower().split()}
        words = [w if w.lower().strip(".,;") in tell or rng.random() > 0.1 else "changed"
                 for w in TEMPLATES[name].split()]
        rows.append((i, "Ünlike text first. " + " ".join(words) + " And after."))
        want[i] = licence_of(name)
    out = licenses.scan_licenses(docs(rows)).collect()
    assert {(r.doc_id, licence_of(r.license)) for r in out} == set(want.items())
    for r in out:
        text = dict(rows)[r.doc_id][r.start:r.start + r.length]
        assert "first" not in text and not text.endswith("after") and 0.75 <= r.coverage <= 1


def test_ties_repeated_rows_and_long_texts(docs):
    mit, apache = TEMPLATES["MIT"], TEMPLATES["Apache-2.0"]
    filler = "nothing of the kind here " * 40_000
    rows = [(1, f"{mit} {mit}"), (1, f"{mit} {mit}"), (2, filler + mit + filler + apache), (3, "\n"), (4, None)]
    assert found(docs, rows) == [(1, "MIT")] * 4 + [(2, "Apache-2.0"), (2, "MIT")]
    spans = {(r.start, r.length) for r in licenses.scan_licenses(docs(rows[:1])).collect()}
    assert spans == {(0, 30), (32, 30)}


def test_slices_of_templates_agree_with_one_scan(docs, monkeypatch):
    rows = [(i, f"a b {TEMPLATES[n]} c") for i, n in enumerate(sorted(TEMPLATES)) if len(TEMPLATES[n]) < 2000]
    rows += [(None, TEMPLATES["MIT"]), (None, TEMPLATES["MIT"])]
    few = {n: t for n, t in TEMPLATES.items() if len(t) < 2000}

    def scan():
        out = licenses.scan_licenses(docs(rows), few).collect()
        return sorted(map(str, out))
    one = scan()
    monkeypatch.setattr(licenses, "SLICE_WORDS", 100)
    assert len(licenses._slices(few)) > 5 and scan() == one
    with pytest.raises(ValueError):
        licenses.Index({"short": "two words"}, {})


def test_overlaps_equal_a_plain_reading():
    rng = random.Random(9)
    for _ in range(200):
        spans = {}
        for _ in range(rng.randrange(1, 12)):
            name, start = rng.choice(["A", "A-text", "B", "C-full"]), rng.randrange(30)
            spans[name, start] = (name, rng.randrange(1, 6), start, start + rng.randrange(1, 9))
        kept = []
        for s in sorted(spans.values(), key=lambda x: (-x[1], x[3] - x[2], x[2], x[0])):
            over = [k for k in kept if k[2] < s[3] and s[2] < k[3]]
            if not any(k[0] == s[0] or licence_of(k[0]) != licence_of(s[0]) for k in over):
                kept.append(s)
        assert licenses.best_spans(list(spans.values())) == sorted(kept, key=lambda x: (x[2], x[0]))


def brute_alignment(template, text):
    """Greatest (score, matched) of the template against any part of the text."""
    row = [(0, 0)] * (len(text) + 1)
    for t in template:
        new = [(row[0][0] - 1, row[0][1])]
        for j, x in enumerate(text):
            same = int(t == x)
            new.append(max((row[j][0] + (1 if same else -1), row[j][1] + same),
                           (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1])))
        row = new
    return max(row)


def test_alignment_equals_the_whole_table():
    rng = random.Random(4)
    for _ in range(150):
        template = [rng.randrange(6) for _ in range(rng.randrange(3, 14))]
        text = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        matched, left, right = licenses.align(template, text, 0, band=30)
        assert matched == brute_alignment(template, text)[1] and 0 <= left <= len(text) >= right


def test_phrases_stand_word_by_word():
    text = np.array([1, 2, 1, 2, 3], np.uint64)
    assert licenses.contains(text, np.array([1, 2, 3], np.uint64))
    assert not licenses.contains(text, np.array([1, 3], np.uint64))
    assert not licenses.contains(text[:0], np.array([1], np.uint64))
    assert license_notices.licence_of("GPL-3.0-full") == "GPL-3.0"
